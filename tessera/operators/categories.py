"""The category dimension: new members from labels, existing ones win."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SUPER = "1"


def new_categories(
    existing: DataFrame, labels: DataFrame, id_attribute: str | None = None, name_attribute: str | None = None, super_attribute: str | None = None,
    order: str = "label_ord", id_policy: str = "compat",
) -> DataFrame:
    """(id, name, supercategory) of the categories in `labels` that `existing` lacks, one per key, ascending by key.

    The key is the id if there is an id column, else the name; a key's other attributes are those of its first label.
    Names default to the id as text, supercategories to "1".  Without ids, new ones count up from 1 plus the largest id
    among the existing categories that the labels name ("compat") or among all ("safe").
    """
    has = lambda c: c is not None and c in labels.columns
    if not has(id_attribute) and not has(name_attribute):
        raise AttributeError("labels need a category id column or a category name column")
    if id_policy not in ("compat", "safe"):
        raise ValueError("id_policy is compat or safe")
    by_id = has(id_attribute)
    key = F.col(id_attribute).cast("bigint") if by_id else F.col(name_attribute)
    name = F.col(name_attribute) if has(name_attribute) else key.cast("string")
    parent = F.col(super_attribute) if has(super_attribute) else F.lit(DEFAULT_SUPER)
    rows = labels.select(key.alias("key"), F.col(order).alias("ord"), name.alias("name"), parent.alias("supercategory"))
    # The first label of a key: a minimum of numbers (hashed, combined on the map side), then its attributes by that number.
    first = rows.groupBy("key").agg(F.min("ord").alias("first"))
    firsts = rows.join(first.select(F.col("first"), F.col("key").alias("k")), (F.col("ord") == F.col("first")) & (F.col("key") == F.col("k"))).select("key", "name", "supercategory")
    of = "id" if by_id else "name"
    fresh = firsts.join(existing.select(F.col(of).alias("key")).distinct(), "key", "left_anti")
    if by_id:
        return fresh.select(F.col("key").alias("id"), "name", "supercategory")
    counted = existing if id_policy == "safe" else existing.join(firsts.select(F.col("key").alias("name")), "name", "left_semi")
    start = counted.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    # One row per category: the dimension is small, and its ids have to be gapless.
    return fresh.select((F.lit(start) + F.row_number().over(Window.orderBy("key"))).cast("bigint").alias("id"), F.col("key").alias("name"), "supercategory")


#: Categories that the driver takes over; more stay with the cluster.
SETTLED = 20_000


def settled(categories: DataFrame) -> DataFrame:
    """The same rows, computed once: what reads them later does not go through the labels again."""
    rows = categories.limit(SETTLED + 1).toArrow()
    return categories.sparkSession.createDataFrame(rows, categories.schema) if rows.num_rows <= SETTLED else categories.persist(StorageLevel.MEMORY_AND_DISK)


def add_categories(existing: DataFrame, labels: DataFrame, **attributes) -> DataFrame:
    return existing.select("id", "name", "supercategory").unionByName(new_categories(existing, labels, **attributes))
