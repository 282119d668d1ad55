"""Label checks and the join to the category dimension."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import is_valid


class LabelError(ValueError):
    """A label table breaks the contract."""


#: Labels that one task works on; rings, outlines and masks cost far more than reading the rows that they come from.
TASK_LABELS = 10_000


def dealt(rows: DataFrame, key: str, most: int = TASK_LABELS) -> DataFrame:
    """`rows` over as many tasks as their number asks for, however few pieces their files have.

    Meant for slim rows, before geometry is made of them: a Parquet file of one row group is one task otherwise.  The filter
    keeps every row; not being deterministic, it is one that filters on geometry are not moved below, to before the rows are dealt.
    """
    n = math.ceil(rows.count() / most)
    return rows.repartition(n, key).filter(F.spark_partition_id() >= 0) if n > 1 else rows


def require_keys(labels: DataFrame, id_attribute: str | None, name_attribute: str | None) -> None:
    if not {id_attribute, name_attribute} & set(labels.columns):
        raise AttributeError("labels need a category id column or a category name column")


def violations(labels: DataFrame, id_attribute: str | None = None, name_attribute: str | None = None, super_attribute: str | None = None, check_rings: bool = True) -> DataFrame:
    """One row with a count of violating labels per rule; attributes that are not columns are not checked."""
    if "geometry" not in labels.columns:
        raise LabelError("labels have no geometry column")
    if not isinstance(labels.schema["geometry"].dataType, T.ArrayType):
        raise LabelError("the geometry column does not hold polygons")
    rules: dict[str, Column] = {"null_geometry": F.col("geometry").isNull()}
    if check_rings:
        rules["invalid_geometry"] = F.col("geometry").isNotNull() & ~is_valid(F.col("geometry"))
    if id_attribute in labels.columns:
        number = F.expr(f"try_cast(`{id_attribute}` AS BIGINT)")
        rules["bad_id"] = number.isNull() | (number <= 0)
    for rule, name in (("bad_name", name_attribute), ("bad_super", super_attribute)):
        if name in labels.columns:
            text = isinstance(labels.schema[name].dataType, T.StringType)
            rules[rule] = F.col(name).isNull() if text else F.lit(True)
    return labels.agg(*(F.count_if(rule).alias(name) for name, rule in rules.items()))


def validate(labels: DataFrame, id_attribute: str | None = None, name_attribute: str | None = None, super_attribute: str | None = None) -> DataFrame:
    """`labels` with ids as BIGINT; raises on the first broken rule.  One aggregate over the labels runs for it."""
    found = violations(labels, id_attribute, name_attribute, super_attribute).first().asDict()
    for rule, n in found.items():
        if n:
            raise LabelError(f"{n} labels break the rule {rule}")
    require_keys(labels, id_attribute, name_attribute)
    return labels.withColumn(id_attribute, F.col(id_attribute).cast("bigint")) if id_attribute in labels.columns else labels


#: Categories that are sent to every task; more meet the labels by a shuffle.
BROADCAST_CATEGORIES = 20_000


def join_categories(labels: DataFrame, categories: DataFrame, id_attribute: str | None = None, name_attribute: str | None = None) -> DataFrame:
    """`labels` with id, name and supercategory of their category (columns of these names are overwritten).

    The key is the id column where there is one, else the name.  A label with no category or several is an error that
    surfaces when the result is computed.
    """
    require_keys(labels, id_attribute, name_attribute)
    key, of = (id_attribute, "id") if id_attribute in labels.columns else (name_attribute, "name")
    keep = labels.withColumn("x_key", F.col(key))
    keep = keep.drop("id", "name", "supercategory")
    unique = categories.groupBy(F.col(of).alias("c_key")).agg(F.count("*").alias("c_n"), F.min(F.struct("id", "name", "supercategory")).alias("c"))
    if unique.limit(BROADCAST_CATEGORIES + 1).count() <= BROADCAST_CATEGORIES:
        unique = F.broadcast(unique)  # else labels with their geometry would move to the few tasks that their keys name
    joined = keep.join(unique, F.col("x_key") == F.col("c_key"), "left")
    good = F.coalesce(F.col("c_n"), F.lit(0)) == 1
    checked = F.when(good, F.col("c")).otherwise(F.raise_error(F.concat(F.lit("label matches "), F.coalesce("c_n", F.lit(0)).cast("string"), F.lit(" categories: "), F.coalesce(F.col("x_key").cast("string"), F.lit("null")))))
    joined = joined.withColumn("c", checked)
    out = joined.select(*keep.columns, F.col("c.id").alias("id"), F.col("c.name").alias("name"), F.col("c.supercategory").alias("supercategory")).drop("x_key")
    # A key column named like one of the three is overwritten by its checked value.
    return out


#: Values that one task may hold to find an exact quantile.
QUANTILE_ROWS = 100_000
BINS = 4096


def exact_quantile(values: DataFrame, quantile: float, most: int = QUANTILE_ROWS) -> float | None:
    """The quantile (linear interpolation) of the column v, nulls and NaN left out.

    Counts per bin of the range narrow it down to the bins that hold the two values in question, again and again until
    at most `most` values are left, or one; only counts of BINS bins reach the driver on the way.
    """
    values = values.filter("v IS NOT NULL AND NOT isnan(v)")
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    place = quantile * (n - 1)
    first, before, left = int(place), 0, n
    last = min(first + 1, n - 1)
    while left > most and low < high:
        bins = F.least(F.lit(BINS - 1), F.floor((F.col("v") - low) / ((high - low) / BINS)).cast("int"))
        rows = values.filter(F.col("v").between(low, high)).groupBy(bins.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
        ends, upto = [], before
        for r in rows:
            upto += r["n"]
            ends.append(upto)
        one, two = (next(i for i, e in enumerate(ends) if k < e) for k in (first, last))
        if one != two:  # the last value of a bin and the first of the next
            return (last - place) * rows[one]["hi"] + (place - first) * rows[two]["lo"]
        before, left, low, high = ends[one] - rows[one]["n"], rows[one]["n"], rows[one]["lo"], rows[one]["hi"]
    if low == high:
        return low
    rest = sorted(r[0] for r in values.filter(F.col("v").between(low, high)).collect())
    a, b = rest[first - before], rest[last - before]
    return a if first == last else (last - place) * a + (place - first) * b


def average_bounds(labels: DataFrame, box: Column, quantile: float = 0.9, most: int = QUANTILE_ROWS) -> tuple[float | None, float | None]:
    """The quantiles (linear interpolation, nulls and NaN left out) of label widths and heights.

    Up to `most` labels one aggregate finds both; more are narrowed down by counts (see exact_quantile).
    """
    sizes = labels.select((box["maxx"] - box["minx"]).alias("w"), (box["maxy"] - box["miny"]).alias("h"))
    if labels.limit(most + 1).count() > most:
        return tuple(exact_quantile(sizes.select(F.col(c).alias("v")), quantile, most) for c in ("w", "h"))
    row = sizes.agg(*(F.percentile(F.when(~F.isnan(c), F.col(c)), F.lit(quantile)).alias(c) for c in ("w", "h"))).first()
    return row["w"], row["h"]


def extents(labels: DataFrame, box: Column) -> tuple[tuple, tuple[float | None, float | None]]:
    """(total_bounds, average_bounds) of labels: their boxes are made once and kept while both are found."""
    boxes = labels.select(box.alias("b")).select("b.minx", "b.miny", "b.maxx", "b.maxy").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        own = F.struct("minx", "miny", "maxx", "maxy")
        return total_bounds(boxes, own), average_bounds(boxes, own)
    finally:
        boxes.unpersist()


def total_bounds(labels: DataFrame, box: Column) -> tuple:
    row = labels.select(box.alias("b")).agg(F.min("b.minx"), F.min("b.miny"), F.max("b.maxx"), F.max("b.maxy")).first()
    return tuple(row)
