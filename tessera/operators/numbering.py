"""Gapless ids in a global order without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, into: str, bucket: Column, group: list[str], order: list[str], start: int | Column = 0, counts: DataFrame | None = None) -> DataFrame:
    """`df` with `into`: start + 1, start + 2, ... by `group`, then `order`.

    Rows are ranked within their group only, so no task holds more than some groups.  Running sums over the groups' counts
    give each group its offset: within a bucket first, then over the buckets, one row per bucket.  `bucket` is a
    whole-number expression over `group` that never decreases along it (say, the leading key divided by a block size).
    `counts`: the groups with their number of rows x_n, where these are known already.
    """
    if counts is None:
        counts = df.groupBy(*group).agg(F.count("*").alias("x_n"))
    counts = counts.select(*group, "x_n", bucket.cast("bigint").alias("x_bucket"))
    upto = lambda w: F.coalesce(F.sum("x_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = counts.groupBy("x_bucket").agg(F.sum("x_n").alias("x_n"))
    firsts = totals.select(F.col("x_bucket").alias("y_bucket"), upto(Window.orderBy("x_bucket")).alias("x_first"))
    within = counts.select(*(F.col(c).alias(f"y_{c}") for c in group), "x_bucket", upto(Window.partitionBy("x_bucket").orderBy(*group)).alias("x_within"))
    offsets = within.join(firsts, F.col("x_bucket") == F.col("y_bucket")).select(*(f"y_{c}" for c in group), (F.col("x_first") + F.col("x_within")).alias("x_offset"))
    ranked = df.withColumn("x_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    first = F.lit(start) if isinstance(start, int) else start
    joined = ranked.join(offsets, [F.col(c) == F.col(f"y_{c}") for c in group])
    return joined.withColumn(into, (first + F.col("x_offset") + F.col("x_rank")).cast("bigint")).drop("x_offset", "x_rank", *(f"y_{c}" for c in group))
