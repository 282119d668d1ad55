"""Two-pass external shuffle into shards of equal row counts.

Pass one scatters records by a seeded hash of the whole record, and of its ordinal among equal records, into buckets of
about `bucket_bytes` of text.  Pass two loads one bucket at a time, brings it into an order of its own (by record digest
and ordinal), runs a seeded Fisher-Yates shuffle and writes it.  The global order is (bucket, place in bucket); it is cut
into `shards` runs whose lengths differ by at most one row (law "rows").  Everything follows from the records and the seed,
so a rerun or a retried task gives the same.

Bucket counts stay distributed: a running sum over groups of GROUP buckets, and one within each group, gives every bucket
its begin, which travels with the bucket's rows.

Defined cases: nulls in any column count as values; equal records differ in nothing, so which of them comes first does
not matter; a very long text makes a bucket of its own size; columns of the input named shard or slot are replaced, all others
kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, free_name, with_ordinals

#: Buckets whose counts are summed in one task.
GROUP = 1 << 14


def fisher_yates(n: int, rng: np.random.Generator) -> list[int]:
    order = list(range(n))
    picks = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64)
    for i in range(n - 1, 0, -1):
        j = int(picks[i])
        order[i], order[j] = order[j], order[i]
    return order


def begins(buckets: DataFrame) -> DataFrame:
    """`bucket` and `begin`, the number of rows in all buckets before it."""
    counts = buckets.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("bucket") / GROUP))
    parts = counts.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("part").alias("of"), before.alias("base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("inside", inside).join(parts, F.col("part") == F.col("of")).select("bucket", (F.col("base") + F.col("inside")).alias("begin"))


def shuffle_to_shards(df: DataFrame, shards: int = 16, seed: int = 99, text: str = "text", bucket_bytes: int = 8_000_000) -> DataFrame:
    """`df` with `shard` int and `slot` long (gapless from 0 in its shard)."""
    df = df.drop("shard", "slot")
    names, scratch = df.columns, Scratch(df.sparkSession, "op9")
    total = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.count("*")).first()
    buckets, rows = max(1, math.ceil((total[0] + 64 * total[1]) / bucket_bytes)), total[1]
    tie, ordinal, of, start = (free_name(df, wish) for wish in ("record_digest", "record_ordinal", "record_bucket", "bucket_begin"))
    marked = with_ordinals(df, scratch, tie, ordinal)
    scattered = marked.withColumn(of, F.pmod(F.xxhash64(F.lit(seed), tie, ordinal), F.lit(buckets).cast("long")))
    known = scratch.keep(begins(scattered.select(F.col(of).alias("bucket"))), "begins").withColumnsRenamed({"begin": start, "bucket": f"{of}_of"})
    starts = np.array([s * (rows // shards) + min(s, rows % shards) for s in range(shards)], np.int64)
    schema = df.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).schema

    def run(key, table):
        table = table.take(pa.compute.sort_indices(table, sort_keys=[(tie, "ascending"), (ordinal, "ascending")]))
        begin = table.column(start)[0].as_py()
        order = fisher_yates(table.num_rows, np.random.Generator(np.random.PCG64([seed, key[0].as_py()])))
        table = table.select(names).take(pa.array(order, pa.int64()))
        rank = begin + np.arange(table.num_rows)
        shard = np.searchsorted(starts, rank, side="right") - 1
        return table.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(rank - starts[shard]))

    joined = scattered.join(known, F.col(of) == F.col(f"{of}_of")).drop(f"{of}_of")
    return joined.groupBy(of).applyInArrow(run, schema)


def write_shards(df: DataFrame, path: str, **options) -> DataFrame:
    """Write the shuffled shards as Parquet under `path`, a folder for each, rows in slot order within a file; read them back."""
    out = shuffle_to_shards(df, **options)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)
