"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Folders of sessions without a shared one.
OWN_DIRS: set[str] = set()
#: Words are maximal runs of anything but the six ASCII blanks.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the path is only ever opened by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir` of the session.

    Only a session that runs in this one process may leave it unset; it then gets a temporary folder of its own, which goes
    with the process.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), f"tessera-{spark.sparkContext.applicationId}")
        if found not in OWN_DIRS:
            OWN_DIRS.add(found)
            atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables of one job in the shared folder.

    `keep` cuts lineage: it writes a table and reads it back, so a lost executor costs no recomputation of what is
    upstream.  `drop` removes what no later step reads; what a lazy result still reads stays for its owner to remove.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base, self.paths = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}-{len(self.paths)}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths.setdefault(path, name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove the tables kept under these names; without a name, everything."""
        for path, name in self.paths.items():
            if name in names or not names:
                remove(self.spark, path)
        if not names:
            remove(self.spark, self.base)


def written(df: DataFrame, label: str) -> DataFrame:
    """`df`, written into the shared folder under a new name and read back."""
    return Scratch(df.sparkSession, label).keep(df, "table")


def frugal(run):
    """A function over Arrow batches which, when its task ends, gives freed memory back to the system.

    Python workers live on between tasks; without this each would hold on to the most that any of its tasks has used.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def free_name(df: DataFrame, wish: str) -> str:
    """`wish`, lengthened by underscores until no column of `df` has it (column names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def row_digest(df: DataFrame) -> Column:
    """The MD5 of a whole row: its columns as text, in order, nulls marked."""
    return F.md5(F.concat_ws("\u241f", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u2400")) for c in df.columns)))


def with_ordinals(df: DataFrame, scratch: Scratch, digest: str, ordinal: str, most: int = 100_000) -> DataFrame:
    """`df` with `digest` (see row_digest) and `ordinal`: 0, 1, ... among equal rows, in any order.

    Only rows that have an equal are ever moved; their digests are found by a grouped count.  A group of more than
    `most` equal rows is dealt over several tasks by row position, and each part's ordinals begin where the one before ends.
    """
    out = df.withColumn(digest, row_digest(df))
    again, parts, part, own, start = (free_name(out, w) for w in ("again", "parts", "part", "own", "start"))
    met = F.col(digest) == F.col(again)
    counts = out.groupBy(digest).agg(F.count("*").alias("n")).filter("n > 1").select(F.col(digest).alias(again), F.ceil(F.col("n") / most).alias(parts))
    counts = scratch.keep(counts, "repeats")
    if counts.isEmpty():
        return out.withColumn(ordinal, F.lit(0).cast("long"))
    equal = out.join(counts, met).withColumn(part, F.pmod(F.monotonically_increasing_id(), F.col(parts))).drop(again, parts)
    sizes = equal.groupBy(digest, part).agg(F.count("*").alias("n"))
    before = Window.partitionBy(digest).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(digest).alias(again), F.col(part).alias(parts), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    starts = scratch.keep(starts, "starts")
    ranked = equal.withColumn(own, F.row_number().over(Window.partitionBy(digest, part).orderBy(digest)) - 1)
    ranked = ranked.join(starts, met & (F.col(part) == F.col(parts)))
    ranked = ranked.select(*(f"`{c}`" for c in out.columns), (F.col(own) + F.col(start)).cast("long").alias(ordinal))
    return out.join(counts, met, "left_anti").withColumn(ordinal, F.lit(0).cast("long")).unionByName(ranked)


def runs_of(sizes: list[int], most: int):
    """(start, end) of runs of items that together have about `most` (at least one item each)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if sizes:
        yield start, len(sizes)


def text_runs(batch: pa.RecordBatch, at: int, most: int):
    """Slices of a batch with about `most` bytes of the text (or binary) column `at` each, and the columns of each."""
    lengths = [n or 0 for n in pa.compute.binary_length(batch.column(at)).to_pylist()]
    for start, end in runs_of(lengths, most):
        yield batch.slice(start, end - start)
