"""Scenes derived from the driver's tables: labels from part, a raster from embeddings, sources from orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import bounds
from ..operators import windows
from ..operators.labels import dealt, extents
from ..schemas import GEOMETRY
from .append import Raster

#: A north-up raster of pixel size 1 whose row r lies at y = -r.
SCENE = Raster("scene.tif", 4096, 4096, (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), 3857)
WINDOW_BOUNDS = [(64, 64), (256, 256), (512, 512)]
#: Outlines as fractions of a label's width and height: rectangle, triangle, L.
OUTLINES = (
    ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)),
    ((0, 0), (1, 0), (0.5, 1), (0, 0)),
    ((0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1), (0, 0)),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number(x: float) -> Column:
    return F.lit(float(x)).cast("double")


def ring(x: Column, y: Column, w: Column, h: Column, outline) -> Column:
    return F.array(*(F.struct((x + w * number(fx)).alias("x"), -(y + h * number(fy)).alias("y")) for fx, fy in outline))


def label_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label_ord, geometry, is_multi, size_id, brand, kind: one label per part, on a scene of 4096 x 4096 pixels."""
    k = F.col("p_partkey")
    x = ((k * 37) % 3900 + (k % 8) / number(8)).cast("double")
    y = ((k * 91) % 3900 + (k % 4) / number(4)).cast("double")
    w, h = F.col("p_size").cast("double"), ((F.col("p_size") * 7) % 50 + 1).cast("double")
    outline = F.when(k % 3 == 0, ring(x, y, w, h, OUTLINES[0])).when(k % 3 == 1, ring(x, y, w, h, OUTLINES[1])).otherwise(ring(x, y, w, h, OUTLINES[2]))
    second = ring(x + w + 2, y, number(2), number(2), OUTLINES[0])
    geometry = F.when(k % 7 == 0, F.array(F.array(outline), F.array(second))).otherwise(F.array(F.array(outline)))
    return dealt(table(spark, sf_dir, "part"), "p_partkey").select(
        k.alias("label_ord"), geometry.cast(GEOMETRY).alias("geometry"), (k % 7 == 0).alias("is_multi"),
        F.col("p_size").cast("bigint").alias("size_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"),
    )


def scene_grid(labels: DataFrame) -> windows.Grid:
    whole, average = extents(labels, bounds(F.col("geometry")))
    parent = windows.parent_window(SCENE.bounds, whole, SCENE.transform)
    return windows.grid_of(parent, windows.estimate_schema(average, SCENE.resolution, WINDOW_BOUNDS))


def embedding_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raster_pixels of one band: a scanline per vector, 64 columns; values below 0 in every third scanline become 0 (no data)."""
    v = F.transform("embedding", lambda e: e.cast("double"))
    holes = F.transform(v, lambda e: F.when((F.col("vec_id") % 3 == 0) & (e < 0), number(0)).otherwise(e))
    return table(spark, sf_dir, "embeddings").select(F.lit("embeddings").alias("source_path"), F.lit(0).alias("band"), F.col("vec_id").cast("int").alias("row"), holes.alias("cols"))


def tile_windows(pixels: DataFrame) -> DataFrame:
    """Windows of 24 columns by 40 rows, 20 columns and 40 rows apart, over the whole raster of 64 columns; the last of each
    column of windows, and of each row, leave it."""
    rows = pixels.agg(F.max("row").alias("last")).select(F.explode(F.sequence(F.lit(0), F.floor((F.col("last") + 20) / 40).cast("int"))).alias("ri"))
    both = rows.select("ri", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ci"))
    return both.select(
        (F.col("ri") * 4 + F.col("ci")).cast("bigint").alias("window_ord"), (F.col("ci") * 20).alias("col_off"), (F.col("ri") * 40).alias("row_off"),
        F.lit(24).alias("width"), F.lit(40).alias("height"),
    )
