"""The flagship plan: append a raster and its labels to a dataset.

The small facts (extent, quantile, categories, ids, version) are settled first, as aggregates; images and annotations are
then one plan: labels -> windows, row intervals, masks and their code in one kernel; ids by window, category and block of
labels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import bounds, with_edges
from ..operators import masks, windows
from ..operators.categories import add_categories, settled
from ..operators.dataset import Dataset, version_after
from ..operators.encoding import encoded
from ..operators.labels import extents, join_categories, validate
from ..operators.numbering import number_rows
from ..operators.raster import tile_name

#: Windows per block when ids are numbered, and labels per group of a window and category.
BLOCK = 64
LABELS = 1 << 20
#: Rows to a piece of a small table that is kept and read several times.
KEPT_ROWS = 100_000


@dataclass(frozen=True)
class Raster:
    """What an append has to know of a raster; `pixels` may be absent where no tile is written and all pixels are valid."""

    path: str
    width: int
    height: int
    transform: tuple[float, float, float, float, float, float]
    srid: int | None = None
    nodata: float | None = None
    dtype: str = "uint8"
    date_captured: datetime | None = None
    pixels: DataFrame | None = None

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        a, _, c, _, e, f = self.transform
        xs, ys = sorted((c, c + a * self.width)), sorted((f, f + e * self.height))
        return xs[0], ys[0], xs[1], ys[1]

    @property
    def resolution(self) -> tuple[float, float]:
        return abs(self.transform[0]), abs(self.transform[4])


def outlined(labels: DataFrame, raster: Raster) -> DataFrame:
    """label_ord, category_id, iscrowd and the edges of labels with label_ord, geometry, is_multi and category id."""
    slim = labels.select("label_ord", "geometry", F.col("id").alias("category_id"), F.col("is_multi").cast("int").alias("iscrowd"))
    return with_edges(slim, raster.transform)


def touched_windows(labels: DataFrame, raster: Raster, grid: windows.Grid) -> DataFrame:
    """window_ord, col_off, row_off of the windows that any label touches, even if no pixel comes of it."""
    return windows.label_windows(with_edges(labels.select("label_ord", "geometry"), raster.transform), grid).select("window_ord", "col_off", "row_off").distinct()


def touched_masks(labels: DataFrame, raster: Raster, grid: windows.Grid) -> DataFrame:
    """Masks (rows) of labels in all windows that they touch, empty ones too."""
    shaped = outlined(labels, raster)
    shaped = shaped.withColumn("rows", masks.label_rows(F.col("edges"), raster.height)).drop("geometry")
    size = (raster.width, raster.height)
    return masks.window_masks(windows.label_windows(shaped, grid), grid.schema.width_window, grid.schema.height_window, size, ("category_id", "iscrowd"))


def kept(rows: DataFrame, most: int) -> DataFrame:
    """`rows`, of which there are `most` at most, persisted in as few pieces as their number asks for; a kept table has as many
    as its last shuffle otherwise, and every reader as many tasks."""
    return rows.coalesce(max(1, math.ceil(most / KEPT_ROWS))).persist(StorageLevel.MEMORY_AND_DISK)


def annotate(labels: DataFrame, raster: Raster, grid: windows.Grid, invalid: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept windows, annotations without ids, their counts) of labels with label_ord, geometry, is_multi and category id.

    Kept windows are those that any label touches, even if no pixel comes of it.  All are read several times by what
    follows (ids need counts first), so masks are encoded where they are cut, and what is left of them, a short row each, is
    persisted.  The counts are computed here: readers that came at once would each compute the masks.
    """
    shaped = labels.select("label_ord", "geometry", F.col("id").alias("category_id"), F.col("is_multi").cast("int").alias("iscrowd"))
    if invalid is not None:
        rows = with_edges(shaped, raster.transform).select(*shaped.columns, masks.label_rows(F.col("edges"), raster.height).alias("rows"))
        s, top = grid.schema, int(grid.r0)
        shaped = masks.without_invalid(rows, invalid, lambda: (top, top + grid.n_rows * s.height_step + s.height_window))
    found = encoded(shaped, raster.transform, (raster.width, raster.height), grid)
    found = found.withColumn("label_block", F.floor(F.col("label_ord") / LABELS)).persist(StorageLevel.MEMORY_AND_DISK)
    counts = found.groupBy("window_ord", "col_off", "row_off", "category_id", "label_block").agg(F.count_if(F.col("area") > 0).alias("x_n"))
    counts = kept(counts, found.count())
    counts.count()
    return counts.select("window_ord", "col_off", "row_off").distinct(), found.filter(F.col("area") > 0), counts.filter("x_n > 0")


def image_rows(kept: DataFrame, start: int, images_dir: str, source_id: int, schema: windows.WindowSchema, date_captured, suffix: str) -> DataFrame:
    """images with window_ord: ids by window order."""
    blocks = kept.withColumn("x_block", F.floor(F.col("window_ord") / BLOCK))
    numbered = number_rows(blocks, "id", F.col("x_block"), ["x_block"], ["window_ord"], start)
    w, h = F.lit(schema.width_window), F.lit(schema.height_window)
    name = tile_name(images_dir, F.lit(source_id), F.col("col_off"), F.col("row_off"), w, h, suffix)
    return numbered.select("window_ord", "id", w.alias("width"), h.alias("height"), name.alias("file_name"), F.lit(source_id).cast("bigint").alias("source_id"), F.lit(date_captured).cast("timestamp_ntz").alias("date_captured"))


def annotation_rows(cut: DataFrame, counts: DataFrame, images: DataFrame, start: int) -> DataFrame:
    """annotations: ids by window, category, label order; masks without a pixel have no row."""
    numbered = number_rows(cut, "id", F.floor(F.col("window_ord") / BLOCK), ["window_ord", "category_id", "label_block"], ["label_ord"], start, counts)
    joined = numbered.join(images.select("window_ord", F.col("id").alias("image_id")), "window_ord")
    return joined.select("id", "image_id", F.col("category_id").cast("bigint").alias("category_id"), "segmentation", F.col("area").cast("double").alias("area"), "bbox", "iscrowd")


def append_dataset(
    dataset: Dataset, images_dir: str, raster: Raster, window_bounds: list[tuple[int, int]], labels: DataFrame,
    id_attribute: str | None = None, name_attribute: str | None = None, super_attribute: str | None = None,
    label_srid: int | None = None, id_policy: str = "compat", ensure_cover: bool = False, suffix: str = "jpg", write_tiles: bool = True,
) -> Dataset:
    """A new dataset with the categories, source, images and annotations of these labels; nothing changes if it fails.

    `labels`: label_ord, geometry, is_multi and the attribute columns.  Appending the same inputs again adds the rows again.
    """
    from ..operators import raster as pixels_of
    from ..sources import tiles

    labels = validate(labels, id_attribute, name_attribute, super_attribute)
    categories = settled(add_categories(dataset.categories, labels, id_attribute=id_attribute, name_attribute=name_attribute, super_attribute=super_attribute, id_policy=id_policy))
    windows.require_same_crs(label_srid, raster.srid)
    whole, average = extents(labels, bounds(F.col("geometry")))
    parent = windows.parent_window(raster.bounds, whole, raster.transform)
    schema = windows.estimate_schema(average, raster.resolution, window_bounds)
    grid = windows.grid_of(parent, schema, ensure_cover)
    version, source_id, new = version_after(dataset, raster.path, images_dir)

    nodata = pixels_of.nodata_value(raster.nodata)
    eight_bit = raster.dtype == "uint8"
    invalid = pixels_of.invalid_runs(raster.pixels, nodata) if raster.pixels is not None else None
    pictured, cut, counts = annotate(join_categories(labels, categories, id_attribute, name_attribute), raster, grid, invalid)
    n_images, n_annotations = pictured.count(), counts.agg(F.coalesce(F.sum("x_n"), F.lit(0))).first()[0]
    sizes = {"images": dataset.count("images") + n_images, "annotations": dataset.count("annotations") + n_annotations}
    images = kept(image_rows(pictured, dataset.count("images"), images_dir, source_id, schema, raster.date_captured, suffix), n_images)
    annotations = annotation_rows(cut, counts, images, dataset.count("annotations"))
    if raster.pixels is not None and write_tiles:
        boxes = pictured.select("window_ord", "col_off", "row_off", F.lit(schema.width_window).alias("width"), F.lit(schema.height_window).alias("height"))
        cells = pixels_of.tile_rows(raster.pixels, boxes, nodata)
        tiles.write(pixels_of.as_bytes(cells) if eight_bit else pixels_of.normalise(cells), images.select("window_ord", "file_name"))
    spark = dataset.spark
    source = spark.createDataFrame([(source_id, raster.path, raster.date_captured)] if new else [], "id bigint, file_name string, date_captured timestamp_ntz")
    tables = {
        "images": dataset.images.unionByName(images.drop("window_ord")),
        "annotations": dataset.annotations.unionByName(annotations),
        "categories": categories,
        "sources": dataset.sources.unionByName(source),
    }
    return Dataset(spark, dataset.info | {"version": version}, tables, {name: (tables[name], n) for name, n in sizes.items()})
