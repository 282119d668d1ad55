"""Sliding windows: sizing from label extents, the grid, and its geometry."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WindowSchema:
    """Window and overlap sizes in pixels; the step follows and has to be positive."""

    width_window: int
    height_window: int
    width_overlap: int = 0
    height_overlap: int = 0

    def __post_init__(self):
        for name in ("width_window", "height_window", "width_overlap", "height_overlap"):
            value = getattr(self, name)
            if isinstance(value, (str, bytes, bool)) or value is None:
                raise ValueError(f"{name} is not a number: {value!r}")
            object.__setattr__(self, name, int(value))
        if min(self.width_window, self.height_window) <= 0:
            raise ValueError("windows need a positive size")
        if min(self.width_overlap, self.height_overlap) < 0:
            raise ValueError("overlaps cannot be negative")
        if min(self.width_step, self.height_step) <= 0:
            raise ValueError("windows leave no step between their overlaps")

    @property
    def width_step(self) -> int:
        return self.width_window - 2 * self.width_overlap

    @property
    def height_step(self) -> int:
        return self.height_window - 2 * self.height_overlap


def estimate_schema(extent: tuple[float, float], resolution: tuple[float, float], window_bounds=((256, 256), (512, 512))) -> WindowSchema:
    """The first of the bounds that leaves a step, with overlaps that hold an average label."""
    overlaps = [math.ceil(e / abs(r)) for e, r in zip(extent, resolution, strict=True)]
    last = None
    for width, height in window_bounds:
        try:
            return WindowSchema(width, height, *overlaps)
        except ValueError as error:
            last = error
    raise ValueError(f"none of the window bounds {list(window_bounds)} fits labels with overlaps {overlaps}") from last


def parent_window(raster_bounds: tuple, label_bounds: tuple, transform: tuple) -> tuple[float, float, float, float]:
    """(col_off, row_off, width, height), fractional pixels, of where raster and labels overlap; bounds are minx, miny, maxx, maxy."""
    if any(v is None for v in label_bounds):
        raise ValueError("there are no labels with an extent")
    (a, _, c, _, e, f) = transform

    def pixels(b):
        cols, rows = sorted(((b[0] - c) / a, (b[2] - c) / a)), sorted(((b[1] - f) / e, (b[3] - f) / e))
        return cols[0], rows[0], cols[1], rows[1]

    one, two = pixels(raster_bounds), pixels(label_bounds)
    left, top, right, bottom = max(one[0], two[0]), max(one[1], two[1]), min(one[2], two[2]), min(one[3], two[3])
    if right <= left or bottom <= top:
        raise ValueError("the extents of raster and labels do not overlap")
    return left + 0.0, top + 0.0, right - left, bottom - top


def require_same_crs(label_srid: int | None, raster_srid: int | None) -> None:
    if label_srid != raster_srid:
        raise ValueError(f"the CRS of the raster ({raster_srid}) and of the labels ({label_srid}) differ")


@dataclass(frozen=True)
class Grid:
    """Window (ci, ri) starts at (int(c0 + ci * step), int(r0 + ri * step)); order is column by column."""

    c0: float
    r0: float
    n_cols: int
    n_rows: int
    schema: WindowSchema

    def col_off(self, ci: Column) -> Column:
        return F.floor(F.lit(float(self.c0)) + ci * self.schema.width_step).cast("int")

    def row_off(self, ri: Column) -> Column:
        return F.floor(F.lit(float(self.r0)) + ri * self.schema.height_step).cast("int")

    def order(self, ci: Column, ri: Column) -> Column:
        return (ci.cast("bigint") * self.n_rows + ri).alias("window_ord")


def axis(offset: float, length: float, overlap: int, step: int) -> tuple[float, int]:
    start, stop = max(0.0, offset - overlap), length + offset - overlap
    return start, max(0, math.ceil((stop - start) / step))


def grid_of(parent: tuple[float, float, float, float], schema: WindowSchema, ensure_cover: bool = False) -> Grid:
    """The grid over `parent`; it is empty where the parent ends within the first overlap, unless `ensure_cover` asks for one window."""
    c0, n_cols = axis(parent[0], parent[2], schema.width_overlap, schema.width_step)
    r0, n_rows = axis(parent[1], parent[3], schema.height_overlap, schema.height_step)
    if ensure_cover:
        n_cols, n_rows = max(1, n_cols), max(1, n_rows)
    return Grid(c0, r0, n_cols, n_rows, schema)


def window_rows(spark: SparkSession, grid: Grid) -> DataFrame:
    """windows: window_ord, ci, ri, col_off, row_off, width, height."""
    n = grid.n_cols * grid.n_rows
    ids = spark.range(n).withColumns({"ci": F.expr(f"cast(id div {max(1, grid.n_rows)} as int)"), "ri": F.expr(f"cast(id % {max(1, grid.n_rows)} as int)")})
    return ids.select(
        F.col("id").alias("window_ord"), "ci", "ri", grid.col_off(F.col("ci")).alias("col_off"), grid.row_off(F.col("ri")).alias("row_off"),
        F.lit(grid.schema.width_window).alias("width"), F.lit(grid.schema.height_window).alias("height"),
    )


def clip_windows(windows: DataFrame, parent: tuple[float, float, float, float]) -> DataFrame:
    """Windows cut to the parent: fractional col_off, row_off, width, height."""
    left, top = (F.greatest(F.col(c).cast("double"), F.lit(float(p))) for c, p in (("col_off", parent[0]), ("row_off", parent[1])))
    right = F.least((F.col("col_off") + F.col("width")).cast("double"), F.lit(float(parent[0] + parent[2])))
    bottom = F.least((F.col("row_off") + F.col("height")).cast("double"), F.lit(float(parent[1] + parent[3])))
    return windows.select("window_ord", left.alias("col_off"), top.alias("row_off"), (right - left).alias("width"), (bottom - top).alias("height"))


def window_polygon(windows: DataFrame, transform: tuple) -> DataFrame:
    """window_ord and the box minx, miny, maxx, maxy of each window in the raster's CRS."""
    (a, _, c, _, e, f) = transform
    x0, x1 = F.lit(float(c)) + F.col("col_off") * F.lit(float(a)), F.lit(float(c)) + (F.col("col_off") + F.col("width")) * F.lit(float(a))
    y0, y1 = F.lit(float(f)) + F.col("row_off") * F.lit(float(e)), F.lit(float(f)) + (F.col("row_off") + F.col("height")) * F.lit(float(e))
    good = (F.col("width") >= 0) & (F.col("height") >= 0)
    checked = F.when(good, F.least(x0, x1)).otherwise(F.raise_error(F.lit("a window has a negative size")))
    return windows.select("window_ord", checked.alias("minx"), F.least(y0, y1).alias("miny"), F.greatest(x0, x1).alias("maxx"), F.greatest(y0, y1).alias("maxy"))


def label_windows(labels: DataFrame, grid: Grid, exact: bool = True) -> DataFrame:
    """`labels` (with edges, mincol, minrow, maxcol, maxrow) times the windows that they touch: ci, ri, window_ord, col_off, row_off.

    Candidate windows follow from the label's extent by arithmetic on the grid, so the spatial join is an explode without
    a shuffle; the exact test against the closed window box follows.
    """
    from ..functions.geometry import meets_box

    s = grid.schema

    def indices(low: str, high: str, size: int, start: float, step: int, n: int) -> Column:
        first = F.greatest(F.lit(0), F.ceil((F.col(low) - size - start) / step).cast("int") - 1)
        last = F.least(F.lit(n - 1), F.floor((F.col(high) - start) / step).cast("int") + 1)
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    out = labels.withColumn("ci", F.explode(indices("mincol", "maxcol", s.width_window, grid.c0, s.width_step, grid.n_cols)))
    out = out.withColumn("col_off", grid.col_off(F.col("ci")))
    out = out.filter((F.col("mincol") <= F.col("col_off") + s.width_window) & (F.col("maxcol") >= F.col("col_off")))
    out = out.withColumn("ri", F.explode(indices("minrow", "maxrow", s.height_window, grid.r0, s.height_step, grid.n_rows)))
    out = out.withColumn("row_off", grid.row_off(F.col("ri")))
    out = out.filter((F.col("minrow") <= F.col("row_off") + s.height_window) & (F.col("maxrow") >= F.col("row_off")))
    if exact:
        x0, y0 = F.col("col_off").cast("double"), F.col("row_off").cast("double")
        inside = (F.col("mincol") >= x0) & (F.col("maxcol") <= x0 + s.width_window) & (F.col("minrow") >= y0) & (F.col("maxrow") <= y0 + s.height_window)
        out = out.filter(inside | meets_box(F.col("edges"), x0, y0, x0 + s.width_window, y0 + s.height_window))
    return out.withColumn("window_ord", grid.order(F.col("ci"), F.col("ri")))
