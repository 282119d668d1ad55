"""Raster operators over scanlines: raster_pixels has source_path, band, row and cols, one array of values per scanline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nodata_value(nodata: float | None) -> float:
    return float(nodata) if nodata else 0.0


def fit_row(cols: Column, width: int, pad: float) -> Column:
    """The first `width` values, padded at the end."""
    short = F.slice(cols, F.lit(1), F.lit(width))
    return F.concat(short, F.array_repeat(F.lit(float(pad)), F.greatest(F.lit(0), width - F.size(short))))


def reshape_pixels(pixels: DataFrame, bands: int, height: int, width: int, pad: float = 0.0) -> DataFrame:
    """(band, row, cols) cut or padded at the end of each axis; bands and rows count from 0."""
    spark = pixels.sparkSession
    frame = spark.range(bands * height).select((F.col("id") / height).cast("int").alias("band"), (F.col("id") % height).cast("int").alias("row"))
    given = pixels.filter((F.col("band") < bands) & (F.col("row") < height)).select("band", "row", "cols")
    return frame.join(given, ["band", "row"], "left").select("band", "row", fit_row(F.coalesce("cols", F.array().cast("array<double>")), width, pad).alias("cols"))


#: Columns of a block of a scanline.
BLOCK_COLUMNS = 256


def column_blocks(pixels: DataFrame, size: int = BLOCK_COLUMNS) -> DataFrame:
    """band, row, block, cols: scanlines cut at multiples of `size` columns."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("cols") - 1) / size).cast("int")), lambda k: F.slice("cols", k * size + 1, F.lit(size)))
    return pixels.filter(F.size("cols") > 0).select("band", "row", F.posexplode(parts).alias("block", "cols"))


def tile_rows(pixels: DataFrame, windows: DataFrame, pad: float = 0.0, size: int = BLOCK_COLUMNS) -> DataFrame:
    """window_ord, band, row, cols: every window's scanlines, padded where it leaves the raster.

    `windows`: window_ord, col_off, row_off, width, height.  A window asks for its blocks of its scanlines by (band, row,
    block), an equi join: what moves grows with the windows' own area, whatever the raster's width.  The pieces of a
    scanline meet again in order of their block.
    """
    bands = sorted(r[0] for r in pixels.select("band").distinct().collect())  # a raster's bands
    right = F.col("col_off") + F.col("width") - 1
    block = F.explode(F.sequence(F.floor(F.greatest(F.col("col_off"), F.lit(0)) / size).cast("int"), F.floor(F.greatest(right, F.lit(0)) / size).cast("int")))
    line = F.explode(F.sequence(F.col("row_off"), F.col("row_off") + F.col("height") - 1))
    lines = windows.select("window_ord", "col_off", "row_off", "width", line.alias("src_row"))
    asked = lines.withColumn("block", block).withColumn("band", F.explode(F.array(*map(F.lit, bands))))
    found = asked.join(column_blocks(pixels, size).select("band", F.col("row").alias("src_row"), "block", "cols"), ["band", "src_row", "block"], "left")
    start = F.col("block") * size
    first = F.greatest(F.col("col_off") - start, F.lit(0))
    none = F.array().cast("array<double>")
    piece = F.slice(F.coalesce("cols", none), first + 1, F.greatest(F.lit(0), F.col("col_off") + F.col("width") - start - first))
    pieces = found.groupBy("window_ord", "band", "src_row").agg(F.min("col_off").alias("col_off"), F.min("row_off").alias("row_off"), F.min("width").alias("width"), F.sort_array(F.collect_list(F.struct("block", piece.alias("p")))).alias("pieces"))
    before = F.array_repeat(F.lit(float(pad)), F.least(F.col("width"), F.greatest(F.lit(0), -F.col("col_off"))))
    cut = F.slice(F.concat(before, F.flatten(F.transform("pieces", lambda x: x["p"]))), F.lit(1), F.col("width"))
    full = F.concat(cut, F.array_repeat(F.lit(float(pad)), F.greatest(F.lit(0), F.col("width") - F.size(cut))))
    return pieces.select("window_ord", "band", (F.col("src_row") - F.col("row_off")).alias("row"), full.alias("cols"))


def normalise(tiles: DataFrame) -> DataFrame:
    """Values of each window stretched to 0..255 over all its bands and padding: half-even rounding, constant windows give 0.

    For rasters that are not 8-bit already.  Extremes come from a grouped aggregate (array extremes per scanline, combined
    on the map side) and meet the scanlines again by window.
    """
    ends = tiles.groupBy("window_ord").agg(F.min(F.array_min("cols")).alias("lo"), F.max(F.array_max("cols")).alias("hi"))
    joined = tiles.join(ends, "window_ord")
    scaled = F.transform("cols", lambda v: F.when(F.col("hi") > F.col("lo"), F.rint((v - F.col("lo")) * 255.0 / (F.col("hi") - F.col("lo")))).otherwise(0.0).cast("int"))
    return joined.select("window_ord", "band", "row", scaled.alias("cols"))


def as_bytes(tiles: DataFrame) -> DataFrame:
    return tiles.select("window_ord", "band", "row", F.transform("cols", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.rint(v).cast("int")))).alias("cols"))


def invalid_runs(pixels: DataFrame, nodata: float) -> DataFrame:
    """row, runs: where every band has no data; runs are disjoint [c0, c1] in order.

    The bands of a scanline meet by row; runs are found inside the arrays: they begin where a bad value follows a good one.
    """
    bad = pixels.select("row", F.transform("cols", lambda v: F.coalesce(v == nodata, F.lit(True))).alias("bad"))
    both = bad.groupBy("row").agg(F.collect_list("bad").alias("b"))
    every = F.aggregate(F.slice("b", F.lit(2), F.greatest(F.lit(0), F.size("b") - 1)), F.get("b", F.lit(0)), lambda acc, x: F.zip_with(acc, x, lambda p, q: p & q))
    edges = both.select("row", every.alias("bad")).filter(F.exists("bad", lambda x: x)).select("row", "bad", F.size("bad").alias("n"))
    place = F.sequence(F.lit(0), F.col("n") - 1)
    at = lambda i: F.coalesce(F.get("bad", i), F.lit(False))
    begins = F.filter(place, lambda i: at(i) & ~at(i - 1))
    ends = F.filter(place, lambda i: at(i) & ~at(i + 1))
    return edges.select("row", F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("c0"), b.alias("c1"))).alias("runs"))


#: Forms of dates, the usual ones first; where a day and a month could be exchanged, the month comes first.
DATE_FORMS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy:MM:dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyyMMdd'T'HHmmss", "yyyyMMdd HHmmss", "yyyyMMdd", "yyyy/M/d", "M/d/yyyy H:m:s", "M/d/yyyy H:m", "M/d/yyyy", "d.M.yyyy H:m:s", "d.M.yyyy",
    "d MMM yyyy H:m:s", "d MMM yyyy H:m", "d MMM yyyy", "d-MMM-yyyy H:m:s", "d-MMM-yyyy", "MMM d yyyy H:m:s", "MMM d yyyy", "d MMMM yyyy H:m:s", "d MMMM yyyy", "MMMM d yyyy H:m:s", "MMMM d yyyy",
)


def capture_date(tag: Column, modified: Column) -> Column:
    """A date tag in free form, else when the file was modified.

    Names of days, commas and repeated blanks are left out before the forms are tried.
    """
    plain = F.trim(F.regexp_replace(F.regexp_replace(tag, r"(?i)\b(mon|tue|wed|thu|fri|sat|sun)[a-z]*\b\.?|,", " "), r"\s+", " "))
    plain = F.regexp_replace(plain, r"(?i)\b(\d{1,2})(st|nd|rd|th)\b", "$1")
    parsed = [F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMS for t in ((tag,) if f in DATE_FORMS[:2] else (plain,))]
    return F.coalesce(*parsed[:2], tag.try_cast("timestamp_ntz"), *parsed[2:], modified.cast("timestamp_ntz"))


def tile_name(images_dir: str, source_id: Column, col_off: Column, row_off: Column, width: Column, height: Column, suffix: str = "jpg") -> Column:
    parts = [source_id, col_off, row_off, width, height]
    return F.concat(F.lit(images_dir.rstrip("/") + "/"), F.concat_ws("_", *(p.cast("string") for p in parts)), F.lit("." + suffix))
