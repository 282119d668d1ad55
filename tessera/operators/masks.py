"""Rasterising polygons to row intervals, and masks cut to windows.

A pixel is set where the polygon's interior overlaps its open square with positive area.  A label is rasterised once, on
the raster's own grid, in one Arrow kernel for a batch of labels; window offsets are whole pixels, so a window's mask is
the label's mask cut and shifted.  A label's rows stay beside it as one nested column, so nothing is grouped or joined.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import arrow_scalar
from ..functions.rle import counts_of, to_string


#: Row pieces of edges that are worked on at a time in a task.
PIECES = 2_000_000
ROWS = "array<struct<row:int,runs:array<struct<c0:int,c1:int>>>>"


def rasterise(starts: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, height: int | None = None) -> tuple[np.ndarray, ...]:
    """(label, row, c0, c1) of the disjoint, non-touching runs of labels 0, 1, ...; label i has the edges from starts[i] on.
    With a `height`, rows outside 0 .. height - 1 are left out, however far a label reaches.
    """
    label = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    flat = y1 == y2
    keep = ~(flat & (y1 == np.floor(y1)))
    label, flat, x1, y1, x2, y2 = (v[keep] for v in (label, flat, x1, y1, x2, y2))
    low, high = np.minimum(y1, y2), np.maximum(y1, y2)
    first = np.floor(low).astype(np.int64)
    end = np.where(flat, first + 1, np.ceil(high).astype(np.int64))
    if height is not None:
        first, end = np.maximum(first, 0), np.minimum(end, height)
    n = np.maximum(end - first, 0)
    at = np.repeat(np.arange(len(n)), n)
    row = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    label, flat, low, high = label[at], flat[at], low[at], high[at]
    ax, ay, dx, dy = x1[at], y1[at], (x2 - x1)[at], np.where(flat, 1.0, (y2 - y1)[at])
    xa = np.where(flat, ax, ax + (np.maximum(low, row) - ay) * dx / dy)
    xb = np.where(flat, x2[at], ax + (np.minimum(high, row + 1) - ay) * dx / dy)
    c0, c1 = np.floor(np.minimum(xa, xb)).astype(np.int64), np.ceil(np.maximum(xa, xb)).astype(np.int64) - 1
    # Where the line through a row's middle crosses the outline, pixels between the first and second crossing and so on are inside.
    middle = row + 0.5
    hit = ~flat & (middle >= low) & (middle < high)
    x, hit_label, hit_row = (ax + (middle - ay) * dx / dy)[hit], label[hit], row[hit]
    order = np.lexsort((x, hit_row, hit_label))
    x, hit_label, hit_row = x[order], hit_label[order], hit_row[order]
    new = np.ones(len(x), bool)
    new[1:] = (hit_label[1:] != hit_label[:-1]) | (hit_row[1:] != hit_row[:-1])
    place = np.arange(len(x)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(x) else np.empty(0, np.int64)
    begin = np.flatnonzero((place % 2 == 0)[:-1] & ~new[1:]) if len(x) else np.empty(0, np.int64)
    f0, f1 = np.ceil(x[begin] - 0.5).astype(np.int64), np.ceil(x[begin + 1] - 0.5).astype(np.int64) - 1
    label, row = np.concatenate([label, hit_label[begin]]), np.concatenate([row, hit_row[begin]])
    return merged(label, row, np.concatenate([c0, f0]), np.concatenate([c1, f1]))


def merged(label: np.ndarray, row: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs in order, empty ones left out, overlapping and adjoining ones of a row joined."""
    full = c0 <= c1
    label, row, c0, c1 = label[full], row[full], c0[full], c1[full]
    if not len(c0):
        return label, row, c0, c1
    order = np.lexsort((c0, row, label))
    label, row, c0, c1 = label[order], row[order], c0[order], c1[order]
    line = np.concatenate([[0], np.cumsum((label[1:] != label[:-1]) | (row[1:] != row[:-1]))])
    # The furthest column so far within each row: rows are set apart by more than any column is wide.
    shift = line * (c1.max() - c0.min() + 2)
    reach = np.maximum.accumulate(c1 + shift)
    new = np.concatenate([[True], (line[1:] != line[:-1]) | (c0[1:] + shift[1:] > reach[:-1] + 1)])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(c0)) - 1
    return label[begin], row[begin], c0[begin], (reach - shift)[end]


def nested_rows(n_labels: int, label: np.ndarray, row: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> pa.Array:
    """An array of ROWS, one value per label: every row from a label's first to its last, empty ones included."""
    lines = np.concatenate([[True], (label[1:] != label[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.empty(0, bool)
    at = np.flatnonzero(lines)
    line_label, line_row = label[at], row[at]
    runs = np.diff(np.append(at, len(row)))
    follows = np.concatenate([line_label[1:] == line_label[:-1], [False]]) if len(at) else np.empty(0, bool)
    span = np.where(follows, np.append(line_row[1:], 0) - line_row, 1)  # a line and the empty ones after it
    first = np.cumsum(span) - span
    counts = np.zeros(int(span.sum()), np.int64)
    counts[first] = runs
    rows = np.repeat(line_row - first, span) + np.arange(len(counts))
    of_label = np.bincount(np.repeat(line_label, span), minlength=n_labels)
    pair = pa.StructArray.from_arrays([*(pa.array(np.clip(c, -(1 << 30), 1 << 30), pa.int32()) for c in (c0, c1))], names=["c0", "c1"])
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pair)
    lines = pa.StructArray.from_arrays([pa.array(rows, pa.int32()), inner], names=["row", "runs"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(of_label)]), pa.int32()), lines)


def label_rows(edges: Column, height: int | None = None) -> Column:
    """ROWS of a label from its edges in pixels; only those of the raster where its height is given."""

    def encode(values: pa.Array) -> pa.Array:
        ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(values), 0).to_numpy(zero_copy_only=False))
        flat = values.flatten()
        x1, y1, x2, y2 = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
        low, high = (np.clip(y, 0, height) if height is not None else y for y in (y1, y2))
        tall = np.concatenate([[0], np.cumsum(np.abs(np.ceil(high) - np.floor(low)) + 1)])
        starts, parts, begin = np.concatenate([[0], ends]).astype(np.int64), [], 0
        while begin < len(values):
            # As many labels as stay within PIECES, one at least.
            end = max(begin + 1, int(np.searchsorted(tall[starts], tall[starts[begin]] + PIECES, side="right")) - 1)
            end = min(end, len(values))
            cut = slice(starts[begin], starts[end])
            parts.append(nested_rows(end - begin, *rasterise(starts[begin : end + 1] - starts[begin], x1[cut], y1[cut], x2[cut], y2[cut], height)))
            begin = end
        return pa.concat_arrays(parts) if parts else pa.array([], values.type)

    return arrow_scalar(encode, ROWS)(edges)


def row_intervals(labels: DataFrame) -> DataFrame:
    """label_ord, row, runs: the label's pixels in each row as disjoint, non-touching [c0, c1] runs in order."""
    rows = labels.select("label_ord", F.explode(label_rows(F.col("edges"))).alias("r"))
    return rows.select("label_ord", "r.row", "r.runs").filter(F.size("runs") > 0)


#: Runs without data that are sent to every task; where there are more, the rows of labels move to them.
BROADCAST_HOLES = 1_000_000


def few_holes(invalid: DataFrame, reach: Callable[[], tuple[int, int]] | None = None) -> DataFrame:
    """`invalid` (x_row, holes) as a table of the driver's that every task gets, if it is that small; scanlines are few keys for
    many labels, so a shuffle by them would move all rows of labels to few tasks.  Where it is not, it is tried again with the
    scanlines from the first to the last that labels reach."""
    flat = invalid.select("x_row", F.explode("holes").alias("h")).limit(BROADCAST_HOLES + 1).toArrow().combine_chunks()
    if flat.num_rows > BROADCAST_HOLES:
        return few_holes(invalid.filter(F.col("x_row").between(*reach()))) if reach else invalid
    row, holes = (flat.column(c).combine_chunks() if flat.num_rows else pa.array([], flat.schema.field(c).type) for c in ("x_row", "h"))
    line = row.to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.diff(line, prepend=line[0] - 1)) if len(line) else np.empty(0, np.int64)  # a scanline's lie side by side
    table = pa.table({"x_row": row.take(pa.array(first)), "holes": pa.ListArray.from_arrays(pa.array(np.append(first, len(line)), pa.int32()), holes)})
    return F.broadcast(invalid.sparkSession.createDataFrame(table, "x_row int, holes array<struct<c0:int,c1:int>>"))


def cut_invalid(rows: DataFrame, invalid: DataFrame, reach: Callable[[], tuple[int, int]] | None = None) -> DataFrame:
    """`rows` without the pixels of `invalid` (row, runs: disjoint sorted runs of pixels without data).

    `reach` finds the first and last row that labels may have; it is asked only where there are many holes.
    Few of a scene's rows meet a hole: those whose columns reach none of a scanline's pass by as they are.
    """
    invalid = few_holes(invalid.select(F.col("row").alias("x_row"), F.col("runs").alias("holes")), reach)
    ends = lambda c: (F.get(c, F.lit(0))["c0"], F.element_at(c, -1)["c1"])
    (first, last), (begin, end) = ends("runs"), ends("holes")
    joined = rows.join(invalid, (F.col("row") == F.col("x_row")) & (begin <= last) & (end >= first), "left")

    def cut(runs: Column, hole: Column) -> Column:
        left = F.transform(runs, lambda r: F.struct(r["c0"].alias("c0"), F.least(r["c1"], hole["c0"] - 1).alias("c1")))
        right = F.transform(runs, lambda r: F.struct(F.greatest(r["c0"], hole["c1"] + 1).alias("c0"), r["c1"].alias("c1")))
        return F.filter(F.concat(left, right), lambda r: r["c0"] <= r["c1"])

    near = F.filter("holes", lambda h: (h["c0"] <= last) & (h["c1"] >= first))
    runs = F.when(F.col("holes").isNull(), F.col("runs")).otherwise(F.sort_array(F.array_distinct(F.aggregate(near, F.col("runs"), cut))))
    return joined.select("label_ord", "row", runs.alias("runs")).filter(F.size("runs") > 0)


def without_invalid(labels: DataFrame, invalid: DataFrame, reach: Callable[[], tuple[int, int]] | None = None) -> DataFrame:
    """`labels` (label_ord, rows, ...) with the pixels of `invalid` taken out of `rows`."""
    lines = labels.select("label_ord", F.explode("rows").alias("r")).select("label_ord", "r.row", "r.runs").filter(F.size("runs") > 0)
    left = cut_invalid(lines, invalid, reach).groupBy("label_ord").agg(F.sort_array(F.collect_list(F.struct("row", "runs"))).alias("rows"))
    # Every row from the first to the last again, so that windows find theirs by position.
    first, last = F.col("rows")[0]["row"], F.element_at("rows", -1)["row"]
    held = F.map_from_entries("rows")
    none = F.array().cast("array<struct<c0:int,c1:int>>")
    whole = F.transform(F.sequence(first, last), lambda r: F.struct(r.alias("row"), F.coalesce(F.element_at(held, r), none).alias("runs")))
    rest = [c for c in labels.columns if c != "rows"]
    return labels.select(*rest).join(left.select("label_ord", whole.alias("rows")), "label_ord", "left").withColumn("rows", F.coalesce("rows", F.array().cast(ROWS)))


def window_masks(pairs: DataFrame, width: int, height: int, raster: tuple[int, int] | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """label_ord, window_ord, rows array<struct<row, c0, c1>> relative to the window; empty where no pixel lies in the window.

    `pairs`: label_ord, window_ord, col_off, row_off and the label's `rows` (see ROWS), of which a window takes its own by
    position.  `raster`: its (width, height); pixels beyond are padding, never set.  `carried`: further columns to keep.
    """
    right, bottom = F.col("col_off") + width - 1, F.col("row_off") + height - 1
    if raster:
        right, bottom = F.least(right, F.lit(raster[0] - 1)), F.least(bottom, F.lit(raster[1] - 1))
    top, left = F.greatest("row_off", F.lit(0)), F.greatest("col_off", F.lit(0))
    first = F.coalesce(F.get("rows", F.lit(0))["row"], F.lit(0))
    begin = F.greatest(F.lit(0), top - first)
    seen = F.slice("rows", begin + 1, F.greatest(F.lit(0), bottom - first - begin + 1))

    def cut(line: Column) -> Column:
        inside = F.filter(line["runs"], lambda r: (r["c1"] >= left) & (r["c0"] <= right))
        return F.transform(inside, lambda r: F.struct((line["row"] - F.col("row_off")).alias("row"), (F.greatest(r["c0"], left) - F.col("col_off")).alias("c0"), (F.least(r["c1"], right) - F.col("col_off")).alias("c1")))

    return pairs.select("label_ord", "window_ord", "col_off", "row_off", *carried, F.flatten(F.transform(seen, cut)).alias("rows"))


def area(rows: Column) -> Column:
    return F.aggregate(rows, F.lit(0).cast("bigint"), lambda a, r: a + r["c1"] - r["c0"] + 1)


def bbox(rows: Column) -> Column:
    """[x, y, width, height] in pixels of the window."""
    x0, x1 = F.array_min(F.transform(rows, lambda r: r["c0"])), F.array_max(F.transform(rows, lambda r: r["c1"]))
    y0, y1 = F.array_min(F.transform(rows, lambda r: r["row"])), F.array_max(F.transform(rows, lambda r: r["row"]))
    return F.array(x0, y0, x1 - x0 + 1, y1 - y0 + 1)


def run_lists(values: pa.Array, width: int, height: int):
    """Run lengths of every mask of an Arrow list array of struct<row, c0, c1>."""
    ends = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(values), 0).to_numpy(zero_copy_only=False))])
    flat = values.flatten()
    row, c0, c1 = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    for a, b in zip(ends, ends[1:], strict=False):
        yield counts_of(row[a:b], c0[a:b], c1[a:b], height, width)


def rle_counts(rows: Column, width: int, height: int) -> Column:
    """Run lengths of a mask of the window."""

    def encode(values: pa.Array) -> pa.Array:
        return pa.array(list(run_lists(values, width, height)), pa.list_(pa.int32()))

    return arrow_scalar(encode, "array<int>")(rows)


def segmentation(rows: Column, width: int, height: int) -> Column:
    """struct<size, counts> of a mask of the window."""

    def encode(values: pa.Array) -> pa.Array:
        return pa.array([to_string(c) for c in run_lists(values, width, height)], pa.string())

    return F.struct(F.array(F.lit(height), F.lit(width)).alias("size"), arrow_scalar(encode, "string")(rows).alias("counts"))
