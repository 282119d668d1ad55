"""Polygon functions as Spark expressions; only ring validity needs Python (Arrow batches)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import arrow_scalar


def points(geometry: Column) -> Column:
    return F.flatten(F.flatten(geometry))


def bounds(geometry: Column) -> Column:
    """struct<minx, miny, maxx, maxy>; null for a null or empty geometry."""
    p = points(geometry)
    xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
    box = F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))
    return F.when(F.size(p) > 0, box)


def edges(geometry: Column) -> Column:
    """array<struct<x1, y1, x2, y2>> of all rings of all parts."""

    def of_ring(ring: Column) -> Column:
        pairs = F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("a"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("b"))
        return F.transform(pairs, lambda e: F.struct(e["a"]["x"].alias("x1"), e["a"]["y"].alias("y1"), e["b"]["x"].alias("x2"), e["b"]["y"].alias("y2")))

    return F.flatten(F.transform(F.filter(F.flatten(geometry), lambda r: F.size(r) > 1), of_ring))


def to_pixels(geometry: Column, transform: tuple[float, ...]) -> Column:
    """The geometry in fractional (column, row) of a north-up raster with affine transform (a, b, c, d, e, f)."""
    a, b, c, d, e, f = transform
    if b or d:
        raise ValueError("rotated rasters are not supported")
    return F.transform(geometry, lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.struct(((p["x"] - c) / a).alias("x"), ((p["y"] - f) / e).alias("y")))))


def box_geometry(minx, miny, maxx, maxy) -> Column:
    """A rectangle as geometry; a box without extent the right way round is the caller's error."""
    corner = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    ring = F.array(corner(maxx, miny), corner(maxx, maxy), corner(minx, maxy), corner(minx, miny), corner(maxx, miny))
    return F.array(F.array(ring))


def meets_box(edge_list: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a polygon, given by its edges, shares a point with the closed box.

    Either an edge meets the box (their extents overlap and the box's corners are not all strictly on one side of the
    edge's line), or the whole box lies inside: then its first corner has an odd number of crossings.
    """

    def side(e: Column, x: Column, y: Column) -> Column:
        return F.signum((e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"]))

    def touches(e: Column) -> Column:
        overlap = (F.least(e["x1"], e["x2"]) <= x1) & (F.greatest(e["x1"], e["x2"]) >= x0) & (F.least(e["y1"], e["y2"]) <= y1) & (F.greatest(e["y1"], e["y2"]) >= y0)
        return overlap & (F.abs(side(e, x0, y0) + side(e, x1, y0) + side(e, x0, y1) + side(e, x1, y1)) < 4)

    def crosses(e: Column) -> Column:
        return ((e["y1"] > y0) != (e["y2"] > y0)) & (x0 < e["x1"] + (y0 - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"]))

    return F.exists(edge_list, touches) | (F.size(F.filter(edge_list, crosses)) % 2 == 1)


def within_box(geometry: Column, minx: float, miny: float, maxx: float, maxy: float) -> Column:
    """Whether all points lie in the closed box."""
    b = bounds(geometry)
    return (b["minx"] >= minx) & (b["miny"] >= miny) & (b["maxx"] <= maxx) & (b["maxy"] <= maxy)


def within_polygon(geometry: Column, polygon: Column) -> Column:
    """Whether no point of `geometry` lies outside `polygon`; points on its border are inside.

    No edge may cross the border properly, and the middle of every stretch of an edge between its ends and the border's
    corners that lie on it has to be inside (even-odd) or on the border.
    """
    rim = edges(polygon)

    def turn(ax, ay, bx, by, cx, cy) -> Column:
        return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))

    def on(r: Column, x: Column, y: Column) -> Column:
        between = (x >= F.least(r["x1"], r["x2"])) & (x <= F.greatest(r["x1"], r["x2"])) & (y >= F.least(r["y1"], r["y2"])) & (y <= F.greatest(r["y1"], r["y2"]))
        return between & (turn(r["x1"], r["y1"], r["x2"], r["y2"], x, y) == 0)

    def held(x: Column, y: Column) -> Column:
        hits = F.filter(rim, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])))
        return (F.size(hits) % 2 == 1) | F.exists(rim, lambda r: on(r, x, y))

    def crossing(e: Column, r: Column) -> Column:
        one = turn(e["x1"], e["y1"], e["x2"], e["y2"], r["x1"], r["y1"]) * turn(e["x1"], e["y1"], e["x2"], e["y2"], r["x2"], r["y2"])
        two = turn(r["x1"], r["y1"], r["x2"], r["y2"], e["x1"], e["y1"]) * turn(r["x1"], r["y1"], r["x2"], r["y2"], e["x2"], e["y2"])
        return (one < 0) & (two < 0)

    def stays(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        corners = F.filter(rim, lambda r: on(e, r["x1"], r["y1"]))
        at = F.transform(corners, lambda r: F.when(F.abs(dx) >= F.abs(dy), (r["x1"] - e["x1"]) / dx).otherwise((r["y1"] - e["y1"]) / dy))
        stops = F.sort_array(F.concat(F.array(F.lit(0.0).cast("double"), F.lit(1.0).cast("double")), at))
        pairs = F.arrays_zip(F.slice(stops, F.lit(1), F.size(stops) - 1).alias("a"), F.slice(stops, F.lit(2), F.size(stops) - 1).alias("b"))
        return F.forall(pairs, lambda p: held(e["x1"] + dx * (p["a"] + p["b"]) / 2, e["y1"] + dy * (p["a"] + p["b"]) / 2))

    inside = F.forall(points(geometry), lambda p: held(p["x"], p["y"]))
    own = F.filter(edges(geometry), lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))
    return inside & ~F.exists(own, lambda e: F.exists(rim, lambda r: crossing(e, r))) & F.forall(own, stays)


def valid_parts(parts) -> bool:
    """valid_polygon of nested lists of points."""
    if parts is None or any(part is None for part in parts):
        return False
    return valid_polygon([[np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2) if ring is not None else np.empty((0, 2)) for ring in part] for part in parts])


def valid_polygon(parts: list[list[np.ndarray]]) -> bool:
    """Whether rings are closed and simple, holes lie in their shells, and no two rings cross or overlap."""
    if not parts:
        return False
    shells = []
    for part in parts:
        if not part:
            return False
        rings = []
        for xy in part:
            if len(xy) < 4 or not np.isfinite(xy).all() or (xy[0] != xy[-1]).any():
                return False
            xy = xy[np.concatenate([[True], (np.diff(xy, axis=0) != 0).any(axis=1)])]
            if len(xy) < 4 or not simple_ring(xy):
                return False
            rings.append(xy)
        for i, hole in enumerate(rings[1:], 1):
            if crossing_rings(rings[0], hole) or not inside_ring(rings[0], hole) or any(crossing_rings(hole, other) or inside_ring(other, hole) or inside_ring(hole, other) for other in rings[1:i]):
                return False
        shells.append(rings)
    for i, one in enumerate(shells):
        for other in shells[:i]:
            if crossing_rings(one[0], other[0]):
                return False
            for a, b in ((one, other), (other, one)):
                if inside_ring(a[0], b[0]) and not any(inside_ring(h, b[0]) for h in a[1:]):
                    return False
    return True


def orientation(a, b, c):
    return np.sign((b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0]))


#: Pairs of edges that are compared at a time.
PAIRS = 1 << 20


def near_pairs(one: np.ndarray, two: np.ndarray):
    """(i, j) of edges of `one` and `two` whose extents meet, some PAIRS at a time: a sweep along x, then a test of y."""
    n1, n2 = len(one) - 1, len(two) - 1
    if n1 * n2 <= 4096:  # so few that the sweep would cost more than it saves
        yield np.divmod(np.arange(n1 * n2), n2)
        return
    lo1, hi1 = np.minimum(one[:-1], one[1:]), np.maximum(one[:-1], one[1:])
    lo2, hi2 = np.minimum(two[:-1], two[1:]), np.maximum(two[:-1], two[1:])
    order = np.argsort(lo2[:, 0], kind="stable")
    left = lo2[order, 0]
    widest = (hi2[:, 0] - lo2[:, 0]).max()
    # Edges of `two` that begin too far left to reach an edge of `one`, or right of it, are left out by binary search.
    begin, end = np.searchsorted(left, lo1[:, 0] - widest, side="left"), np.searchsorted(left, hi1[:, 0], side="right")
    n, start = end - begin, 0
    total = np.concatenate([[0], np.cumsum(n)])
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(total, total[start] + PAIRS, side="right")) - 1)
        size = n[start:stop]
        i = np.repeat(np.arange(start, stop), size)
        j = order[np.repeat(begin[start:stop] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        meet = (lo1[i] <= hi2[j]).all(axis=1) & (hi1[i] >= lo2[j]).all(axis=1)
        yield i[meet], j[meet]
        start = stop


def meeting(a, b, c, d) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For edges ab and cd: whether they cross properly, whether they overlap along a line, whether c lies strictly inside ab."""
    proper = (orientation(a, b, c) * orientation(a, b, d) < 0) & (orientation(c, d, a) * orientation(c, d, b) < 0)
    flat = (orientation(a, b, c) == 0) & (orientation(a, b, d) == 0)
    axis = (np.abs(b - a)[:, 0] < np.abs(b - a)[:, 1]).astype(int)
    pick = lambda p: np.take_along_axis(p, axis[:, None], axis=1)[:, 0]
    low = np.maximum(np.minimum(pick(a), pick(b)), np.minimum(pick(c), pick(d)))
    high = np.minimum(np.maximum(pick(a), pick(b)), np.maximum(pick(c), pick(d)))
    dot = ((c - a) * (b - a)).sum(axis=1)
    return proper, flat & (high > low), (orientation(a, b, c) == 0) & (dot > 0) & (dot < ((b - a) ** 2).sum(axis=1))


def simple_ring(xy: np.ndarray) -> bool:
    if len(np.unique(xy[:-1], axis=0)) != len(xy) - 1:
        return False
    for i, j in near_pairs(xy, xy):
        i, j = i[i != j], j[i != j]
        if any(found.any() for found in meeting(xy[i], xy[i + 1], xy[j], xy[j + 1])):
            return False
    return True


def crossing_rings(one: np.ndarray, two: np.ndarray) -> bool:
    for i, j in near_pairs(one, two):
        proper, overlap, _ = meeting(one[i], one[i + 1], two[j], two[j + 1])
        if proper.any() or overlap.any():
            return True
    return False


def inside_ring(shell: np.ndarray, ring: np.ndarray) -> bool:
    """Whether the ring lies inside, judged by its vertices that are not on the shell's border (even-odd)."""
    border = (ring[:-1, None] == shell[None, :-1]).all(axis=-1).any(axis=1) if len(ring) * len(shell) <= PAIRS else np.array([(p == shell[:-1]).all(axis=1).any() for p in ring[:-1]])
    for i, j in near_pairs(shell, ring):
        border[j[meeting(shell[i], shell[i + 1], ring[j], ring[j + 1])[2]]] = True
    a, b = shell[:-1], shell[1:]
    for p in ring[:-1][~border]:
        over = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
        u, v = a[over], b[over]
        if (p[0] < u[:, 0] + (p[1] - u[:, 1]) * (v[:, 0] - u[:, 0]) / (v[:, 1] - u[:, 1])).sum() % 2 == 0:
            return False
    return True


#: Points of a ring up to which all pairs of its edges are compared, for many rings at a time.
SHORT_RING = 12


def short_rings_valid(xy: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per ring (points starts .. starts + sizes - 1 of `xy`): 1 if it is closed and simple, 0 if not, -1 if it is not judged
    here: rings of many points or points in a row that are equal, and values that are not finite.
    """
    out = np.full(len(starts), -1, np.int8)
    out[sizes < 4] = 0
    for m in range(4, SHORT_RING + 1):
        i, j = (v.ravel() for v in np.divmod(np.arange((m - 1) ** 2), m - 1))
        i, j = i[i != j], j[i != j]
        rings = np.flatnonzero(sizes == m)
        step = max(1, PAIRS // len(i))
        for at in (rings[k : k + step] for k in range(0, len(rings), step)):
            p = xy[starts[at][:, None] + np.arange(m)]
            judged = np.isfinite(p).all(axis=(1, 2)) & (np.diff(p, axis=1) != 0).any(axis=2).all(axis=1)
            at, p = at[judged], p[judged]
            good = (p[:, 0] == p[:, -1]).all(axis=1) & ~(p[:, i] == p[:, j]).all(axis=2).any(axis=1)
            a, b, c, d = (p[:, k].reshape(-1, 2) for k in (i, i + 1, j, j + 1))
            for found in meeting(a, b, c, d) if len(a) else ():
                good &= ~found.reshape(len(at), -1).any(axis=1)
            out[at] = good
    return out


def validity(values: pa.Array) -> pa.Array:
    """Whether polygons are valid; false for null.

    Single rings, and two single rings whose extents do not touch, are judged for the whole batch at once where they are
    short; all others one by one.
    """
    parts, rings, points = values.values, values.values.values, values.values.values.values
    xy = np.stack([points.field(k).to_numpy(zero_copy_only=False) for k in ("x", "y")], axis=1)
    of_value, of_part, of_ring = (x.offsets.to_numpy() for x in (values, parts, rings))
    known, part_known, ring_known = (x.is_valid().to_numpy(zero_copy_only=False) for x in (values, parts, rings))

    def ring(k: int) -> np.ndarray:
        return xy[of_ring[k] : of_ring[k + 1]] if ring_known[k] else xy[:0]

    def one(i: int) -> bool:
        own = range(of_value[i], of_value[i + 1])
        return bool(known[i]) and all(part_known[p] for p in own) and valid_polygon([[ring(k) for k in range(of_part[p], of_part[p + 1])] for p in own])

    good = short_rings_valid(xy, of_ring[:-1].astype(np.int64), np.diff(of_ring).astype(np.int64)) if len(rings) else np.empty(0, np.int8)
    plain = part_known & (np.diff(of_part) == 1)
    out = np.full(len(values), -1, np.int8)
    out[~known] = 0
    n_parts = np.diff(of_value)
    for n in (1, 2):
        at = np.flatnonzero(known & (n_parts == n))
        at = at[np.all([plain[of_value[at] + k] for k in range(n)], axis=0)]
        own = [of_part[of_value[at] + k] for k in range(n)]
        sure = np.all([ring_known[r] & (good[r] >= 0) for r in own], axis=0)
        at, own = at[sure], [r[sure] for r in own]
        every = np.all([good[r] == 1 for r in own], axis=0)
        if n == 2:
            # Both are simple: where their extents are apart, they are; else they are looked at one by one.
            lo, hi = zip(*(extents(xy, of_ring[r], of_ring[r + 1]) for r in own), strict=True)
            near = ~((lo[0] > hi[1]) | (lo[1] > hi[0])).any(axis=1) & every
            at, every = at[~near], every[~near]
        out[at] = every
    for i in np.flatnonzero(out < 0):
        out[i] = one(i)
    return pa.array(out == 1, pa.bool_())


def is_valid(geometry: Column) -> Column:
    """Whether a polygon is valid, by Arrow batches; false for null."""

    def check(values: pa.Array) -> pa.Array:
        return validity(values)

    return arrow_scalar(check, "boolean")(geometry)


def extents(xy: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest corner of the points starts .. ends - 1, one at least, of each of some rings."""
    n = ends - starts
    first = np.cumsum(n) - n
    p = xy[np.repeat(starts - first, n) + np.arange(n.sum())]
    return (np.minimum.reduceat(p, first), np.maximum.reduceat(p, first)) if len(n) else (p, p)


def with_edges(labels: DataFrame, transform: tuple[float, ...]) -> DataFrame:
    """`labels` with `edges` in pixel space and its extent mincol, minrow, maxcol, maxrow."""
    out = labels.withColumn("x_pix", to_pixels(F.col("geometry"), transform))
    box = bounds(F.col("x_pix"))
    out = out.withColumns({"edges": edges(F.col("x_pix")), "x_box": box})
    return out.withColumns({"mincol": F.col("x_box.minx"), "minrow": F.col("x_box.miny"), "maxcol": F.col("x_box.maxx"), "maxrow": F.col("x_box.maxy")}).drop("x_pix", "x_box")
