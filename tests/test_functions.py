"""Geometry, run lengths and versions on their own.

Polygons, quantiles and version steps are fixed values: results have to match for them.
"""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tessera.functions import rle, versions
from tessera.functions.geometry import bounds, box_geometry, is_valid, short_rings_valid, valid_parts, validity, within_box


def ring(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in xy]


SQUARE = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))


@pytest.mark.parametrize(
    "parts, good",
    [
        ([[SQUARE]], True),
        ([[ring((0, 0), (2, 0), (1, 1), (1, -1), (0, 0))]], False),
        ([[ring((0, 0), (4, 0), (4, 4), (0, 4))]], False),
        ([[ring((0, 0), (4, 0), (0, 0))]], False),
        ([[SQUARE, ring((1, 1), (2, 1), (2, 2), (1, 2), (1, 1))]], True),
        ([[SQUARE, ring((3, 3), (6, 3), (6, 6), (3, 6), (3, 3))]], False),
        ([[SQUARE, ring((5, 5), (6, 5), (6, 6), (5, 5))]], False),
        ([[SQUARE], [ring((4, 4), (6, 4), (6, 6), (4, 4))]], True),
        ([[SQUARE], [ring((1, 1), (2, 1), (2, 2), (1, 1))]], False),
        ([[SQUARE], [ring((3, 1), (6, 1), (6, 2), (3, 1))]], False),
        ([[SQUARE, ring((1, 1), (3, 1), (3, 3), (1, 3), (1, 1))], [ring((1.5, 1.5), (2, 1.5), (2, 2), (1.5, 1.5))]], True),
        ([[ring((0, 0), (4, 0), (4, float("nan")), (0, 0))]], False),
        ([], False),
        (None, False),
    ],
)
def test_ring_validity(parts, good):
    assert valid_parts(parts) is good


def test_column_functions(spark):
    df = spark.range(1).select(box_geometry(0, -8, 4, -2).alias("g"))
    row = df.select(bounds(F.col("g")).alias("b"), is_valid(F.col("g")).alias("v"), within_box(F.col("g"), 0, -8, 4, -2).alias("w"), within_box(F.col("g"), 1, -8, 4, -2).alias("n")).first()
    assert tuple(row["b"]) == (0, -8, 4, -2) and row["v"] and row["w"] and not row["n"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 70000), min_size=1, max_size=40))
def test_rle_text_inverts(counts):
    assert rle.from_string(rle.to_string(counts)) == counts


def test_rle_of_a_rectangle():
    counts = rle.counts_of(list(range(2, 7)), [2] * 5, [9] * 5, 24, 24)
    assert counts == [50, *[5, 19] * 7, 5, 353] and rle.to_string(counts) == "b15c00000000000000^:"
    assert rle.to_mask(counts, 24, 24).sum() == 40


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**32 - 1))
def test_rle_counts_equal_masks(height, width, seed):
    mask = np.random.default_rng(seed).random((height, width)) < 0.5
    rows, first, last = [], [], []
    for r in range(height):
        c = 0
        while c < width:
            if mask[r, c]:
                d = c
                while d + 1 < width and mask[r, d + 1]:
                    d += 1
                rows.append(r)
                first.append(c)
                last.append(d)
                c = d
            c += 1
    counts = rle.counts_of(rows, first, last, height, width)
    assert sum(counts) == height * width and (rle.to_mask(counts, height, width) == mask).all()
    assert all(counts[1:])


def test_bumps():
    assert [versions.bump("1.2.3", m) for m in versions.METHODS] == ["1.2.4", "1.3.0", "2.0.0"]
    with pytest.raises(ValueError, match="semantic"):
        versions.bump("1.2", "nonsense")
    with pytest.raises(ValueError, match="method"):
        versions.bump("1.2.3", "nonsense")
    assert versions.next_version("0.0.0", True, False) == "0.1.0"
    assert versions.next_version("0.1.0", False, False) == "0.1.1"
    assert versions.next_version("0.1.1", False, True) == "1.0.0"


def test_batches_of_rings_are_judged_as_single_ones():
    """Short rings, pairs of parts, and all that is judged one by one, at once and each for itself."""
    rng = np.random.default_rng(5)

    def ring(size):
        points = [{"x": float(x), "y": float(y)} for x, y in rng.integers(0, size, (rng.integers(0, 14), 2))]
        return points + points[:1] if rng.random() < 0.9 else points

    def box(at):
        return [{"x": at + x, "y": at + y} for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0))]

    def part():
        return None if rng.random() < 0.02 else [box(float(rng.integers(0, 6)))] if rng.random() < 0.5 else [ring(rng.choice([3, 20])) for _ in range(rng.integers(0, 3))]

    values = [None if rng.random() < 0.03 else [part() for _ in range(rng.choice([0, 1, 1, 2, 2, 3]))] for _ in range(3000)]
    xy = np.array([(p["x"], p["y"]) for value in values for q in value or () for r in q or () for p in r])
    sizes = np.array([len(r) for value in values for q in value or () for r in q or ()])
    found = short_rings_valid(xy, np.cumsum(sizes) - sizes, sizes)
    rings = [r for value in values for q in value or () for r in q or ()]
    assert all(f == valid_parts([[r]]) for f, r in zip(found, rings, strict=True) if f >= 0) and (found == 1).sum() > 100 and (found == 0).sum() > 100
    kind = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
    got, want = validity(pa.array(values, kind)).to_pylist(), [valid_parts(v) for v in values]
    assert got == want and 300 < sum(want) < 2700
    assert validity(pa.array(values, kind).slice(11, 500)).to_pylist() == want[11:511]
