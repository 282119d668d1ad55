"""Labels, categories, windows, masks and rasters.

Circles, category names and ids, quantiles and window sizes in these tests are fixed values: results have to match for them.
"""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.functions.geometry import bounds, with_edges
from tessera.operators import categories, labels, masks, raster, windows
from tessera.plans.scenes import SCENE
from tessera.schemas import GEOMETRY

LABEL = f"label_ord bigint, geometry {GEOMETRY}, is_multi boolean"


def circle(x, y, r, n=64):
    points = [{"x": x + r * np.cos(2 * np.pi * k / n), "y": y + r * np.sin(2 * np.pi * k / n)} for k in range(n)]
    return [[[{k: float(v) for k, v in p.items()} for p in [*points, points[0]]]]]


def frame(spark, shapes, **columns):
    kinds = {int: "bigint", str: "string", float: "double"}
    names = "".join(f", {k} {kinds[type(next(x for x in v if x is not None))]}" for k, v in columns.items())
    rows = [(i, g, False, *(v[i] for v in columns.values())) for i, g in enumerate(shapes)]
    return spark.createDataFrame(rows, LABEL + names)


@pytest.fixture(scope="module")
def shapes():
    return [circle(c, -c, r) for c, r in ((10, 1), (30, 2), (50, 3), (70, 4), (90, 1))]


def test_ids_are_coerced_and_input_stays(spark, shapes):
    given = frame(spark, shapes, cid=[1.0, 2.0, 2.0, 5.0, 5.0])
    out = labels.validate(given, "cid")
    assert dict(out.dtypes)["cid"] == "bigint" and dict(given.dtypes)["cid"] == "double"


@pytest.mark.parametrize("column, attributes, rule", [
    ({"cid": [0, 1, 2, 3, 4]}, ("cid", None, None), "bad_id"), ({"cid": [None, 1, 2, 3, 4]}, ("cid", None, None), "bad_id"), ({"cid": ["one", "2", "3", "4", "5"]}, ("cid", None, None), "bad_id"),
    ({"cname": [1, 2, 3, 4, 5]}, (None, "cname", None), "bad_name"), ({"cname": ["a", None, "b", "c", "d"]}, (None, "cname", None), "bad_name"),
    ({"cid": [1, 2, 3, 4, 5], "sup": [None, "a", "b", "c", "d"]}, ("cid", None, "sup"), "bad_super"),
])
def test_broken_labels(spark, shapes, column, attributes, rule):
    with pytest.raises(labels.LabelError, match=rule):
        labels.validate(frame(spark, shapes, **column), *attributes)


def test_label_contract(spark, shapes):
    with pytest.raises(AttributeError):
        labels.validate(frame(spark, shapes), "cid", "cname")
    with pytest.raises(labels.LabelError, match="geometry"):
        labels.validate(spark.range(3).toDF("cid"), "cid")
    with pytest.raises(labels.LabelError, match="null_geometry"):
        labels.validate(frame(spark, [None, *shapes[1:]], cid=[1, 2, 3, 4, 5]), "cid")
    bow = [[[{"x": float(x), "y": float(y)} for x, y in ((0, 0), (2, 0), (1, 1), (1, -1), (0, 0))]]]
    with pytest.raises(labels.LabelError, match="invalid_geometry"):
        labels.validate(frame(spark, [bow, *shapes[1:]], cid=[1, 2, 3, 4, 5]), "cid")
    assert labels.validate(frame(spark, shapes, cname=["a"] * 5), "cid", "cname").count() == 5


CATEGORY = "id bigint, name string, supercategory string"


@pytest.fixture(scope="module")
def existing(spark):
    return spark.createDataFrame([(1, "One", "1"), (2, "Two", "1"), (5, "Five", "1")], CATEGORY)


def fresh(df):
    return sorted(tuple(r) for r in df.collect())


def test_new_categories(spark, shapes, existing):
    table = frame(spark, shapes, cid=[1, 8, 2, 5, 5], cname=["One", "Eight", "Two", "Five", "Five"], sup=["A", "A", "A", "B", "B"])
    none = spark.createDataFrame([], CATEGORY)
    new = categories.new_categories
    assert fresh(new(existing, table, "cid", "cname")) == [(8, "Eight", "1")]
    assert fresh(new(existing, table, None, "cname")) == [(6, "Eight", "1")]
    assert fresh(new(existing, table, "cid")) == [(8, "8", "1")]
    assert fresh(new(none, table, "cid", "cname", "sup")) == [(1, "One", "A"), (2, "Two", "A"), (5, "Five", "B"), (8, "Eight", "A")]
    assert fresh(new(none, table, None, "cname")) == [(1, "Eight", "1"), (2, "Five", "1"), (3, "One", "1"), (4, "Two", "1")]
    assert fresh(new(existing, table.filter("cid <> 8"), "cid")) == []
    some = table.filter("cname IN ('One', 'Eight')")
    assert fresh(new(existing, some, None, "cname")) == [(2, "Eight", "1")]
    assert fresh(new(existing, some, None, "cname", id_policy="safe")) == [(6, "Eight", "1")]
    assert categories.add_categories(existing, table, id_attribute="cid").count() == 4
    with pytest.raises(AttributeError):
        new(existing, table, "nope", "neither")


def test_labels_meet_their_category(spark, shapes, existing):
    table = frame(spark, shapes, cid=[1, 2, 2, 5, 5], name=["x"] * 5)
    rows = labels.join_categories(table, existing, "cid").sort("label_ord").collect()
    assert [(r["id"], r["name"]) for r in rows] == [(1, "One"), (2, "Two"), (2, "Two"), (5, "Five"), (5, "Five")]
    by_name = labels.join_categories(frame(spark, shapes, cname=["One", "Two", "Two", "Five", "Five"]), existing, None, "cname")
    assert sorted(r["id"] for r in by_name.collect()) == [1, 2, 2, 5, 5]
    with pytest.raises(Exception, match="0 categories"):
        labels.join_categories(frame(spark, shapes, cid=[1, 2, 2, 5, 77]), existing, "cid").collect()
    twice = existing.unionByName(existing.filter("id = 1"))
    with pytest.raises(Exception, match="2 categories"):
        labels.join_categories(table, twice, "cid").collect()


def test_quantiles(spark, shapes):
    b = bounds(F.col("geometry"))
    for q, want in ((0.1, 2), (0.5, 4), (0.6, 4.8), (0.8, 6.4), (0.9, 7.2)):
        assert labels.average_bounds(frame(spark, shapes), b, q) == pytest.approx((want, want))


def test_window_schema():
    s = windows.WindowSchema(100, 120, 20, 30)
    assert (s.width_step, s.height_step) == (60, 60)
    for bad in ((0, 20, 1, 1), (100, 100, -20, 1), (100, 100, 50, 1), ("100", 100, 20, 20), (100, 100, 20, "20")):
        with pytest.raises(ValueError):
            windows.WindowSchema(*bad)
    assert windows.estimate_schema((6.4, 6.4), (1, 1), [(15, 15)]).width_overlap == 7
    assert windows.estimate_schema((7.2, 7.2), (1, 1), [(8, 8), (256, 256)]).width_step == 240
    with pytest.raises(ValueError, match="none of"):
        windows.estimate_schema((6.4, 6.4), (1, 1), [(14, 14)])


def test_parent_window():
    assert windows.parent_window((0, -256, 256, 0), (9, -91, 91, -9), (1, 0, 0, 0, -1, 0)) == (9, 9, 82, 82)
    with pytest.raises(ValueError, match="overlap"):
        windows.parent_window((0, -256, 256, 0), (509, -591, 591, -509), (1, 0, 0, 0, -1, 0))
    with pytest.raises(ValueError, match="CRS"):
        windows.require_same_crs(4326, 3857)


@pytest.mark.parametrize("parent", [(0, 0, 256, 256), (0, 0, 256, 120), (100, 100, 256, 256), (0, 0, 50, 50), (9.5, 3.25, 500, 700)])
def test_grids_equal_numpy(spark, parent):
    s = windows.WindowSchema(100, 100, 10, 10)
    cols = np.arange(max(0, parent[0] - 10), parent[2] + parent[0] - 10, 80)
    rows = np.arange(max(0, parent[1] - 10), parent[3] + parent[1] - 10, 80)
    want = [(int(c), int(r)) for c in cols for r in rows]
    got = windows.window_rows(spark, windows.grid_of(parent, s)).sort("window_ord").collect()
    assert [(r["col_off"], r["row_off"]) for r in got] == want


def test_grid_may_be_empty(spark):
    s = windows.WindowSchema(100, 100, 10, 10)
    assert windows.window_rows(spark, windows.grid_of((0, 0, 9, 9), s)).count() == 0
    assert windows.window_rows(spark, windows.grid_of((0, 0, 9, 9), s, ensure_cover=True)).count() == 1


def clipped_area(ring, col, row):
    """Area of a ring within one pixel: the ring is cut at the pixel's four sides in turn."""
    points = [(p["x"], p["y"]) for p in ring[:-1]]
    for axis, at, keep in ((0, col, 1), (0, col + 1, -1), (1, row, 1), (1, row + 1, -1)):
        out = []
        for p, q in zip(points, points[1:] + points[:1]):
            inside, next_inside = keep * (p[axis] - at) >= 0, keep * (q[axis] - at) >= 0
            if inside:
                out.append(p)
            if inside != next_inside:
                t = (at - p[axis]) / (q[axis] - p[axis])
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        points = out
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, points[1:] + points[:1]))) / 2 if points else 0


def brute_mask(parts, height, width):
    """Pixels in which shells less holes have a positive area."""
    area = lambda r, c: sum(clipped_area(p[0], c, r) - sum(clipped_area(h, c, r) for h in p[1:]) for p in parts)
    return np.array([[area(r, c) > 1e-12 for c in range(width)] for r in range(height)])


def test_masks_equal_brute_force(spark):
    rng = np.random.default_rng(4)

    def ring(*xy):
        return [{"x": float(x), "y": float(y)} for x, y in xy]

    shapes = [
        [[ring((2, 2), (7, 2), (7, 5), (2, 5), (2, 2))]],
        [[ring((1.5, 1.25), (9.5, 1.25), (9.5, 9.5), (5, 3), (1.5, 9.5), (1.5, 1.25))]],
        [[ring((1, 1), (11, 1), (11, 11), (1, 11), (1, 1)), ring((3, 3), (3, 8), (8, 8), (8, 3), (3, 3))]],
        [[ring((1, 1), (3, 1), (3, 3), (1, 1))], [ring((5.5, 5.5), (8, 5.5), (8, 8), (5.5, 5.5))]],
        [[ring((2.25, 4.25), (2.75, 4.25), (2.75, 4.75), (2.25, 4.25))]],
    ]
    for _ in range(8):
        angles = np.sort(rng.random(7)) * 2 * np.pi
        xy = [(round(8 * (6 + r * np.cos(a))) / 8, round(8 * (6 + r * np.sin(a))) / 8) for a, r in zip(angles, 2 + 3 * rng.random(7))]
        shapes.append([[ring(*xy, xy[0])]])
    table = with_edges(frame(spark, shapes), (1.0, 0, 0, 0, 1.0, 0))
    got = {i: np.zeros((12, 12), bool) for i in range(len(shapes))}
    for r in masks.row_intervals(table).collect():
        for a, b in r["runs"]:
            assert not got[r["label_ord"]][r["row"], a : b + 1].any()
            got[r["label_ord"]][r["row"], a : b + 1] = True
    for i, parts in enumerate(shapes):
        assert (got[i] == brute_mask(parts, 12, 12)).all(), i


def test_labels_far_beyond_the_raster(spark):
    """Rows outside the raster are never made, and those inside are as without the limit."""
    huge = [[[{"x": float(x), "y": float(y)} for x, y in ((-1e9, -1e9), (1e9, -1e9), (3.5, 1e9), (-1e9, -1e9))]]]
    table = with_edges(frame(spark, [huge, circle(10, 10, 6)]), (1.0, 0, 0, 0, 1.0, 0))
    rows = {r["label_ord"]: r["r"] for r in table.select("label_ord", masks.label_rows(F.col("edges"), 12).alias("r")).collect()}
    assert [x["row"] for x in rows[0]] == list(range(12)) and all(x["runs"][0]["c0"] < 0 and x["runs"][0]["c1"] > 1e8 for x in rows[0])
    whole = {r["row"]: r["runs"] for r in masks.row_intervals(table.filter("label_ord = 1")).collect()}
    assert {x["row"]: x["runs"] for x in rows[1]} == {k: v for k, v in whole.items() if k < 12}


def test_invalid_pixels_are_cut(spark):
    rows = spark.createDataFrame([(1, 0, [(0, 9)]), (1, 1, [(2, 3), (5, 8)])], "label_ord bigint, row int, runs array<struct<c0:int,c1:int>>")
    holes = spark.createDataFrame([(0, [(2, 3), (9, 12)]), (1, [(0, 3), (6, 6)])], "row int, runs array<struct<c0:int,c1:int>>")
    got = {r["row"]: [tuple(x) for x in r["runs"]] for r in masks.cut_invalid(rows, holes).collect()}
    assert got == {0: [(0, 1), (4, 8)], 1: [(5, 5), (7, 8)]}


def test_reshape_and_padding(spark):
    cube = spark.createDataFrame([(b, r, [float(10 * b + r)] * 4) for b in range(3) for r in range(4)], "band int, row int, cols array<double>")
    out = {(r["band"], r["row"]): r["cols"] for r in raster.reshape_pixels(cube, 4, 6, 5, -9.0).collect()}
    assert len(out) == 24 and out[1, 2] == [12.0] * 4 + [-9.0] and out[3, 0] == [-9.0] * 5 and out[0, 5] == [-9.0] * 5
    small = raster.reshape_pixels(cube, 1, 2, 3).collect()
    assert len(small) == 2 and all(len(r["cols"]) == 3 for r in small)


def test_normalise(spark):
    tiles = spark.createDataFrame([(1, 0, 0, [0.0, 5.0]), (1, 1, 0, [10.0, 2.5]), (2, 0, 0, [7.0, 7.0])], "window_ord bigint, band int, row int, cols array<double>")
    got = {(r["window_ord"], r["band"]): r["cols"] for r in raster.normalise(tiles).collect()}
    assert got[1, 0] == [0, 128] and got[1, 1] == [255, 64] and got[2, 0] == [0, 0]


def test_capture_dates(spark):
    tags = ["2022-03-12 13:45:00", "2022:03:12 13:45:00", "2023-09-21T00:50:10.131719", "not a date", None]
    df = spark.createDataFrame([(t,) for t in tags], "tag string").select(raster.capture_date(F.col("tag"), F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")).alias("d"))
    assert [str(r["d"]) for r in df.collect()] == ["2022-03-12 13:45:00"] * 2 + ["2023-09-21 00:50:10.131719"] + ["2001-01-01 00:00:00"] * 2


def test_dates_in_free_form(spark):
    cases = {"Fri, 12 Mar 2022 13:45:00": "2022-03-12 13:45:00", "March 12, 2022": "2022-03-12 00:00:00", "12-Mar-2022": "2022-03-12 00:00:00", "2022/03/12 13:45:00": "2022-03-12 13:45:00", "20220312T134500": "2022-03-12 13:45:00", "3/12/2022 1:05": "2022-03-12 01:05:00", "12th March 2022": "2022-03-12 00:00:00", "12.3.2022": "2022-03-12 00:00:00"}
    df = spark.createDataFrame([(k,) for k in cases], "tag string").select("tag", raster.capture_date(F.col("tag"), F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")).alias("d"))
    assert {r["tag"]: str(r["d"]) for r in df.collect()} == cases


def test_within_counts_the_border(spark):
    from tessera.functions.geometry import box_geometry, within_polygon

    def ring(*xy):
        return [[[{"x": float(x), "y": float(y)} for x, y in (*xy, xy[0])]]]

    shapes = {"low corner": ring((500, -2500), (600, -2500), (600, -2400), (500, -2400)), "high corner": ring((2400, -600), (2500, -600), (2500, -500), (2400, -500)), "whole": ring((500, -2500), (2500, -2500), (2500, -500), (500, -500)), "out": ring((2400, -600), (2501, -600), (2501, -500), (2400, -500)), "around": ring((0, -3000), (3000, -3000), (3000, 0), (0, 0))}
    table = frame(spark, list(shapes.values()), name=list(shapes))
    got = {r["name"]: r["w"] for r in table.select("name", within_polygon(F.col("geometry"), box_geometry(500, -2500, 2500, -500)).alias("w")).collect()}
    assert got == {"low corner": True, "high corner": True, "whole": True, "out": False, "around": False}
    # A notch: an edge between two border points may leave the polygon in between.
    notch = F.from_json(F.lit('[[[{"x":0,"y":0},{"x":10,"y":0},{"x":10,"y":10},{"x":6,"y":10},{"x":5,"y":4},{"x":4,"y":10},{"x":0,"y":10},{"x":0,"y":0}]]]'), GEOMETRY)
    shapes = {"bridge": ring((0, 8), (10, 8), (10, 10), (0, 10)), "chord": ring((4, 10), (6, 10), (6, 2), (4, 2)), "below": ring((0, 0), (10, 0), (10, 4), (0, 4)), "side": ring((0, 0), (4, 0), (4, 10), (0, 10))}
    table = frame(spark, list(shapes.values()), name=list(shapes))
    got = {r["name"]: r["w"] for r in table.select("name", within_polygon(F.col("geometry"), notch).alias("w")).collect()}
    assert got == {"bridge": False, "chord": False, "below": True, "side": True}


def test_rings_of_many_vertices():
    from tessera.functions.geometry import valid_parts

    n = 50_000
    xy = [(1000 * np.cos(2 * np.pi * k / n) + 5 * np.cos(40 * np.pi * k / n), 1000 * np.sin(2 * np.pi * k / n)) for k in range(n)]
    good = [[[{"x": x, "y": y} for x, y in (*xy, xy[0])]]]
    assert valid_parts(good)
    xy[n // 2], xy[n // 2 + 7] = xy[n // 2 + 7], xy[n // 2]
    assert not valid_parts([[[{"x": x, "y": y} for x, y in (*xy, xy[0])]]])


def test_quantiles_of_many_labels(spark):
    rng = np.random.default_rng(6)
    for values in (rng.normal(50, 9, 5000), rng.integers(0, 3, 5000).astype(float), np.concatenate([np.full(4000, 7.0), rng.random(1000) * 1e6]), np.array([4.0, float("nan"), 1.0])):
        table = spark.createDataFrame([(float(v),) for v in values], "v double").unionByName(spark.createDataFrame([(None,)], "v double"))
        kept = values[~np.isnan(values)]
        for q in (0.0, 0.1, 0.5, 0.9, 1.0):
            assert labels.exact_quantile(table, q, most=50) == pytest.approx(np.quantile(kept, q))


def test_tiles_from_blocks(spark):
    rng = np.random.default_rng(7)
    cube = rng.random((2, 30, 37))
    pixels = spark.createDataFrame([(b, r, cube[b, r].tolist()) for b in range(2) for r in range(30)], "band int, row int, cols array<double>")
    boxes = [(0, 0, 0, 12, 10), (1, 30, 25, 12, 10), (2, -3, -4, 12, 10), (3, 8, 3, 1, 2), (4, 40, 5, 6, 3)]
    rows = raster.tile_rows(pixels, spark.createDataFrame(boxes, "window_ord bigint, col_off int, row_off int, width int, height int"), -1.0, size=8).collect()
    assert len(rows) == sum(2 * b[4] for b in boxes)
    padded = np.pad(cube, ((0, 0), (20, 20), (20, 20)), constant_values=-1.0)
    for r in rows:
        _, c, t, w, _ = boxes[r["window_ord"]]
        assert r["cols"] == padded[r["band"], 20 + t + r["row"], 20 + c : 20 + c + w].tolist()


def test_runs_without_data(spark):
    cube = np.array([[[0, 0, 5, 0], [0, 1, 1, 1], [2, 2, 2, 2]], [[0, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0]]], float)
    pixels = spark.createDataFrame([(b, r, cube[b, r].tolist()) for b in range(2) for r in range(3)], "band int, row int, cols array<double>")
    got = {r["row"]: [tuple(x) for x in r["runs"]] for r in raster.invalid_runs(pixels, 0.0).collect()}
    assert got == {0: [(0, 1), (3, 3)], 1: [(0, 0)]}


def test_spatial_join_has_no_nested_loop(spark, sf_dir):
    from tessera.plans.queries import touching

    plan = touching(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Exchange" not in plan
    assert SCENE.width == 4096


def test_labels_of_one_piece_are_dealt(spark):
    rows = spark.range(0, 1000, 1, 1)
    spread = labels.dealt(rows, "id", 100)
    assert spread.rdd.getNumPartitions() == 10 and sorted(r[0] for r in spread.collect()) == list(range(1000))
    assert labels.dealt(rows, "id").rdd.getNumPartitions() == 1
    plan = spread.select((F.col("id") * 7 % 11).alias("v")).filter("v > 3")._jdf.queryExecution().optimizedPlan().toString()
    assert "% 11" in plan and "% 11" not in plan[plan.index("RepartitionByExpression") :]  # what is made of the rows comes after


def test_ids_by_group(spark):
    """Few windows with many rows: groups by window and category, offsets within and over buckets."""
    from tessera.operators.numbering import number_rows

    rng = np.random.default_rng(2)
    rows = [(int(w), int(c), k) for k, (w, c) in enumerate(zip(rng.integers(0, 5, 500), rng.integers(0, 4, 500), strict=True))]
    df = spark.createDataFrame(rows, "w bigint, c bigint, k bigint")
    out = number_rows(df, "n", F.floor(F.col("w") / 2), ["w", "c"], ["k"], 10).collect()
    assert [(r["w"], r["c"], r["k"]) for r in sorted(out, key=lambda r: r["n"])] == sorted(rows) and sorted(r["n"] for r in out) == list(range(11, 511))


@pytest.mark.parametrize("pieces", [2_000_000, 40])
def test_one_kernel_equals_its_steps(spark, monkeypatch, pieces):
    """Masks of labels in windows, code and all, as by windows, rows, cutting and encoding one after the other; rows that are
    known already are taken as they are; small pieces of work change nothing."""
    from tessera.functions import rle
    from tessera.operators import encoding

    rng = np.random.default_rng(6)
    some = [circle(*rng.uniform(0, 60, 2), rng.choice([0.2, 3, 9, 25]), 9) for _ in range(60)]
    far = [[[{"x": float(x), "y": float(y)} for x, y in ((-1e6, -1e6), (1e6, -1e6), (3.5, 1e6), (-1e6, -1e6))]]]
    shell, hole = circle(30, 30, 20)[0][0], circle(30, 30, 12)[0][0]
    some += [some[0] + some[1], circle(-50, -50, 3), far, [[shell, hole]], circle(16, 16, 4, 4), []]
    grid, size, transform = windows.Grid(-3.0, 1.5, 4, 5, windows.WindowSchema(20, 16, 2, 1)), (55, 58), (1.0, 0, 0, 0, 1.0, 0)
    table = frame(spark, some).select("label_ord", "geometry", (F.col("label_ord") % 5).alias("category_id"), F.lit(1).alias("iscrowd"))
    shaped = with_edges(table, transform).withColumn("rows", masks.label_rows(F.col("edges"), size[1]))
    cut = masks.window_masks(windows.label_windows(shaped, grid), 20, 16, size, ("category_id", "iscrowd")).collect()
    want = {(r["label_ord"], r["window_ord"]): r for r in cut}
    monkeypatch.setattr(encoding, "PIECES", pieces)
    for given in (table, shaped.select(*table.columns, "rows")):
        got = {}
        for batch in given.coalesce(1).toArrow().to_batches():
            for out in encoding.encode_batch(batch, transform, size, grid):
                for r in out.to_pylist():
                    assert got.setdefault((r["label_ord"], r["window_ord"]), r) is r
        assert got.keys() == want.keys() and len({k[0] for k in got}) > 50 and any(not r["area"] for r in got.values())
        for key, r in got.items():
            w, rows = want[key], [(x["row"], x["c0"], x["c1"]) for x in want[key]["rows"]]
            assert [r[c] for c in ("col_off", "row_off", "category_id", "iscrowd")] == [w[c] for c in ("col_off", "row_off", "category_id", "iscrowd")]
            assert r["area"] == sum(b - a + 1 for _, a, b in rows) and r["segmentation"]["size"] == [16, 20]
            assert r["segmentation"]["counts"] == rle.to_string(rle.counts_of(*(zip(*rows) if rows else ((),) * 3), 16, 20))
            top, left = min((x[0] for x in rows), default=0), min((x[1] for x in rows), default=0)
            assert r["bbox"] == ([left, top, max(x[2] for x in rows) - left + 1, max(x[0] for x in rows) - top + 1] if rows else [])
    assert encoding.encoded(table, transform, size, grid).count() == len(want)


def test_holes_go_to_the_labels(spark, monkeypatch):
    """Rows are not shuffled by scanline where holes are few, and those that meet no hole stay as they are; many holes, or only
    those in reach, give the same."""
    rng = np.random.default_rng(8)
    rows = [(k, int(r), [(int(a), int(a) + 3), (int(a) + 6, int(a) + 9)]) for k, (r, a) in enumerate(zip(rng.integers(0, 9, 200), rng.integers(0, 60, 200), strict=True))]
    holes = [(r, [(c, c + r) for c in range(3 * r, 40, 12)]) for r in range(0, 30, 2)]
    table = spark.createDataFrame(rows, "label_ord bigint, row int, runs array<struct<c0:int,c1:int>>")
    invalid = spark.createDataFrame(holes, "row int, runs array<struct<c0:int,c1:int>>")
    bad = {(r, c) for r, runs in holes for a, b in runs for c in range(a, b + 1)}
    want = {(k, r, c) for k, r, runs in rows for a, b in runs for c in range(a, b + 1) if (r, c) not in bad}

    def pixels(df):
        found = [(x["label_ord"], x["row"], c) for x in df.collect() for a, b in x["runs"] for c in range(a, b + 1)]
        assert len(found) == len(set(found))
        return set(found)

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = masks.cut_invalid(table, invalid)
        assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString() and pixels(few) == want
        assert pixels(masks.cut_invalid(table, invalid.limit(0))) == {(k, r, c) for k, r, runs in rows for a, b in runs for c in range(a, b + 1)}
        monkeypatch.setattr(masks, "BROADCAST_HOLES", 15)  # 16 holes in all, 14 of them in rows 0 to 8
        asked = []
        assert pixels(masks.cut_invalid(table, invalid, lambda: asked.append(1) or (0, 8))) == want and asked == [1]
        monkeypatch.setattr(masks, "BROADCAST_HOLES", 1)
        many = masks.cut_invalid(table, invalid)
        assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString() and pixels(many) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
