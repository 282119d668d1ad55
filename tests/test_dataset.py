"""Datasets end to end: append, versions, persistence, sources, command line, stream.

The scene, its labels and the version steps are fixed values: results have to match for them.
"""

import json
import struct
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.cli import main
from tessera.functions import rle
from tessera.operators.dataset import create_dataset, load_dataset, save_dataset, source_of, version_after
from tessera.plans.append import Raster, append_dataset
from tessera.sources import geotiff, tiles, vector
from tessera.streaming.appends import append_stream

from test_operators import circle, frame

WHEN = datetime(2024, 5, 6, 7, 8, 9)


@pytest.fixture(scope="module")
def scene(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("scene")
    cube = np.random.default_rng(0).integers(1, 256, (3, 256, 256)).astype(np.uint8)
    path = str(folder / "scene.tif")
    geotiff.write_geotiff(path, cube, (1.0, 0, 0.0, 0, -1.0, 0.0), 3857, 0.0, "2023-01-02 03:04:05")
    return path, cube


@pytest.fixture(scope="module")
def table(spark):
    shapes = [circle(c, -c, r) for c, r in ((10, 1), (30, 2), (50, 3), (70, 4), (90, 1))]
    return frame(spark, shapes, cid=[1, 2, 2, 5, 5], cname=["One", "Two", "Two", "Five", "Five"])


def test_append_twice(spark, scene, table, tmp_path):
    raster = geotiff.open_raster(spark, scene[0])
    assert raster.date_captured == datetime(2023, 1, 2, 3, 4, 5) and raster.srid == 3857
    out = str(tmp_path / "images")
    first = append_dataset(create_dataset(spark, "d", "c", "0.0.1", WHEN), out, raster, [(256, 256)], table, "cid", "cname", label_srid=3857, suffix="png")
    assert first.info["version"] == "1.0.0"
    rows = first.annotations.sort("id").collect()
    assert [r["id"] for r in rows] == [1, 2, 3, 4, 5] and [r["category_id"] for r in rows] == [1, 2, 2, 5, 5]
    assert [list(r["bbox"]) for r in rows] == [[8, 8, 2, 2], [27, 27, 4, 4], [46, 46, 6, 6], [65, 65, 8, 8], [88, 88, 2, 2]]
    assert [r["area"] for r in rows] == [4, 16, 36, 60, 4]
    for r in rows:
        mask = rle.to_mask(rle.from_string(r["segmentation"]["counts"]), *r["segmentation"]["size"])
        x, y, w, h = r["bbox"]
        assert mask.sum() == r["area"] and mask[y : y + h, x : x + w].sum() == r["area"]
    image = first.images.first()
    assert image["file_name"].endswith("/1_1_1_256_256.png")
    pixels = tiles.read_png(open(image["file_name"], "rb").read())
    assert (pixels[:255, :255] == scene[1][:, 1:, 1:].transpose(1, 2, 0)).all() and not pixels[255].any()

    path = str(tmp_path / "d.json")
    save_dataset(first, path)
    again = load_dataset(spark, path)
    assert again.info == first.info
    for name in first.tables:
        assert sorted(map(str, again.tables[name].collect())) == sorted(map(str, first.tables[name].collect())), name
    second = append_dataset(again, out, raster, [(256, 256)], table, "cid", "cname", label_srid=3857)
    assert second.info["version"] == "1.0.1" and second.count("annotations") == 10 and second.count("images") == 2 and second.count("sources") == 1
    assert second.annotations.filter("id <= 5").exceptAll(first.annotations).count() == 0
    third = append_dataset(second, str(tmp_path / "other"), raster, [(256, 256)], table.withColumn("cid", F.col("cid") + 10), "cid", label_srid=3857)
    assert third.info["version"] == "2.0.0" and third.count("categories") == 6
    document = json.load(open(path))
    assert list(document) == ["info", "images", "annotations", "categories", "sources"]
    assert list(document["annotations"][0]) == ["id", "image_id", "category_id", "segmentation", "area", "bbox", "iscrowd"]
    assert document["info"]["date_created"] == "2024-05-06T07:08:09" and document["sources"][0]["date_captured"] == "2023-01-02T03:04:05"


@pytest.mark.parametrize("dtype, nodata", [("uint16", 0.0), ("int16", -5.0), ("float32", -9999.0), ("uint8", 7.0)])
def test_masks_leave_out_pixels_without_data(spark, table, tmp_path, dtype, nodata):
    cube = (np.random.default_rng(2).random((2, 256, 256)) * 90 + 10).astype(dtype)
    cube[:, 48:53, 40:52] = nodata  # a part of the third label
    cube[0, 66:74, 66:74] = nodata  # one band only: these have data
    path = str(tmp_path / "x.tif")
    geotiff.write_geotiff(path, cube, (1.0, 0, 0.0, 0, -1.0, 0.0), 3857, nodata, tile=64)
    done = append_dataset(create_dataset(spark, "d", "c"), str(tmp_path / "i"), geotiff.open_raster(spark, path), [(256, 256)], table, "cid", label_srid=3857, write_tiles=False)
    rows = done.annotations.sort("id").collect()
    assert [r["area"] for r in rows] == [4, 16, 36 - 25, 60, 4]
    for r in rows:
        mask = rle.to_mask(rle.from_string(r["segmentation"]["counts"]), *r["segmentation"]["size"])
        assert not mask[47:52, 39:51].any()


def test_block_scan_reads_lines_of_blocks(spark, tmp_path):
    cube = (np.random.default_rng(3).random((2, 150, 90)) * 200).astype("uint16")
    path = str(tmp_path / "b.tif")
    geotiff.write_geotiff(path, cube, (1.0, 0, 0.0, 0, -1.0, 0.0), None, tile=32)
    pixels = geotiff.read_pixels(spark, path)
    assert pixels.rdd.getNumPartitions() > 1
    got = np.zeros_like(cube)
    for r in pixels.collect():
        got[r["band"], r["row"]] = r["cols"]
    assert (got == cube).all()


def test_saving_over_the_loaded_file(spark, scene, table, tmp_path):
    path = str(tmp_path / "d.json")
    save_dataset(create_dataset(spark, "d", "c"), path)
    raster = geotiff.open_raster(spark, scene[0], with_pixels=False)
    for k in (1, 2):
        dataset = append_dataset(load_dataset(spark, path), "/x", raster, [(256, 256)], table, "cid", label_srid=3857)
        save_dataset(dataset, path)
        assert dataset.count("annotations") == load_dataset(spark, path).count("annotations") == 5 * k


def test_geopackage(spark, tmp_path):
    import sqlite3

    def wkb(*rings):
        return struct.pack("<I", len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r) for r in rings)

    shell, hole = [(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(2, 2), (4, 2), (4, 4), (2, 2)]
    single = struct.pack("<BI", 1, 3) + wkb(shell, hole)
    multi = struct.pack("<BII", 1, 6, 2) + 2 * (struct.pack("<BI", 1, 3) + wkb(shell))
    db = sqlite3.connect(tmp_path / "l.gpkg")
    db.executescript("""CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT); CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, srs_id INT);
      CREATE TABLE gpkg_spatial_ref_sys (srs_id INT, organization TEXT, organization_coordsys_id INT); CREATE TABLE parcels (fid INTEGER PRIMARY KEY, geom BLOB, cid MEDIUMINT, cname TEXT, share REAL, ok BOOLEAN);
      INSERT INTO gpkg_contents VALUES ('parcels', 'features'); INSERT INTO gpkg_geometry_columns VALUES ('parcels', 'geom', 9); INSERT INTO gpkg_spatial_ref_sys VALUES (9, 'EPSG', 3857);""")
    for body, facts in ((single, (1, "One", 0.5, 1)), (multi, (2, None, None, 0))):
        blob = b"GP\0" + bytes([3]) + struct.pack("<i4d", 9, 0, 9, 0, 9) + body
        db.execute("INSERT INTO parcels (geom, cid, cname, share, ok) VALUES (?, ?, ?, ?, ?)", (blob, *facts))
    db.commit()
    db.close()
    labels, srid = vector.read_labels(spark, str(tmp_path / "l.gpkg"))
    rows = labels.sort("label_ord").collect()
    assert srid == 3857 and [(r["cid"], r["cname"], r["share"], r["ok"], r["is_multi"]) for r in rows] == [(1, "One", 0.5, True, False), (2, None, None, False, True)]
    assert [len(p) for p in rows[0]["geometry"]] == [2] and [len(p) for p in rows[1]["geometry"]] == [1, 1] and rows[0]["geometry"][0][1][1]["x"] == 4.0


def test_public_names():
    import tessera

    assert all(callable(getattr(tessera, n)) for n in tessera.__all__)


def test_many_windows_cover_every_label(spark, table):
    from tessera.plans.append import Raster

    plain = Raster("r", 256, 256, (1.0, 0, 0.0, 0, -1.0, 0.0), 3857)
    done = append_dataset(create_dataset(spark, "d", "c"), "/x", plain, [(32, 32)], table, "cid", label_srid=3857)
    best = done.annotations.groupBy("category_id").agg(F.max("area").alias("a")).collect()
    assert {r["category_id"]: r["a"] for r in best} == {1: 4, 2: 36, 5: 60}
    ids = [r["id"] for r in done.annotations.sort("image_id", "category_id", "id").collect()]
    assert ids == list(range(1, len(ids) + 1))
    with pytest.raises(ValueError, match="CRS"):
        append_dataset(done, "/x", plain, [(32, 32)], table, "cid", label_srid=4326)
    with pytest.raises(ValueError, match="none of"):
        append_dataset(done, "/x", plain, [(8, 8)], table, "cid", label_srid=3857)


def test_sources_and_versions(spark):
    from tessera.operators.dataset import Dataset

    empty = create_dataset(spark, "d", "c", "0.0.0", WHEN)
    assert version_after(empty, "a", "/dir") == ("1.0.0", 1, True)
    sources = spark.createDataFrame([(1, "a", WHEN)], "id bigint, file_name string, date_captured timestamp_ntz")
    images = spark.createDataFrame([(1, 1, 1, "/dir/x.png", 1, WHEN)], "id bigint, width int, height int, file_name string, source_id bigint, date_captured timestamp_ntz")
    used = Dataset(spark, empty.info | {"version": "1.0.0"}, {"sources": sources, "images": images})
    assert version_after(used, "a", "/dir") == ("1.0.1", 1, False)
    assert version_after(used, "b", "/dir") == ("1.1.0", 2, True)
    assert version_after(used, "b", "/new")[0] == "2.0.0"
    double = Dataset(spark, used.info, {"sources": sources.unionAll(sources)})
    with pytest.raises(ValueError, match="several"):
        source_of(double, "a")


def test_empty_dataset_round_trip(spark, tmp_path):
    path = str(tmp_path / "e.json")
    save_dataset(create_dataset(spark, 'say "hi" é', "c", date_created=WHEN), path)
    again = load_dataset(spark, path)
    assert again.info == {"version": "0.0.0", "year": 2024, "description": 'say "hi" é', "contributor": "c", "date_created": WHEN}
    assert all(again.count(t) == 0 for t in again.tables)
    open(tmp_path / "bad.json", "w").write('{"images": []}')
    with pytest.raises(ValueError, match="no info"):
        load_dataset(spark, str(tmp_path / "bad.json"))


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int16", "float32", "float64"])
@pytest.mark.parametrize("compress, tile", [(True, 0), (False, 0), (True, 32), (False, 16)])
def test_geotiff_round_trip(spark, tmp_path, dtype, compress, tile):
    cube = (np.random.default_rng(1).random((2, 70, 50)) * 200).astype(dtype)
    path = str(tmp_path / "x.tif")
    geotiff.write_geotiff(path, cube, (0.5, 0, 10.0, 0, -0.25, 20.0), 32631, -5.0, None, compress, tile)
    data = open(path, "rb").read()
    assert (geotiff.read_cube(data) == cube).all()
    assert geotiff.describe(data) == {"count": 2, "width": 50, "height": 70, "dtype": dtype, "nodata": -5.0, "srid": 32631, "transform": (0.5, 0, 10.0, 0, -0.25, 20.0), "tags": {}}


def test_tiff_codecs():
    assert geotiff.unpack_bits(bytes([2, 1, 2, 3, 254, 9, 128])) == b"\x01\x02\x03\x09\x09\x09"
    codes, bits = [256, 65, 66, 258, 65, 257], ""
    for c in codes:
        bits += format(c, "09b")
    bits = bits.ljust(-(-len(bits) // 8) * 8, "0")
    assert geotiff.unpack_lzw(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))) == b"ABABA"
    cells = np.array([[[1], [1], [2]]], np.uint8)
    assert geotiff.undo_predictor(cells, 2, b"", np.dtype("u1")).ravel().tolist() == [1, 2, 4]


def write_shapefile(base, shapes, names):
    body = b""
    for i, rings in enumerate(shapes, 1):
        points = [p for r in rings for p in r]
        starts = np.cumsum([0, *map(len, rings)])[:-1]
        xs, ys = zip(*points)
        record = struct.pack("<i4dii", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">ii", i, len(record) // 2) + record
    open(base + ".shp", "wb").write(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8) + body)
    rows = b"".join(b" " + f"{i:>5d}".encode() + n.encode().ljust(8) for i, n in enumerate(names, 1))
    fields = b"cid".ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([5, 0]) + b"\0" * 14 + b"cname".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([8, 0]) + b"\0" * 14
    open(base + ".dbf", "wb").write(struct.pack("<BBBBIHH20x", 3, 24, 1, 1, len(names), 32 + 64 + 1, 14) + fields + b"\r" + rows + b"\x1a")
    open(base + ".prj", "w").write('PROJCS["x",AUTHORITY["EPSG","3857"]]')


def test_shapefile(spark, tmp_path):
    shell, hole = [(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)], [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]
    write_shapefile(str(tmp_path / "l"), [[shell, hole], [shell, [(20, 0), (20, 3), (23, 3), (20, 0)]]], ["One", "Two"])
    labels, srid = vector.read_labels(spark, str(tmp_path / "l.shp"))
    rows = labels.sort("label_ord").collect()
    assert srid == 3857 and [(r["cid"], r["cname"], r["is_multi"]) for r in rows] == [(1, "One", False), (2, "Two", True)]
    assert [len(p) for p in rows[0]["geometry"]] == [2] and [len(p) for p in rows[1]["geometry"]] == [1, 1]
    assert dict(labels.dtypes)["cid"] == "bigint"


def geojson(path, crs=True):
    square = lambda x, y, s: [[x, -y], [x + s, -y], [x + s, -y - s], [x, -y - s], [x, -y]]
    features = [
        {"type": "Feature", "properties": {"cid": 1, "cname": "One"}, "geometry": {"type": "Polygon", "coordinates": [square(10, 10, 5)]}},
        {"type": "Feature", "properties": {"cid": 2, "cname": "Two"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square(40, 40, 5)], [square(50, 40, 3)]]}},
    ]
    layer = {"type": "FeatureCollection", "features": features}
    if crs:
        layer["crs"] = {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::3857"}}
    json.dump(layer, open(path, "w"))


def test_geojson(spark, tmp_path):
    geojson(tmp_path / "l.geojson")
    labels, srid = vector.read_labels(spark, str(tmp_path / "l.geojson"))
    rows = labels.sort("label_ord").collect()
    assert srid == 3857 and [r["is_multi"] for r in rows] == [False, True] and [r["cname"] for r in rows] == ["One", "Two"]
    geojson(tmp_path / "m.geojson", crs=False)
    assert vector.read_labels(spark, str(tmp_path / "m.geojson"))[1] == 4326
    labels.write.parquet(str(tmp_path / "p"))
    assert vector.read_labels(spark, str(tmp_path / "p"))[0].count() == 2
    json.dump({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"cid": 1}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}, open(tmp_path / "q.json", "w"))
    with pytest.raises(Exception, match="only polygons"):
        vector.read_labels(spark, str(tmp_path / "q.json"))[0].collect()


def test_command_line(spark, scene, tmp_path):
    answers = iter(["a set", "me", "", "new text", ""])
    path, other = str(tmp_path / "d.json"), str(tmp_path / "e.json")
    ask = lambda _: next(answers)
    main(["new", path], ask, spark)
    main(["copy", path, other], ask, spark)
    info = load_dataset(spark, other).info
    assert (info["version"], info["description"], info["contributor"]) == ("0.0.0", "new text", "me")
    main(["copy", path, other, "--no-update-meta"], ask, spark)
    assert load_dataset(spark, other).info["description"] == "a set"
    geojson(tmp_path / "l.geojson")
    (tmp_path / "out").mkdir()
    main(["add", scene[0], str(tmp_path / "l.geojson"), path, str(tmp_path / "out"), "64", "64", "--tile-format", "jpg", "--id-attribute", "cid", "--name_attribute", "cname"], ask, spark)
    done = load_dataset(spark, path)
    assert done.info["version"] == "1.0.0" and done.count("annotations") >= 2 and {r["iscrowd"] for r in done.annotations.collect()} == {0, 1}
    for r in done.images.collect():
        data = open(r["file_name"], "rb").read()
        assert r["file_name"].endswith(".jpg") and data[:2] == b"\xff\xd8" and data[-2:] == b"\xff\xd9"
    with pytest.raises(SystemExit):
        main(["add", str(tmp_path / "none.tif"), path, path, path, "64", "64"], ask, spark)


def test_stream_of_labels(spark, table, tmp_path):
    from tessera.plans.append import Raster

    path = str(tmp_path / "d.json")
    save_dataset(create_dataset(spark, "d", "c"), path)
    table.repartition(1).write.parquet(str(tmp_path / "labels"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "labels"))
    plain = Raster("r", 256, 256, (1.0, 0, 0.0, 0, -1.0, 0.0), 3857, date_captured=WHEN)
    query = append_stream(stream, path, "/x", plain, [(256, 256)], id_attribute="cid", label_srid=3857).start()
    query.processAllAvailable()
    query.stop()
    assert load_dataset(spark, path).count("annotations") == 5


def test_an_append_is_settled_once(spark, table):
    """What an append has counted and kept is not computed again by the next: no job for its sizes, no label for its
    categories."""
    raster = Raster("r", 256, 256, (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), 3857)
    done = create_dataset(spark, "d", "c")
    for folder in ("a", "b"):
        done = append_dataset(done, folder, raster, [(256, 256)], table, "cid", "cname", label_srid=3857)
    spark.sparkContext.setJobGroup("sizes", "")
    try:
        assert (done.count("images"), done.count("annotations")) == (2, 10)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("sizes")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert done.tables["images"].count() == 2 and sorted(r["id"] for r in done.annotations.collect()) == list(range(1, 11))
    assert "LocalTableScan" in done.categories._jdf.queryExecution().executedPlan().toString()
    done.tables["images"] = done.images.limit(1)  # a table that somebody changed is counted
    assert done.count("images") == 1
