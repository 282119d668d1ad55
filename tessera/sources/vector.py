"""Vector label layers: GeoJSON, shapefiles, GeoPackages and Parquet, as label tables with a file-order number."""

from __future__ import annotations

import re
import sqlite3
import struct
from contextlib import closing

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import GEOMETRY

KINDS = {"C": "string", "N": "double", "F": "double", "L": "boolean", "D": "string"}


def geojson_srid(name: str | None) -> int:
    """The EPSG code of a crs member's name; GeoJSON without one is in longitude and latitude."""
    found = re.search(r"EPSG:+(\d+)", name or "")
    return int(found[1]) if found else 4326


def read_geojson(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(labels, srid) of a FeatureCollection of polygons; the properties become columns."""
    whole = spark.read.option("multiLine", True).option("inferTimestamp", False).json(path)
    if "features" not in whole.columns:
        raise ValueError(f"{path} is not a feature collection")
    crs = whole.select("crs.properties.name").first() if "crs" in whole.columns else None
    raw = spark.read.schema("features array<struct<geometry:string>>").option("multiLine", True).json(path)
    shapes = raw.select(F.posexplode("features").alias("label_ord", "f")).select("label_ord", F.col("f.geometry").alias("g"))
    kind = F.get_json_object("g", "$.type")
    text = F.get_json_object("g", "$.coordinates")
    ring = "array<array<double>>"
    single, multi = F.from_json(text, f"array<{ring}>"), F.from_json(text, f"array<array<{ring}>>")
    parts = F.when(kind == "Polygon", F.array(single)).when(kind == "MultiPolygon", multi).when(kind.isNotNull(), F.raise_error(F.concat(F.lit("only polygons are labels, not "), kind)))
    as_points = F.transform(parts, lambda part: F.transform(part, lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))))
    shapes = shapes.select("label_ord", as_points.cast(GEOMETRY).alias("geometry"), (kind == "MultiPolygon").alias("is_multi"))
    fields = whole.schema["features"].dataType.elementType
    if "properties" in fields.names and isinstance(fields["properties"].dataType, T.StructType):
        facts = whole.select(F.posexplode("features").alias("label_ord", "f")).select("label_ord", "f.properties.*")
        shapes = shapes.join(facts, "label_ord")
    return shapes.withColumn("label_ord", F.col("label_ord").cast("bigint")), geojson_srid(crs[0] if crs else None)


def shape_parts(body: bytes) -> tuple[list, bool] | None:
    """Parts of one polygon record: clockwise rings are shells, the others holes of the shell around them."""
    kind = struct.unpack_from("<i", body)[0]
    if kind == 0:
        return None
    if kind not in (5, 15, 25):
        raise ValueError(f"only polygons are labels, not shape type {kind}")
    n_parts, n_points = struct.unpack_from("<ii", body, 36)
    starts = [*struct.unpack_from(f"<{n_parts}i", body, 44), n_points]
    flat = struct.unpack_from(f"<{2 * n_points}d", body, 44 + 4 * n_parts)
    rings = [[(flat[2 * i], flat[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]
    area = lambda r: sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:], strict=False))

    def holds(shell, p):
        return sum((a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(shell, shell[1:], strict=False)) % 2 == 1

    parts = [[r] for r in rings if area(r) <= 0]
    for hole in (r for r in rings if area(r) > 0):
        owner = next((p for p in parts if holds(p[0], hole[0])), None)
        if owner is None:
            parts.append([hole])
        else:
            owner.append(hole)
    return [[[{"x": x, "y": y} for x, y in r] for r in p] for p in parts], len(parts) > 1


def shapes_of(data: bytes):
    at = 100
    while at + 8 <= len(data):
        size = struct.unpack_from(">i", data, at + 4)[0] * 2
        yield shape_parts(data[at + 8 : at + 8 + size])
        at += 8 + size


def dbf_fields(data: bytes) -> list[tuple[str, str, int, int]]:
    """(name, type letter, width, decimals)."""
    out, at = [], 32
    while data[at] != 0x0D:
        out.append((data[at : at + 11].split(b"\0")[0].decode("ascii"), chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    return out


def dbf_rows(data: bytes, encoding: str):
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields = dbf_fields(data)
    for i in range(n):
        at, row = head + i * size + 1, []
        for _, kind, width, _ in fields:
            text = data[at : at + width].decode(encoding, "replace").strip(" \0")
            at += width
            if kind in "NF":
                row.append(float(text) if text and "*" not in text else None)
            elif kind == "L":
                row.append({"T": True, "Y": True, "F": False, "N": False}.get(text.upper()))
            else:
                row.append(text or None)
        yield row


def read_shapefile(spark: SparkSession, path: str, encoding: str = "utf-8") -> tuple[DataFrame, int | None]:
    """(labels, srid) of a .shp with its .dbf (and .prj) beside it; whole-number fields become BIGINT."""
    base = path.removesuffix(".shp")
    head = spark.read.format("binaryFile").load(base + ".dbf").select("content").first()[0]
    fields = dbf_fields(bytes(head))
    names = [f[0] for f in fields]
    both = spark.read.format("binaryFile").load([base + ".shp", base + ".dbf"]).select("path", "content")
    shp = both.filter(F.lower("path").endswith(".shp")).select(F.col("content").alias("shp"), F.lit(1).alias("k"))
    dbf = both.filter(F.lower("path").endswith(".dbf")).select(F.col("content").alias("dbf"), F.lit(1).alias("k2"))
    pair = shp.join(dbf, F.col("k") == F.col("k2")).select("shp", "dbf")
    kinds = ["bigint" if k == "N" and not d else KINDS.get(k, "string") for _, k, _, d in fields]
    raw = [KINDS.get(k, "string") for _, k, _, _ in fields]
    schema = f"label_ord bigint, geometry {GEOMETRY}, is_multi boolean" + "".join(f", `{n}` {t}" for n, t in zip(names, raw, strict=True))
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    types = [pa.int64(), pa.list_(pa.list_(pa.list_(point))), pa.bool_(), *({"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[t] for t in raw)]

    def run(batches):
        for batch in batches:
            for shp, dbf in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, facts = [], dbf_rows(dbf, encoding)
                for i, (shape, fact) in enumerate(zip(shapes_of(shp), facts, strict=True)):
                    rows.append((i, *(shape or (None, None)), *fact))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["label_ord", "geometry", "is_multi", *names])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["label_ord", "geometry", "is_multi", *names])

    out = pair.mapInArrow(run, schema)
    for n, t in zip(names, kinds, strict=True):
        out = out.withColumn(n, F.col(n).cast(t))
    prj = spark.read.format("binaryFile").option("pathGlobFilter", base.rsplit("/", 1)[-1] + ".prj").load(base.rsplit("/", 1)[0] if "/" in base else ".").select("content").first()
    found = re.findall(r'AUTHORITY\["EPSG",\s*"?(\d+)"?\]', bytes(prj[0]).decode("latin-1")) if prj else []
    return out, int(found[-1]) if found else None


def wkb_rings(data: bytes, at: int, sizes: int, order: str) -> tuple[list, int]:
    """The rings of a WKB polygon body at `at`, as points, and where it ends; a point has `sizes` numbers."""
    n, at, rings = struct.unpack_from(f"{order}I", data, at)[0], at + 4, []
    for _ in range(n):
        k = struct.unpack_from(f"{order}I", data, at)[0]
        flat = struct.unpack_from(f"{order}{k * sizes}d", data, at + 4)
        rings.append([{"x": flat[i * sizes], "y": flat[i * sizes + 1]} for i in range(k)])
        at += 4 + 8 * k * sizes
    return rings, at


def wkb_parts(data: bytes, at: int = 0) -> tuple[list, bool]:
    """Parts of a WKB polygon or multipolygon, with or without further dimensions."""

    def head(at: int) -> tuple[int, int, str, int]:
        order = "<" if data[at] else ">"
        kind = struct.unpack_from(f"{order}I", data, at + 1)[0]
        flags, base = kind >> 29, (kind & 0x0FFFFFFF) % 1000
        more = (kind & 0x0FFFFFFF) // 1000
        sizes = 2 + (more in (1, 2)) + 2 * (more == 3) + bool(flags & 4) + bool(flags & 2)
        return base, sizes, order, at + 5 + 4 * bool(flags & 1)

    kind, sizes, order, at = head(at)
    if kind == 3:
        return [wkb_rings(data, at, sizes, order)[0]], False
    if kind != 6:
        raise ValueError(f"only polygons are labels, not geometry type {kind}")
    n, at, parts = struct.unpack_from(f"{order}I", data, at)[0], at + 4, []
    for _ in range(n):
        _, sizes, inner, at = head(at)
        rings, at = wkb_rings(data, at, sizes, inner)
        parts.append(rings)
    return parts, True


def package_geometry(blob: bytes | None) -> tuple[list | None, bool | None]:
    """A GeoPackage geometry: a header with an envelope of known size, then WKB."""
    if blob is None or blob[:2] != b"GP" or blob[3] & 16:
        return None, None
    envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(blob[3] >> 1) & 7]
    return wkb_parts(blob, 8 + envelope)


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None, rows: int = 50_000) -> tuple[DataFrame, int | None]:
    """(labels, srid) of a feature layer (the first one by default) of a GeoPackage that all executors can open.

    The layer is scanned by ranges of `rows` row ids, dealt over the cluster; label_ord is the row id.
    """
    own = path.removeprefix("file://")
    with closing(sqlite3.connect(f"file:{own}?mode=ro", uri=True)) as db:
        found = db.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY table_name").fetchall()
        names = [r[0] for r in found]
        if not names or layer not in (None, *names):
            raise ValueError(f"{path} has no feature layer {layer or ''}")
        layer = layer or names[0]
        shape, srs = db.execute("SELECT column_name, srs_id FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
        srid = db.execute("SELECT organization_coordsys_id FROM gpkg_spatial_ref_sys WHERE srs_id = ? AND lower(organization) = 'epsg'", (srs,)).fetchone()
        columns = [(r[1], r[2].upper()) for r in db.execute(f'PRAGMA table_info("{layer}")') if r[1] != shape and not r[5]]
        low, high = db.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{layer}"').fetchone()
    kinds = {n: "boolean" if t.startswith("BOOL") else "bigint" if "INT" in t else "double" if t.startswith(("REAL", "DOUBLE", "FLOAT")) else "string" for n, t in columns}
    arrow = {"boolean": pa.bool_(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    convert = {"boolean": bool, "bigint": int, "double": float, "string": str}
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    types = [pa.int64(), pa.list_(pa.list_(pa.list_(point))), pa.bool_(), *(arrow[k] for k in kinds.values())]
    out = ["label_ord", "geometry", "is_multi", *kinds]
    picks = ", ".join(f'"{c}"' for c in ("rowid", shape, *kinds)).replace('"rowid"', "rowid", 1)

    def run(batches):
        with closing(sqlite3.connect(f"file:{own}?mode=ro", uri=True)) as db:
            for batch in batches:
                for start in batch.column(0).to_pylist():
                    table = []
                    for fid, blob, *facts in db.execute(f'SELECT {picks} FROM "{layer}" WHERE rowid BETWEEN ? AND ? ORDER BY rowid', (start, start + rows - 1)):
                        table.append((fid, *package_geometry(blob), *(None if v is None else convert[k](v) for v, k in zip(facts, kinds.values(), strict=True))))
                    for at in range(0, len(table), 1000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*table[at : at + 1000], strict=True), types, strict=True)], names=out)

    ranges = spark.range(low, high + 1, rows)
    schema = f"label_ord bigint, geometry {GEOMETRY}, is_multi boolean" + "".join(f", `{n}` {k}" for n, k in kinds.items())
    return ranges.mapInArrow(run, schema), srid[0] if srid else None


def read_labels(spark: SparkSession, path: str) -> tuple[DataFrame, int | None]:
    """A label layer by its suffix: .geojson/.json, .shp, .gpkg, or Parquet with label_ord, geometry, is_multi (and maybe srid)."""
    low = path.lower().rstrip("/")
    if low.endswith((".geojson", ".json")):
        return read_geojson(spark, path)
    if low.endswith(".shp"):
        return read_shapefile(spark, path)
    if low.endswith(".gpkg"):
        return read_geopackage(spark, path)
    labels = spark.read.parquet(path)
    missing = {"label_ord", "geometry"} - set(labels.columns)
    if missing:
        raise ValueError(f"{path} lacks {sorted(missing)}")
    if "is_multi" not in labels.columns:
        labels = labels.withColumn("is_multi", F.size("geometry") > 1)
    srid = labels.select("srid").first() if "srid" in labels.columns else None
    return labels, srid[0] if srid else None
