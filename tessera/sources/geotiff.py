"""GeoTIFF reader and writer: classic and big TIFF, strips or tiles, raw, deflate, LZW or PackBits, predictors 1 to 3."""

from __future__ import annotations

import mmap
import os
import struct
import zlib
from contextlib import contextmanager
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
META = (
    "source_path string, count int, width int, height int, dtype string, nodata double, srid int, a double, b double, c double, d double, e double, f double, "
    "tags map<string,string>, file_mtime timestamp"
)


def read_tags(data: bytes) -> tuple[dict[int, tuple], str]:
    """Tags of the first image directory, and the byte order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    magic = struct.unpack_from(f"{order}H", data, 2)[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    n = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
    at += 8 if big else 2
    step, inline = (20, 8) if big else (12, 4)
    tags = {}
    for i in range(n):
        entry = at + i * step
        tag, kind = struct.unpack_from(f"{order}HH", data, entry)
        count = struct.unpack_from(order + ("Q" if big else "I"), data, entry + 4)[0]
        if kind not in SIZES:
            continue
        form = f"{order}{count}s" if SIZES[kind] == "s" else order + SIZES[kind] * count
        size = struct.calcsize(form)
        where = entry + (12 if big else 8)
        if size > inline:
            where = struct.unpack_from(order + ("Q" if big else "I"), data, where)[0]
        tags[tag] = struct.unpack_from(form, data, where)
    return tags, order


def dtype_of(tags: dict, order: str) -> np.dtype:
    bits, kind = tags.get(258, (1,))[0], tags.get(339, (1,))[0]
    if bits not in (8, 16, 32, 64) or kind not in (1, 2, 3):
        raise ValueError(f"samples of {bits} bits and format {kind} are not read")
    return np.dtype(f"{order}{'uif'[kind - 1]}{bits // 8}")


def describe(data: bytes) -> dict:
    """Size, sample type, affine transform, EPSG code, nodata value and text tags."""
    tags, order = read_tags(data)
    a = e = 1.0
    b = c = d = f = 0.0
    if 34264 in tags:
        m = tags[34264]
        a, b, c, d, e, f = m[0], m[1], m[3], m[4], m[5], m[7]
    elif 33550 in tags and 33922 in tags:
        (sx, sy), tie = tags[33550][:2], tags[33922]
        a, e = sx, -sy
        c, f = tie[3] - tie[0] * sx, tie[4] + tie[1] * sy
    keys = tags.get(34735, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    if codes.get(1025) == 2:  # samples are at pixel centres
        c, f = c - a / 2, f - e / 2
    srid = codes.get(3072) or codes.get(2048)
    text = lambda t: tags[t][0].split(b"\0")[0].decode("latin-1") if t in tags else None
    nodata = text(42113)
    names = {270: "TIFFTAG_IMAGEDESCRIPTION", 305: "TIFFTAG_SOFTWARE", 306: "TIFFTAG_DATETIME", 315: "TIFFTAG_ARTIST"}
    return {
        "count": tags.get(277, (1,))[0], "width": tags[256][0], "height": tags[257][0], "dtype": dtype_of(tags, order).newbyteorder("=").name,
        "nodata": float(nodata) if nodata and nodata.strip() else None, "srid": srid if srid and srid != 32767 else None,
        "transform": tuple(map(float, (a, b, c, d, e, f))), "tags": {n: text(t) for t, n in names.items() if t in tags},
    }


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Variable-width codes of 9 to 12 bits, high bits first; 256 clears the table and 257 ends."""
    out, table, width, hold, n, before = [], [], 9, 0, 0, None
    for byte in data:
        hold, n = (hold << 8) | byte, n + 8
        while n >= width:
            code = (hold >> (n - width)) & ((1 << width) - 1)
            n -= width
            hold &= (1 << n) - 1
            if code == 257:
                return b"".join(out)
            if code == 256:
                table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
                continue
            word = table[code] if code < len(table) else before + before[:1]
            out.append(word)
            if before is not None:
                table.append(before + word[:1])
            before = word
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def expand(part: bytes, compression: int) -> bytes:
    if compression == 1:
        return part
    if compression in (8, 32946):
        return zlib.decompress(part)
    if compression == 5:
        return unpack_lzw(part)
    if compression == 32773:
        return unpack_bits(part)
    raise ValueError(f"TIFF compression {compression} is not read")


def undo_predictor(cells: np.ndarray, predictor: int, raw: bytes, dtype: np.dtype) -> np.ndarray:
    """`cells` is (rows, cols, samples) as stored."""
    if predictor == 2:
        return np.cumsum(cells, axis=1, dtype=cells.dtype)
    if predictor == 3:
        rows, cols, samples = cells.shape
        size = dtype.itemsize
        flat = np.frombuffer(raw, np.uint8)[: rows * cols * samples * size].reshape(rows, cols * size, samples)
        planes = np.cumsum(flat, axis=1, dtype=np.uint8).reshape(rows, size, cols * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, cols, samples)
    return cells


class Layout:
    """Where the blocks (strips or tiles) of the first image lie, and how they are packed."""

    def __init__(self, data):
        tags, order = read_tags(data)
        self.dtype, self.width, self.height, self.count = dtype_of(tags, order), tags[256][0], tags[257][0], tags.get(277, (1,))[0]
        self.compression, self.predictor, separate = tags.get(259, (1,))[0], tags.get(317, (1,))[0], tags.get(284, (1,))[0] == 2
        if 322 in tags:
            self.cols, self.rows, self.offsets, self.sizes = tags[322][0], tags[323][0], tags[324], tags[325]
        else:
            self.cols, self.rows, self.offsets, self.sizes = self.width, min(self.height, tags.get(278, (self.height,))[0]), tags[273], tags[279]
        self.across, self.down = -(-self.width // self.cols), -(-self.height // self.rows)
        self.samples, self.planes = (1, self.count) if separate else (self.count, 1)

    def line(self, data, r: int) -> np.ndarray:
        """(bands, rows, cols) of the r-th line of blocks."""
        out = np.zeros((self.count, self.rows, self.across * self.cols), self.dtype.newbyteorder("="))
        for plane in range(self.planes):
            for c in range(self.across):
                i = (plane * self.down + r) * self.across + c
                raw = expand(bytes(data[self.offsets[i] : self.offsets[i] + self.sizes[i]]), self.compression)
                high = min(self.rows, len(raw) // (self.cols * self.samples * self.dtype.itemsize))
                cells = np.frombuffer(raw, self.dtype, high * self.cols * self.samples).reshape(high, self.cols, self.samples)
                cells = undo_predictor(cells, self.predictor, raw, self.dtype)
                out[plane * self.samples : (plane + 1) * self.samples, :high, c * self.cols : (c + 1) * self.cols] = cells.transpose(2, 0, 1)
        return out[:, : min(self.rows, self.height - r * self.rows), : self.width]


def read_cube(data: bytes) -> np.ndarray:
    """(bands, rows, cols) of the first image."""
    layout = Layout(data)
    return np.concatenate([layout.line(data, r) for r in range(layout.down)], axis=1)


def write_geotiff(path: str, cube: np.ndarray, transform: tuple, srid: int | None = None, nodata: float | None = None, when: str | None = None, compress: bool = True, tile: int = 0) -> None:
    """A classic GeoTIFF of (bands, rows, cols): deflate or raw, strips or square tiles, pixel interleaved."""
    bands, height, width = cube.shape
    cells = np.ascontiguousarray(cube.transpose(1, 2, 0))
    parts = []
    if tile:
        for r in range(0, height, tile):
            for c in range(0, width, tile):
                block = np.zeros((tile, tile, bands), cube.dtype)
                piece = cells[r : r + tile, c : c + tile]
                block[: piece.shape[0], : piece.shape[1]] = piece
                parts.append(block.tobytes())
    else:
        parts = [cells[r : r + 64].tobytes() for r in range(0, height, 64)]
    parts = [zlib.compress(p) for p in parts] if compress else parts
    kind = {"u": 1, "i": 2, "f": 3}[cube.dtype.kind]
    a, _, c, _, e, f = transform
    tags = [(256, "I", [width]), (257, "I", [height]), (258, "H", [cube.dtype.itemsize * 8] * bands), (259, "H", [8 if compress else 1]), (262, "H", [1]), (277, "H", [bands]), (284, "H", [1]), (339, "H", [kind] * bands), (33550, "d", [a, -e, 0.0]), (33922, "d", [0.0, 0.0, 0.0, c, f, 0.0])]
    tags += [(322, "I", [tile]), (323, "I", [tile]), (324, "I", None), (325, "I", [len(p) for p in parts])] if tile else [(273, "I", None), (278, "I", [64]), (279, "I", [len(p) for p in parts])]
    if srid:
        tags.append((34735, "H", [1, 1, 0, 2, 1025, 0, 1, 1, 3072, 0, 1, srid]))
    for tag, text in ((42113, None if nodata is None else f"{nodata:g}"), (306, when)):
        if text is not None:
            tags.append((tag, "s", text.encode() + b"\0"))
    tags.sort(key=lambda t: t[0])
    codes = {"H": 3, "I": 4, "d": 12, "s": 2}
    at = 8 + 2 + 12 * len(tags) + 4
    extra, fixed, entries = b"", {}, []
    for tag, form, values in tags:
        n = len(parts) if values is None else len(values)
        body = b"\0" * 4 * n if values is None else values if form == "s" else struct.pack(f"<{n}{form}", *values)
        if len(body) > 4:
            fixed[tag] = at + len(extra)
            place, extra = struct.pack("<I", at + len(extra)), extra + body + b"\0" * (len(body) % 2)
        else:
            place = body.ljust(4, b"\0")
        entries.append([tag, codes[form], n, place])
    start = at + len(extra)
    offsets = np.cumsum([0, *map(len, parts)])[:-1] + start
    for entry in entries:
        if entry[0] in (273, 324):
            packed = struct.pack(f"<{len(parts)}I", *offsets.tolist())
            if entry[0] in fixed:
                k = fixed[entry[0]] - at
                extra = extra[:k] + packed + extra[k + len(packed) :]
            else:
                entry[3] = packed
    with open(path, "wb") as out:
        out.write(b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", len(entries)))
        for tag, code, n, place in entries:
            out.write(struct.pack("<HHI", tag, code, n) + place)
        out.write(b"\0\0\0\0" + extra + b"".join(parts))


def local_file(path: str) -> str | None:
    """The path of a single file that this machine and the executors can open themselves, if it is one."""
    plain = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    return plain if "://" not in plain and os.path.isfile(plain) else None


@contextmanager
def mapped(path: str):
    """The file's bytes, of which only what is looked at is read."""
    with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
        yield data


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """raster_meta: one row per file.  A local file's tags are read where they lie; in another store Spark opens the files."""
    if own := local_file(path):
        files = spark.createDataFrame([(path, datetime.fromtimestamp(os.path.getmtime(own)), None)], "path string, modificationTime timestamp, content binary")
    else:
        files = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "content")

    def facts(path: str, data: bytes | None) -> dict:
        if data is not None:
            return describe(data)
        with mapped(local_file(path)) as found:
            return describe(found)

    def run(batches):
        for batch in batches:
            rows = []
            for path, when, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                d = facts(path, data)
                rows.append({"source_path": path, **{k: d[k] for k in ("count", "width", "height", "dtype", "nodata", "srid")}, **dict(zip("abcdef", d["transform"], strict=True)), "tags": list(d["tags"].items()), "file_mtime": when})
            types = pa.schema([("source_path", pa.string()), *((k, pa.int32()) for k in ("count", "width", "height")), ("dtype", pa.string()), ("nodata", pa.float64()), ("srid", pa.int32()), *((k, pa.float64()) for k in "abcdef"), ("tags", pa.map_(pa.string(), pa.string())), ("file_mtime", pa.timestamp("us", "UTC"))])
            yield pa.RecordBatch.from_pylist(rows, schema=types)

    return files.mapInArrow(run, META)


def scanlines(path: str, first: int, cube: np.ndarray):
    """Record batches of (source_path, band, row, cols) of some rows, `first` and on."""
    for band in range(cube.shape[0]):
        part = cube[band].astype(np.float64)
        n, w = part.shape
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), pa.array(part.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([band] * n, pa.int32()), pa.array(np.arange(first, first + n, dtype=np.int32)), lists], names=["source_path", "band", "row", "cols"])


PIXELS = "source_path string, band int, row int, cols array<double>"


def read_pixels(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """raster_pixels: source_path, band, row, cols; one row per scanline.

    A local (or mounted) file is scanned line of blocks by line of blocks, dealt over the cluster: a task reads and decodes
    only its own strips or tiles.  Files in another store come whole, one to a row, which Spark limits to 2 GB.
    """
    if own := local_file(path):
        with mapped(own) as data:
            lines = Layout(data).down
        blocks = spark.range(0, lines, 1, partitions or max(1, min(lines, 4 * spark.sparkContext.defaultParallelism)))

        def scan(batches):
            with mapped(own) as data:
                layout = Layout(data)
                for batch in batches:
                    for r in batch.column(0).to_pylist():
                        yield from scanlines(path, r * layout.rows, layout.line(data, r))

        return blocks.mapInArrow(scan, PIXELS)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for path, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                layout = Layout(data)
                for r in range(layout.down):
                    yield from scanlines(path, r * layout.rows, layout.line(data, r))

    return files.mapInArrow(run, PIXELS)


def open_raster(spark: SparkSession, path: str, with_pixels: bool = True):
    """The Raster of one file: metadata by a Spark job, pixels as a lazy DataFrame.  Its path is named as given."""
    from ..operators.raster import capture_date
    from ..plans.append import Raster

    meta = read_meta(spark, path).withColumn("when", capture_date(F.col("tags")["TIFFTAG_DATETIME"], F.col("file_mtime")))
    m = meta.first()
    if m["b"] or m["d"]:
        raise ValueError("rotated rasters are not supported")
    when: datetime = m["when"]
    return Raster(path, m["width"], m["height"], tuple(m[k] for k in "abcdef"), m["srid"], m["nodata"], m["dtype"], when, read_pixels(spark, path) if with_pixels else None)
