"""Image tiles: lossless PNG, or JPEG by the file name's suffix, written where no file of the name exists."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jpeg import jpeg


def png(pixels: np.ndarray) -> bytes:
    """8-bit PNG of (rows, cols, bands): one band grey, two grey with alpha, three colour, four colour with alpha; of more bands, the first three."""
    rows, cols, bands = pixels.shape
    if bands > 4:
        pixels, bands = pixels[:, :, :3], 3
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[bands]
    lines = np.concatenate([np.zeros((rows, 1), np.uint8), pixels.reshape(rows, cols * bands)], axis=1)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", cols, rows, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """Pixels (rows, cols, bands) of an 8-bit PNG without interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body, head = 8, b"", None
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif name == b"IDAT":
            body += part
        at += size + 12
    cols, rows, depth, kind, _, _, interlaced = head
    if depth != 8 or interlaced or kind not in (0, 2, 4, 6):
        raise ValueError("only 8-bit PNG files without palette and interlacing are read")
    bands = {0: 1, 2: 3, 4: 2, 6: 4}[kind]
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(rows, cols * bands + 1)
    out = np.zeros((rows, cols * bands), np.int32)
    for r in range(rows):
        method, line, above = lines[r, 0], lines[r, 1:].astype(np.int32), out[r - 1] if r else np.zeros(cols * bands, np.int32)
        if method == 0:
            out[r] = line
        elif method == 2:
            out[r] = (line + above) & 255
        else:
            for i in range(cols * bands):
                a, c = (out[r, i - bands], above[i - bands]) if i >= bands else (0, 0)
                b = above[i]
                if method == 1:
                    guess = a
                elif method == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out[r, i] = (line[i] + guess) & 255
    return out.astype(np.uint8).reshape(rows, cols, bands)


def write(tiles: DataFrame, names: DataFrame) -> None:
    """Write every window's tile.  `tiles`: window_ord, band, row, cols (whole numbers); `names`: window_ord, file_name.

    A file that exists is left alone; a new one appears under its name only when it is complete, so a retried task does no
    harm.  Folders have to be reachable by all executors.
    """
    signed = F.transform("cols", lambda v: F.when(v > 127, v - 256).otherwise(v).cast("tinyint"))
    lines = tiles.groupBy("window_ord").agg(F.sort_array(F.collect_list(F.struct("band", "row", signed.alias("cols")))).alias("lines")).join(names, "window_ord")

    def put(batches):
        for batch in batches:
            for path, lines in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                path = path.removeprefix("file://")
                if os.path.exists(path):
                    continue
                # The lines are in order of band and row, each of the window's width: one reshape gives the cube.
                cells = lines.values.field("cols").flatten().to_numpy(zero_copy_only=False).view(np.uint8)
                bands = 1 + lines.values.field("band")[-1].as_py()
                height = len(lines.values) // bands
                cube = np.ascontiguousarray(cells.reshape(bands, height, -1).transpose(1, 2, 0))
                os.makedirs(os.path.dirname(path), exist_ok=True)
                draft = f"{path}.{os.getpid()}.part"
                with open(draft, "wb") as out:
                    out.write(jpeg(cube) if path.lower().endswith((".jpg", ".jpeg")) else png(cube))
                os.replace(draft, path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    lines.select("file_name", "lines").mapInArrow(put, "n long").agg(F.sum("n")).collect()
