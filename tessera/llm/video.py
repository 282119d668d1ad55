"""Media columns: motion-JPEG in AVI.

`encode_media` stores a text's UTF-8 bytes (zero-padded to a positive multiple of 64) as a video: 64 blocks across, up to
64 down in a frame, each block one byte (see `jpeg`).  `read_media` parses the RIFF tree and its idx1 index, decodes the
intra frames and detects shots: where the histogram of a frame differs from the one before by more than the mean plus
`spread` deviations of the last differences (and at least `floor`), a new shot begins.  `clips` gives a timed row per shot.

Defined cases: null and empty texts become one row of 64 zero blocks; equal texts give equal bytes; rows repeat; very long
texts make films of many frames; other columns pass through, those named like the outputs are replaced; a null media value
gives nulls; one that cannot be read gives its size and digest, nulls, and the reason as its feature, and has no clips; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, text_runs
from .jpeg import Frame, encode_bytes

ACROSS, DOWN, FPS = 64, 64, 25
#: Text stored at a time in a task.
PART_BYTES = 2_000_000


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % 64 if raw else 64)


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FPS) -> bytes:
    """A RIFF AVI file of one MJPG stream with an idx1 index (offsets from the movi list's name)."""
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width & 0xFFFF, height & 0xFFFF)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    heads = b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", form))
    movie, index = b"".join(chunk(b"00dc", f) for f in frames), b""
    at = 4
    for f in frames:
        index += b"00dc" + struct.pack("<III", 0x10, at, len(f))
        at += 8 + len(f) + len(f) % 2
    body = b"AVI " + chunk(b"LIST", heads) + chunk(b"LIST", b"movi" + movie) + chunk(b"idx1", index)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def children(data: bytes, start: int, end: int):
    """(name, body start, body end) of the chunks between start and end."""
    while start + 8 <= end:
        size = struct.unpack_from("<I", data, start + 4)[0]
        yield data[start : start + 4], start + 8, min(end, start + 8 + size)
        start += 8 + size + size % 2


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Frames a second and the encoded frames of the first video stream, by idx1 where there is one, else by the movi list."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movie, index = float(FPS), None, None
    for name, start, end in children(data, 12, len(data)):
        if name == b"LIST" and data[start : start + 4] == b"hdrl":
            for inner, s, _ in children(data, start + 4, end):
                if inner == b"avih":
                    fps = 1_000_000 / max(1, struct.unpack_from("<I", data, s)[0])
        elif name == b"LIST" and data[start : start + 4] == b"movi":
            movie = (start, end)
        elif name == b"idx1":
            index = [struct.unpack_from("<4sIII", data, at) for at in range(start, end - 15, 16)]
    if movie is None:
        raise ValueError("an AVI file without frames")
    if index:
        video = [(at, n) for name, _, at, n in index if name[2:] in (b"dc", b"db")]
        base = movie[0] if video and data[movie[0] + video[0][0] : movie[0] + video[0][0] + 4][2:] in (b"dc", b"db") else 0
        return fps, [data[base + at + 8 : base + at + 8 + n] for at, n in video]
    return fps, [data[s:e] for name, s, e in children(data, movie[0] + 4, movie[1]) if name[2:] in (b"dc", b"db")]


def encode_payload(payload: bytes) -> bytes:
    samples = np.frombuffer(payload, np.uint8)
    size = ACROSS * DOWN
    frames = [encode_bytes(samples[i : i + size], ACROSS) for i in range(0, len(samples), size)]
    return write_avi(frames, ACROSS * 8, min(DOWN, len(samples) // ACROSS) * 8)


def shots_of(histograms: np.ndarray, window: int = 12, spread: float = 3.0, floor: float = 0.08) -> tuple[list[int], np.ndarray]:
    """First frames of the shots, and the differences between neighbouring frames (half the L1 distance, 0 to 1)."""
    if not len(histograms):
        return [], np.empty(0)
    share = histograms / histograms.sum(axis=1, keepdims=True)
    steps = np.abs(np.diff(share, axis=0)).sum(axis=1) / 2
    begins = [0]
    for i, step in enumerate(steps):
        past = steps[max(begins[-1], i - window) : i]
        bar = max(floor, past.mean() + spread * past.std()) if len(past) else max(floor, 0.35)
        if step > bar:
            begins.append(i + 1)
    return begins, steps


def analyse(media: bytes) -> dict:
    """The payload as read back, and what the frames look like."""
    fps, frames = read_avi(media)
    parts, histograms = [], []
    for f in frames:
        frame = Frame(f)
        if frame.block_form:
            pixels = frame.samples()
            parts.append(pixels.tobytes())
        else:
            pixels = frame.luma().ravel()
        histograms.append(np.bincount(pixels >> 3, minlength=32))
    histograms = np.array(histograms, float).reshape(-1, 32)
    begins, steps = shots_of(histograms)
    return {"fps": fps, "frames": len(frames), "payload": b"".join(parts), "begins": begins, "steps": steps, "histogram": histograms.sum(axis=0)}


def readable(media: bytes) -> dict | str:
    """What `analyse` says, or why the film cannot be read."""
    try:
        return analyse(media)
    except (ValueError, KeyError, IndexError, StopIteration, TypeError, struct.error) as error:
        return str(error) or type(error).__name__


def encode_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """`df` with binary `media`, the AVI of each whole text."""
    df = df.drop(media)
    schema = df.select("*", F.lit(None).cast("binary").alias(media)).schema
    at = df.columns.index(text)

    def run(batches):
        for whole in batches:
            for batch in text_runs(whole, at, PART_BYTES):
                films = [encode_payload(payload_of(t.as_py())) for t in batch.column(at)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(films, pa.binary())], names=[*whole.schema.names, media])

    return df.mapInArrow(frugal(run), schema)


READ = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """`df` without `media`, with payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature."""
    rest = [c for c in df.columns if c != media and c not in READ]
    df = df.select(*rest, media)
    types = {"payload_bytes": "long", "tail_crc32": "long", "media_bytes": "long"}
    schema = df.select(*rest, *(F.lit(None).cast(types.get(k, "string")).alias(k) for k in READ)).schema

    def facts(film: bytes | None) -> list:
        if film is None:
            return [None] * len(READ)
        seen = readable(film)
        if isinstance(seen, str):
            return [None, None, None, len(film), hashlib.sha256(film).hexdigest(), f"unreadable={seen}"]
        payload, histogram = seen["payload"], seen["histogram"]
        mean = float((histogram * (np.arange(32) * 8 + 4)).sum() / max(1, histogram.sum()))
        steps = seen["steps"]
        feature = f"frames={seen['frames']};shots={len(seen['begins'])};seconds={seen['frames'] / seen['fps']:.2f};grey={mean:.2f};largest_step={steps.max() if len(steps) else 0:.4f}"
        return [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(film), hashlib.sha256(film).hexdigest(), feature]

    def run(batches):
        for batch in (part for whole in batches for part in text_runs(whole, len(rest), 4 * PART_BYTES)):
            rows = [facts(m.as_py()) for m in batch.column(len(rest))]
            out = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), READ.values(), strict=True)] if rows else [pa.array([], t) for t in READ.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *out], names=[*rest, *READ])

    return df.mapInArrow(frugal(run), schema)


def clips(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """A row per shot: key, clip, first_frame, n_frames, start_s, end_s."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, clip int, first_frame int, n_frames int, start_s double, end_s double"

    def run(batches):
        for batch in (part for whole in batches for part in text_runs(whole, 1, 4 * PART_BYTES)):
            rows = []
            for k, film in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen = readable(film.as_py()) if film.is_valid else ""
                if not isinstance(seen, str):
                    for i, (a, b) in enumerate(zip(seen["begins"], [*seen["begins"][1:], seen["frames"]], strict=True)):
                        rows.append((k, i, a, b - a, a / seen["fps"], b / seen["fps"]))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()], strict=True)], names=[key, "clip", "first_frame", "n_frames", "start_s", "end_s"])

    return df.select(key, media).mapInArrow(frugal(run), schema)
