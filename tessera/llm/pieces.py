"""SentencePiece encoding and decoding by a table of distinct chunks.

A text becomes a marker followed by the text with blanks replaced by markers (the model's own normal form).  Where no
piece of the vocabulary holds a marker after another character, no merge can cross the start of a marker run, so the
text splits into chunks (a run of markers and what follows up to the next run) that can be segmented alone.  A task
segments each distinct chunk once, keeps it in a table, and joins ids back by the chunks' positions.

The table is bounded by `table_units` (about 16 bytes each; when full it starts anew), never leaves its task, and needs no
shuffle: at corpus scale a global table of distinct chunks would itself be corpus-sized, and joining positions back would
shuffle every word.  A vocabulary with crossing pieces, or a model that normalises beyond this form, is refused.

Defined cases: a null text counts as empty and has no ids; no ids (or null) decode to the empty string; very long texts
are read whole, cut at blanks into segments of about `PART_BYTES` while they are chunked; repeated rows agree; columns named like an
output are replaced and all others pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, text_runs

MARK = "▁"
#: Text encoded at a time in a task.
PART_BYTES = 1_000_000
BLANKS = (" ", MARK)
CHUNKS = re.compile(f"{MARK}+[^{MARK}]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkEncoder:
    """Encodes texts with one model; equal to the library's encode() without begin or end ids.

    A subclass may say more of a chunk by overriding `entry`.
    """

    def __init__(self, model: str, table_units: int = 4_000_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.limit, self.table, self.units = table_units, {}, 0
        self.ints = list(range(self.model.get_piece_size()))  # one object for each id, however often it occurs
        self.lone = (self.model.piece_to_id(MARK),)
        if any(MARK in self.model.id_to_piece(i).lstrip(MARK) for i in range(self.model.get_piece_size())):
            raise ValueError("a piece crosses a whitespace marker; texts cannot be cut into chunks")
        for probe in ("  a  b ", "ａ\n\t", "é", " x", "ﬁ"):
            if self.encode([probe])[0] != self.model.encode(probe):
                raise ValueError("the model normalises texts; chunks would not equal whole texts")

    @staticmethod
    def chunks(segment: str) -> list[str]:
        """The chunks of a marked segment, each without its first marker (so that a plain word is its own name)."""
        if segment[:1] == MARK and segment[1:2] not in BLANKS and "  " not in segment and MARK not in segment[1:]:
            return segment[1:].split(" ")
        return [c[1:] for c in CHUNKS.findall(segment.replace(" ", MARK))]

    def learn(self, found: list[str]) -> None:
        """Segment what the table lacks.  The library puts one marker before a text itself; a lone marker is one piece."""
        if self.units > self.limit:
            self.forget()
        table = self.table
        new = sorted([c for c in set(found) if c not in table])
        if new:
            for chunk, ids in zip(new, self.model.encode(new, num_threads=1), strict=True):
                table[chunk] = self.entry(chunk, tuple(map(self.ints.__getitem__, ids)) or self.lone)
                self.units += 12 + (len(ids) + len(chunk) // 4) // 2

    def forget(self) -> None:
        self.table, self.units = {}, 0

    def entry(self, chunk: str, ids: tuple[int, ...]):
        return ids

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text.  Several texts learn together; together they should be no longer than a part."""
        if len(texts) == 1:
            return [self.encode_text(texts[0])]
        found = [list(chain.from_iterable(map(self.chunks, segments(t)))) for t in texts]
        self.learn(list(chain.from_iterable(found)))
        return [list(chain.from_iterable(map(self.table.__getitem__, x))) for x in found]

    def encode_text(self, text: str | None) -> list[int]:
        """Ids of a text of any length, which learns segment by segment."""
        ids: list[int] = []
        for segment in segments(text):
            found = self.chunks(segment)
            self.learn(found)
            ids.extend(chain.from_iterable(map(self.table.__getitem__, found)))
        return ids


def segments(text: str | None, most: int = PART_BYTES):
    """The marked text in parts of about `most` characters, each of which begins with a run of blanks or markers."""
    text = MARK + text if text else ""
    start = 0
    while start < len(text):
        end = start + most
        while end < len(text) and not (text[end] in BLANKS and text[end - 1] not in BLANKS):
            end += 1
        yield text[start:end] if start or end < len(text) else text
        start = end


def encode(df: DataFrame, text: str = "text", ids: str = "ids", model: str | None = None, table_units: int = 4_000_000) -> DataFrame:
    """`df` with a column `ids` array<int>: the ids of each whole text."""
    model = model or default_model()
    df = df.drop(ids)
    schema = df.select("*", F.lit(None).cast("array<int>").alias(ids)).schema
    at = df.columns.index(text)

    def run(batches):
        encoder = ChunkEncoder(model, table_units)
        for whole in batches:
            for batch in text_runs(whole, at, PART_BYTES):
                found = encoder.encode(batch.column(at).to_pylist())
                ends = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x) for x in found], out=ends[1:])
                flat = np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[*whole.schema.names, ids])

    return df.mapInArrow(frugal(run), schema)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", model: str | None = None) -> DataFrame:
    """`df` with a column `text`: the library's decode() of each row's ids."""
    model = model or default_model()
    df = df.drop(text)
    schema = df.select("*", F.lit(None).cast("string").alias(text)).schema
    at = df.columns.index(ids)

    def run(batches):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            decoded = pa.array([processor.decode(x.as_py() or []) for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, text])

    return df.mapInArrow(frugal(run), schema)


def digests(df: DataFrame, text: str = "text", model: str | None = None, table_units: int = 4_000_000) -> DataFrame:
    """`df` without its text and with n_tokens, ids_sha256 (ids in decimal, joined by commas) and decoded_sha256.

    Encoding, decoding and hashing share one pass, so that ids and decoded texts never leave their task.
    """
    model = model or default_model()
    rest = [c for c in df.columns if c not in (text, "n_tokens", "ids_sha256", "decoded_sha256")]
    df = df.select(*(f"`{c}`" for c in rest), text)
    schema = df.select(*(f"`{c}`" for c in rest), F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema

    def run(batches):
        encoder = ChunkEncoder(model, table_units)
        names = [str(i) for i in range(encoder.model.get_piece_size())].__getitem__
        for whole in batches:
            for batch in text_runs(whole, len(rest), PART_BYTES):
                found = encoder.encode(batch.column(len(rest)).to_pylist())
                said = [hashlib.sha256(",".join(map(names, x)).encode()).hexdigest() for x in found]
                back = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in encoder.model.decode(found, num_threads=1)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array([len(x) for x in found], pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())], names=schema.names)

    return df.mapInArrow(frugal(run), schema)
