"""Quality rules: tokeniser fertility within bands per language or script.

Two public vocabularies segment every whole text: one of pieces with byte fallback (by the table of distinct chunks of
`pieces`), and one of byte pairs, chunk by chunk.  Four figures follow: characters per token of either vocabulary, the share of
byte-fallback tokens, and evenness: the entropy of the text's pieces over the most that a text of as many tokens, SPAN at
most, can have, which hardly depends on length.  A text is rejected where a figure lies beyond its group's band.  Groups are
declared languages, or scripts where none is declared.  Bands come from counts over all documents that have the figure: its
quartiles, widened on both sides by `reach` interquartile ranges (at least LEAST of the figure's unit), and for texts of
fewer than FULL tokens by the square root of what they lack.

Base rules: fewer than `min_words` words, or more than `max_repeat` percent of words in windows that repeat.

Defined cases: null and empty texts have zero words and fail the base rules, and have no figures; null languages go by
script; rows repeat their verdicts; very long texts are read whole; columns other than doc_id, text and lang are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import math
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, runs_of, written
from .pieces import MARK, PART_BYTES, ChunkEncoder, default_model, segments
from .shingles import WordHashes, window_hashes

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8
#: Units in which the figures are counted for the bands.
UNITS = {"chars_per_token": 0.02, "chars_per_pair": 0.02, "byte_share": 0.002, "evenness": 0.005}
LEAST = {"chars_per_token": 0.75, "chars_per_pair": 0.75, "byte_share": 0.06, "evenness": 0.15}
#: Tokens from which a text is judged by the plain band, and up to which entropy grows with the length.
FULL, SPAN = 80, 256
SCHEMA = (
    "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, "
    "n_tokens long, chars_per_token double, chars_per_pair double, byte_share double, entropy double, evenness double"
)


def repeated_words(words: list[bytes], hashes: WordHashes, width: int = WINDOW) -> int:
    """Words covered by windows of `width` words that occur twice or more, first occurrences included."""
    n = len(words)
    if n <= width:
        return 0
    windows = window_hashes(np.fromiter(map(hashes.__getitem__, words), np.uint64, n), width)
    ordered = np.sort(windows)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover[:n]) > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def script_of(text: str) -> str:
    """The commonest script among the first letter of each of the text's distinct letters (its Unicode name's first word)."""
    names: dict[str, int] = {}
    for ch in set(text):
        if ch.isalpha():
            name = unicodedata.name(ch, "UNKNOWN").split(" ")[0]
            names[name] = names.get(name, 0) + text.count(ch)
    return min(names, key=lambda k: (-names[k], k)) if names else "NONE"


def default_pairs() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class TwoVocabularies(ChunkEncoder):
    """A text's pieces, and how many byte-pair tokens its chunks have together.

    The table gives a chunk's row; arrays hold the rows' pieces, end to end, and their numbers of byte pairs.
    """

    def __init__(self, model: str, pairs: str):
        import public_tokenizers
        import tiktoken

        with open(pairs, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pairs = tiktoken.Encoding("pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.forget()
        super().__init__(model)

    def forget(self) -> None:
        super().forget()
        self.fresh: list[tuple[tuple[int, ...], int]] = []
        self.flat, self.starts, self.sizes, self.n_pairs = (np.empty(0, np.int64) for _ in range(4))

    def entry(self, chunk: str, ids: tuple[int, ...]) -> int:
        self.fresh.append((ids, len(self.pairs.encode_ordinary(" " + chunk.replace(MARK, " ")))))
        return len(self.starts) + len(self.fresh) - 1

    def learn(self, found: list[str]) -> None:
        super().learn(found)
        if self.fresh:
            sizes = np.array([len(ids) for ids, _ in self.fresh], np.int64)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes, self.n_pairs = np.concatenate([self.sizes, sizes]), np.concatenate([self.n_pairs, np.array([n for _, n in self.fresh], np.int64)])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids for ids, _ in self.fresh), np.int64, int(sizes.sum()))])
            self.fresh = []

    def encode_text(self, text: str | None) -> list[int]:
        return self.both([text])[0][0].tolist()

    def both(self, texts: list[str | None]) -> list[tuple[np.ndarray, int]]:
        """Of each text its pieces, and the number of its byte-pair tokens.  Several texts learn together, as in `encode`."""
        if len(texts) == 1:
            parts = []
            for found in map(self.chunks, segments(texts[0])):
                self.learn(found)
                parts.append(self.looked_up(found))
            return [(np.concatenate([np.empty(0, np.int64), *(p[0] for p in parts)]), sum(p[1] for p in parts))]
        found = [list(chain.from_iterable(map(self.chunks, segments(t)))) for t in texts]
        self.learn(list(chain.from_iterable(found)))
        return [self.looked_up(x) for x in found]

    def looked_up(self, found: list[str]) -> tuple[np.ndarray, int]:
        if not found:
            return np.empty(0, np.int64), 0
        rows = np.fromiter(map(self.table.__getitem__, found), np.int64, len(found))
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[rows] - ends + sizes, sizes) + np.arange(ends[-1])], int(self.n_pairs[rows].sum())


def measures(docs: DataFrame, model: str | None = None, pairs: str | None = None) -> DataFrame:
    """The counts and fertility figures of every row of (doc_id, text, lang)."""
    model, pairs = model or default_model(), pairs or default_pairs()

    def run(batches):
        encoder, hashes = TwoVocabularies(model, pairs), WordHashes()
        processor = encoder.model
        is_byte = np.array([processor.is_byte(i) for i in range(processor.get_piece_size())])
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        types = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.string(), pa.int64(), *[pa.float64()] * 5]
        for whole in batches:
            lengths = pa.compute.fill_null(pa.compute.binary_length(whole.column(1)), 0).to_pylist()
            for start, end in runs_of(lengths, PART_BYTES):
                rows = []
                part = [t or "" for t in whole.column(1)[start:end].to_pylist()]
                for doc_id, lang, text, (ids, n_pairs) in zip(whole.column(0)[start:end].to_pylist(), whole.column(2)[start:end].to_pylist(), part, encoder.both(part), strict=True):
                    found, times = np.unique(ids, return_counts=True)
                    words = text.encode("utf-8", "surrogatepass").split()
                    chars = len(text) - sum(map(text.count, BLANKS))
                    figures = [0, None, None, None, None, None]
                    if len(found):
                        n = int(times.sum())
                        share = times / n
                        entropy = float(-(share * np.log2(share)).sum())
                        even = entropy / math.log2(min(n, SPAN)) if n > 1 else None
                        figures = [n, len(text) / n, len(text) / n_pairs, float(times[is_byte[found]].sum() / n), entropy, even]
                    rows.append((doc_id, lang, len(words), chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated_words(words, hashes), script_of(text) if not lang else None, *figures))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return picked.mapInArrow(frugal(run), SCHEMA)


def bands(measured: DataFrame, reach: float) -> DataFrame:
    """grp, and lo_, hi_ and margin_ of each figure: from histograms over all documents, so only (group, figure, unit) counts move."""
    rows = measured.filter("n_tokens > 0")
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("figure"), F.floor(F.col(k) / u).cast("long").alias("at")) for k, u in UNITS.items())))
    counts = rows.select("grp", pairs.alias("p")).filter("p.at IS NOT NULL").groupBy("grp", "p.figure", "p.at").count()
    quartiles = counts.groupBy("grp", "figure").agg(F.percentile("at", F.array(F.lit(0.25), F.lit(0.75)), F.col("count")).alias("q"))
    unit = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))[F.col("figure")]
    least = F.create_map(*(F.lit(x) for kv in LEAST.items() for x in kv))[F.col("figure")]
    margin = F.greatest((F.col("q")[1] - F.col("q")[0]) * unit * reach, least)
    edges = quartiles.select("grp", "figure", (F.col("q")[0] * unit).alias("lo"), (F.col("q")[1] * unit).alias("hi"), margin.alias("margin"))
    picks = [F.max(F.when(F.col("figure") == k, F.col(side))).alias(f"{side}_{k}") for k in UNITS for side in ("lo", "hi", "margin")]
    return edges.groupBy("grp").agg(*picks)


def beyond(figure: str) -> Column:
    """Whether a text's figure lies beyond its group's band; false where either is missing."""
    lack = F.least(F.lit(1.0), F.greatest(F.col("n_tokens"), F.lit(1)) / F.lit(float(FULL)))
    margin = F.col(f"margin_{figure}") / F.sqrt(lack)
    return F.coalesce((F.col(figure) < F.col(f"lo_{figure}") - margin) | (F.col(figure) > F.col(f"hi_{figure}") + margin), F.lit(False))


def judge(docs: DataFrame, model: str | None = None, reach: float = 4.0, min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """doc_id, the base counts, base_failed, the fertility figures, band_failed and kept, for every row of `docs`."""
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat)
    measured = measures(docs, model).withColumn("base_failed", base).withColumn("grp", F.coalesce(F.lower("lang"), F.concat(F.lit("script:"), "script")))
    measured = written(measured, "op6-measures")
    edges = written(bands(measured, reach), "op6-bands").withColumnRenamed("grp", "of")
    joined = measured.join(edges, F.col("grp") == F.col("of"), "left")
    failed = F.lit(False)
    for k in UNITS:
        failed = failed | beyond(k)
    joined = joined.withColumn("band_failed", failed)
    names = [c for c in measured.columns if c not in ("lang", "grp", "script")]
    return joined.select(*names, "band_failed", (~F.col("base_failed") & ~F.col("band_failed")).alias("kept"))
