"""Licence scans: a trained paragraph classifier, with templates to confirm what it predicts.

A paragraph is a run of lines that hold a letter or digit; lines of comment marks only, and blank ones, part paragraphs, and
comment marks do not count as words, so a header that is wrapped inside a comment reads like the statement that it is.

Every paragraph is classified by overlapping windows of the widths of WINDOWS (a shorter one as a whole).  A multinomial
logistic regression over hashed words and word pairs gives each window the probability of every licence family and of
"unknown".  It is trained here: positives are the templates below, whole, cropped, with words dropped and with words of the corpus
around them (seeded); unknown are windows of a bounded sample of the corpus' texts that hold no template, the templates with
their words in another order, and plain words with some of the templates' among them.  The class "unknown" is calibrated on a held-out part: a
prediction must reach the probability under which at most `false_rate` of held-out unknown windows pass; where held-out
positives leave a gap above that, the middle of the gap.

A prediction counts once the words around the window hold at least `confirm` of the word pairs of one of the family's
templates (containment; a paragraph may hold more).  Of overlapping hits the one that is closest to its template stays.

Defined cases: null, empty and word-less texts have no paragraph and no licence; repeated rows and paragraphs each count;
ties between families go to the first in name order; very long paragraphs are read in overlapping pieces; columns other than
doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frugal
from .shingles import mix

#: Statements by which texts name their licence. Fixed values.
TEMPLATES = {
    "agpl": ("Licensed under the GNU Affero General Public License, version 3.", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "apache": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License 2.0.", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", "SPDX-License-Identifier: Apache-2.0"),
    "boost": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc0": ("Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "eupl": ("Licensed under the EUPL, Version 1.2.", "Licensed under the European Union Public License.", "SPDX-License-Identifier: EUPL-1.2"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "isc": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC"),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 2.1.", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "mit": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "SPDX-License-Identifier: MIT"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "reserved": ("All rights reserved.", "All rights reserved. No part of this publication may be reproduced without permission."),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "zlib": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "SPDX-License-Identifier: Zlib"),
}
FAMILIES = sorted(TEMPLATES)
UNKNOWN = len(FAMILIES)
WORD = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")
TEXT_LINE = re.compile(r"\w")
#: Comment marks that look like words.
COMMENT_WORDS = re.compile(r"\s*(?:dnl|rem)\s", re.IGNORECASE)
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed"}
BUCKETS = 1 << 15
#: Widths and steps, in words, of the windows of a paragraph.
WINDOWS = ((6, 2), (12, 4), (24, 8), (48, 16))
#: Words that are scored at a time.
PIECE = 40_000


def plain(word: str) -> str:
    word = word.lower()
    return SPELLINGS.get(word, word)


def words_of(text: str) -> list[str]:
    return [plain(w) for w in WORD.findall(text)]


def pairs_of(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


TEMPLATE_WORDS = {f: [words_of(t) for t in ts] for f, ts in TEMPLATES.items()}
TEMPLATE_PAIRS = {f: [(pairs_of(w), len(w)) for w in ws] for f, ws in TEMPLATE_WORDS.items()}


class WordKeys(dict):
    """Word as written -> hash of its plain form; bounded, starts anew when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(plain(word))
        return value


def grams(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word, and of each word with the next."""
    last = np.uint64(BUCKETS - 1)
    pairs = mix(keys[:-1] * np.uint64(0x9E3779B97F4A7C15) + mix(keys[1:]))
    return (mix(keys) & last).astype(np.int64), (pairs & last).astype(np.int64)


def windows_of(n: int) -> list[tuple[int, int]]:
    """(start, end) of the windows of a paragraph of n words; a paragraph is a window itself where a width exceeds it."""
    out = set()
    for width, step in WINDOWS:
        if n <= width:
            out.add((0, n))
            break
        out.update((at, at + width) for at in range(0, n - width, step))
        out.add((n - width, n))
    return sorted(out)


@dataclass
class Model:
    """weights: float32[BUCKETS, families + 1] (the last column is unknown); bar: probability that a prediction must reach."""

    weights: np.ndarray
    bias: np.ndarray
    bar: float

    def logits(self, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One row per window [start, end) of the words."""
        one, two = grams(keys)
        words = np.concatenate([np.zeros((1, UNKNOWN + 1)), np.cumsum(self.weights[one], axis=0, dtype=np.float64)])
        pairs = np.concatenate([np.zeros((1, UNKNOWN + 1)), np.cumsum(self.weights[two], axis=0, dtype=np.float64)])
        total = words[ends] - words[starts] + pairs[ends - 1] - pairs[starts]
        return total / np.sqrt(2 * (ends - starts) - 1)[:, None] + self.bias

    def judge(self, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows whose prediction is a family: their indices, families and probabilities."""
        z = self.logits(keys, starts, ends)
        at = np.flatnonzero(z[:, :UNKNOWN].max(axis=1) > z[:, UNKNOWN])
        p = softmax(z[at])
        family = p[:, :UNKNOWN].argmax(axis=1)
        best = p[np.arange(len(at)), family]
        sure = best >= self.bar
        return at[sure], family[sure], best[sure]

    def predict(self, text: str) -> tuple[str, float] | None:
        """Family and probability of a text as one window, or nothing for an unknown one."""
        keys = np.array([xxhash.xxh3_64_intdigest(w) for w in words_of(text)], np.uint64)
        if not len(keys):
            return None
        _, family, p = self.judge(keys, np.array([0]), np.array([len(keys)]))
        return (FAMILIES[family[0]], float(p[0])) if len(p) else None


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def template_share(words: list[str], family: str) -> float:
    """The largest share of the word pairs of one of the family's templates that these words hold."""
    have = pairs_of(words)
    return max(len(have & pairs) / len(pairs) for pairs, _ in TEMPLATE_PAIRS[family])


def paragraphs_of(text: str):
    """The lines of every paragraph, as (offset in the text, line)."""
    at, lines = 0, []
    for line in text.split("\n"):
        if TEXT_LINE.search(line):
            lines.append((at, line))
        elif lines:
            yield lines
            lines = []
        at += len(line) + 1
    if lines:
        yield lines


def text_begin(line: str) -> int:
    """Where a line begins after a comment mark that looks like a word."""
    mark = COMMENT_WORDS.match(line)
    return mark.end() if mark else 0


def paragraph_words(lines: list[tuple[int, str]]) -> list[str]:
    return [w for _, line in lines for w in WORD.findall(line, text_begin(line))]


def word_spans(lines: list[tuple[int, str]]) -> list[tuple[int, int]]:
    return [(at + m.start(), at + m.end()) for at, line in lines for m in WORD.finditer(line, text_begin(line))]


def examples(rng: np.random.Generator, corpus: list[list[str]], copies: int) -> tuple[list[list[str]], list[int]]:
    """Variants of the templates with their family, and what only looks like them as unknown."""
    filler = [w for words in corpus for w in words] or ["text"]
    texts, labels = [], []

    def some(low: int, high: int) -> list[str]:
        n, at = int(rng.integers(low, high)), int(rng.integers(0, len(filler)))
        return (filler[at : at + n] * n)[:n]

    for k, family in enumerate(FAMILIES):
        for words in TEMPLATE_WORDS[family]:
            texts.append(words)
            labels.append(k)
            for _ in range(copies):
                w = [x for x in words if rng.random() > 0.06] or words
                if len(w) > 8:
                    n = int(rng.integers(max(6, len(w) // 2), len(w) + 1))
                    at = int(rng.integers(0, len(w) - n + 1))
                    w = w[at : at + n]
                before = some(0, 2 * len(w)) if rng.random() < 0.7 else []
                after = some(0, 2 * len(w)) if rng.random() < 0.7 else []
                texts.append(before + w + after)
                labels.append(k)
                mixed = list(words)
                rng.shuffle(mixed)
                mixed = mixed[: int(rng.integers(2, 9))] + some(2, 24)
                if max(template_share(mixed, f) for f in FAMILIES) < 0.3:  # another order by chance is the same for short ones
                    texts.append(mixed)
                    labels.append(UNKNOWN)
                plain_text = some(6, 48)
                for x in rng.choice(words, min(len(words), 2), replace=False):
                    plain_text.insert(int(rng.integers(0, len(plain_text) + 1)), str(x))
                texts.append(plain_text)
                labels.append(UNKNOWN)
    return texts, labels


def corpus_windows(docs: DataFrame, sample: int, per_text: int, seed: int) -> list[list[str]]:
    """About `sample` distinct texts, chosen by a seeded hash, and `per_text` windows of each, anywhere in it.

    Copies of a text count once; at most 2 * `sample` * `per_text` windows of at most 48 words reach the driver.
    """
    scratch = Scratch(docs.sparkSession, "op3")
    rows = docs.select(F.col("text").cast("string").alias("text")).filter("text IS NOT NULL AND text <> ''")
    turn = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 30))
    n = rows.agg(F.approx_count_distinct(F.xxhash64("text"))).first()[0]
    rows = scratch.keep(rows.filter(turn < min(1.0, sample / max(n, 1)) * (1 << 30)).distinct(), "texts")

    def run(batches):
        for batch in batches:
            found = []
            for text in batch.column(0):
                words = words_of(text.as_py())
                rng = np.random.default_rng([seed, len(words), xxhash.xxh3_64_intdigest(" ".join(words[:64])) & 0xFFFFFFFF])
                for width in rng.choice([w for w, _ in WINDOWS], per_text) if words else ():
                    at = int(rng.integers(0, max(1, len(words) - int(width) + 1)))
                    found.append(words[at : at + int(width)])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], names=["words"])

    windows = rows.mapInArrow(frugal(run), "words array<string>").orderBy(F.xxhash64("words"), "words").limit(2 * sample * per_text).collect()
    scratch.drop()
    return [r[0] for r in windows]


def train(docs: DataFrame, sample: int = 400, per_text: int = 4, copies: int = 12, false_rate: float = 0.005, l2: float = 1e-5, rounds: int = 80, seed: int = 11) -> Model:
    """Fit on variants of the templates and on windows of a bounded sample of the texts (see corpus_windows)."""
    own = [w for w in corpus_windows(docs, sample, per_text, seed) if max(template_share(w, f) for f in FAMILIES) < 0.2]
    rng = np.random.default_rng(seed)
    texts, labels = examples(rng, own, copies)
    texts, labels = texts + own, labels + [UNKNOWN] * len(own)
    lists = []
    for words in texts:
        keys = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
        lists.append(np.concatenate(grams(keys)))
    y = np.array(labels)
    held = rng.random(len(y)) < 0.25
    weights, bias = fit([x for x, h in zip(lists, held, strict=True) if not h], y[~held], UNKNOWN + 1, l2, rounds)
    model = Model(weights, bias, 0.0)
    tops = np.array([softmax((weights[x].sum(axis=0) / np.sqrt(len(x)) + bias)[None])[0, :UNKNOWN].max() for x, h in zip(lists, held, strict=True) if h])
    unknown, known = np.sort(tops[y[held] == UNKNOWN]), np.sort(tops[y[held] != UNKNOWN])
    edge = unknown[min(len(unknown) - 1, int(np.ceil(len(unknown) * (1 - false_rate))))] if len(unknown) else 0.0
    above = known[known > edge]
    model.bar = float((edge + above[0]) / 2) if len(above) else float(edge)
    return model


def fit(lists: list[np.ndarray], y: np.ndarray, classes: int, l2: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Full-batch accelerated gradient on the used buckets only; gram counts scaled by 1 / sqrt(their number)."""
    sizes = np.array([len(x) for x in lists])
    used, cols = np.unique(np.concatenate(lists), return_inverse=True)
    rows = np.repeat(np.arange(len(lists)), sizes)
    scale = np.repeat(1 / np.sqrt(np.maximum(1, sizes)), sizes).astype(np.float32)
    order = np.argsort(cols, kind="stable")
    starts = np.searchsorted(cols[order], np.arange(len(used)))
    begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    share = 1 / np.bincount(y, minlength=classes)[y]
    share = np.where(y == classes - 1, share * classes, share)  # unknown weighs as much as all families together
    share = (share / share.sum()).astype(np.float32)
    target = np.eye(classes, dtype=np.float32)[y]
    w = v = np.zeros((len(used), classes), np.float32)
    b = vb = np.zeros(classes, np.float32)
    t, step = 1.0, 4.0
    for _ in range(rounds):
        z = np.add.reduceat(v[cols] * scale[:, None], begins) + vb
        error = (softmax(z) - target) * share[:, None] * classes / 2
        grad = np.add.reduceat((error[rows] * scale[:, None])[order], starts) + l2 * v
        nw, nb = v - step * grad, vb - step * error.sum(axis=0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = nw, nb, t2
    out = np.zeros((BUCKETS, classes), np.float32)
    out[used] = w
    return out, b


HIT = pa.struct([("paragraph", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("template_share", pa.float64())])
OUT = "doc_id long, n_paragraphs long, families array<string>, hits array<struct<paragraph:long,start:long,length:long,family:string,probability:double,template_share:double>>"


def hits_of(lines: list[tuple[int, str]], windows: list[tuple[int, int, int, float]], confirm: float) -> list[dict]:
    """Confirmed hits of a paragraph among its predicted windows (start, end, family, probability)."""
    words, found = [plain(w) for w in paragraph_words(lines)], []
    for start, end, k, p in windows:
        for pairs, n in TEMPLATE_PAIRS[FAMILIES[k]]:
            low, high = max(0, start - n), min(len(words), end + n)
            met = [i for i in range(low, high - 1) if (words[i], words[i + 1]) in pairs]
            share = len({(words[i], words[i + 1]) for i in met}) / len(pairs)
            if share >= confirm:
                found.append((share, p, met[0], met[-1] + 1, k))
    spans, kept = word_spans(lines), []
    for share, p, first, last, k in sorted(found, key=lambda x: (-x[0], x[2] - x[3], -x[1], x[4], x[2])):
        if all(last < a or first > b for _, _, a, b, _ in kept):
            kept.append((share, p, first, last, k))
    return [{"start": spans[a][0], "length": spans[b][1] - spans[a][0], "family": FAMILIES[k], "probability": round(p, 6), "template_share": round(share, 6)} for share, p, a, b, k in sorted(kept, key=lambda x: x[2])]


def scan(docs: DataFrame, model: Model, confirm: float = 0.6) -> DataFrame:
    """Per row: doc_id, n_paragraphs, families and hits (confirmed ones, with spans in code points)."""

    def pieces_of(words: list[str]):
        """Parts of a long paragraph that overlap by the widest window."""
        widest = WINDOWS[-1][0]
        for at in range(0, max(1, len(words) - widest), PIECE - widest):
            yield at, words[at : at + PIECE]

    def run(batches):
        table = WordKeys()
        for batch in batches:
            blocks, waiting, n_words, predicted, out = [], [], 0, {}, []

            def score():
                """The predictions of all waiting pieces, filed under row and paragraph."""
                nonlocal n_words
                if waiting:
                    keys = np.fromiter((table[w] for _, _, _, words in waiting for w in words), np.uint64, n_words)
                    begins = np.concatenate([[0], np.cumsum([len(x[3]) for x in waiting])])
                    spans = [(i, a, b) for i, (_, _, _, words) in enumerate(waiting) for a, b in windows_of(len(words))]
                    of, starts, ends = np.array(spans).T
                    for at, k, p in zip(*model.judge(keys, begins[of] + starts, begins[of] + ends), strict=True):
                        row, paragraph, offset, _ = waiting[of[at]]
                        predicted.setdefault((row, paragraph), []).append((int(starts[at]) + offset, int(ends[at]) + offset, int(k), float(p)))
                waiting.clear()
                n_words = 0

            def settle():
                """What is confirmed in all rows that are read."""
                score()
                hits = [[] for _ in blocks]
                for (row, paragraph), windows in sorted(predicted.items()):
                    hits[row].extend({"paragraph": paragraph} | hit for hit in hits_of(blocks[row][paragraph], windows, confirm))
                out.extend((len(b), h) for b, h in zip(blocks, hits, strict=True))
                predicted.clear()
                blocks.clear()

            for i, text in enumerate(batch.column(1)):
                blocks.append(list(paragraphs_of(text.as_py() or "")))
                size = 0
                for paragraph, lines in enumerate(blocks[-1]):
                    for offset, words in pieces_of(paragraph_words(lines)):
                        if words:
                            waiting.append((len(blocks) - 1, paragraph, offset, words))
                            n_words, size = n_words + len(words), size + len(words)
                            if n_words >= PIECE:
                                score()
                if size >= PIECE or len(blocks) >= 200 or i + 1 == batch.num_rows:
                    settle()
            columns = [batch.column(0).to_pylist(), [n for n, _ in out], [sorted({h["family"] for h in hits}) for _, hits in out], [hits for _, hits in out]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(HIT)], strict=True)], names=["doc_id", "n_paragraphs", "families", "hits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(frugal(run), OUT)
