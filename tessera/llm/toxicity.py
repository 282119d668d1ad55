"""Toxicity: a sparse logistic regression, regularised by counterfactual swaps of identity terms.

Features of a text are its distinct lower-cased words and their prefixes of PREFIXES letters (presence only, so long texts
gain nothing by repetition).  Training sees a bounded sample of labelled rows (`sample` per class), outside the held-out
fifth.  Every sentence of a sampled text that names an identity group is rewritten with each other term of the same list
in its place; the features of the sentence as it stands and as rewritten are compared, and the squared change of its score (in
logits) is penalised, sentence by sentence.  A bare mention of every term joins them with the weight of one sentence, so
neutral mentions stay neutral even where the sample has none.  An L1 term keeps only words with real evidence.

Labels are used for training only; lang, source and doc_id are never inputs of a score.

Defined cases: null and empty texts get the score of no evidence (the bias); rows whose label is null do not train; an id
with several labels counts by their majority, and not at all at a tie; an id with several texts trains with the smallest;
with no labelled row of one of the classes every score is the prior; repeated rows score alike; very long texts are read
whole; a column named like the score is replaced and all others pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, frugal

#: Terms that can stand in for each other, by language, without making a sentence more or less toxic.  Fixed values.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "people"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("gay", "lesbian", "straight", "transgender", "bisexual"),
    ("german", "french", "spanish", "english", "turkish", "polish"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen", "leute"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "araber", "afrikaner"),
    ("schwule", "lesben", "heterosexuelle", "transsexuelle"),
    ("deutsche", "franzosen", "spanier", "engländer", "türken", "polen"),
    ("einwanderer", "flüchtlinge", "ausländer", "bürger"),
    ("behinderte", "blinde", "gehörlose", "senioren", "jugendliche"),
    ("mujeres", "hombres", "niñas", "niños", "gente"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "latinos", "árabes", "africanos"),
    ("gais", "lesbianas", "heterosexuales", "transexuales"),
    ("alemanes", "franceses", "españoles", "ingleses", "turcos", "polacos"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
    ("discapacitados", "ciegos", "sordos", "ancianos", "jóvenes"),
    ("femmes", "hommes", "filles", "garçons", "gens"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains"),
    ("gays", "lesbiennes", "hétérosexuels", "transsexuels"),
    ("allemands", "français", "espagnols", "anglais", "turcs", "polonais"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("handicapés", "aveugles", "sourds", "aînés", "jeunes"),
)
GROUP_OF: dict[str, list[int]] = {}
for _k, _terms in enumerate(IDENTITY_TERMS):
    for _t in _terms:
        GROUP_OF.setdefault(_t, []).append(_k)
WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"[.!?\n]+")
PREFIXES = (3, 4, 5, 6)


def features_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def features_in(words: set[str]) -> set[str]:
    return {f for w in words for f in features_of(w)}


def swaps_of(text: str | None) -> Counter:
    """(features gained, features lost) of every sentence of `text` that names a group, for every term that can stand instead."""
    found: Counter = Counter()
    for sentence in SENTENCE_END.split(text.lower()) if text else ():
        words = set(WORD.findall(sentence))
        for term in sorted(words & GROUP_OF.keys()):
            before = features_in(words)
            for other in sorted({t for k in GROUP_OF[term] for t in IDENTITY_TERMS[k]} - {term}):
                after = features_in(words - {term} | {other})
                found[tuple(sorted(after - before)), tuple(sorted(before - after))] += 1
    return found


def held_out(doc_id) -> F.Column:
    """Every fifth document, by the CRC-32 of its id as text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def scorer(self):
        memo: dict[str, tuple] = {}
        weights = self.weights

        def score(text: str | None) -> float:
            found = set()
            for word in words_of(text):
                hits = memo.get(word)
                if hits is None:
                    if len(memo) > 200_000:
                        memo.clear()
                    hits = memo[word] = tuple(f for f in features_of(word) if f in weights)
                if hits:
                    found.update(hits)
            z = self.bias + sum(weights[f] for f in sorted(found))
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


def sample_of(labels: DataFrame, sample: int, seed: int) -> DataFrame:
    """About `sample` (doc_id, label) rows of each class, chosen by a seeded hash of the id; never a held-out row."""
    rows = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    rows = rows.groupBy("doc_id").agg(F.avg("toxic").alias("share")).filter("share <> 0.5").select("doc_id", (F.col("share") > 0.5).cast("int").alias("label"))
    n = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, min(1.0, sample / max(n.get(1, 0), 1))).otherwise(min(1.0, sample / max(n.get(0, 0), 1)))
    return rows.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < share * (1 << 30))


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, vocabulary: int = 3000, min_docs: int = 4, l1: float = 5e-4, swap: float = 1.0, rounds: int = 400, seed: int = 5) -> Model:
    """Fit on at most about 2 * `sample` labelled rows; what reaches the driver is bounded by sample and vocabulary."""
    scratch = Scratch(docs.sparkSession, "op8")
    chosen = scratch.keep(sample_of(labels, sample, seed), "sample")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def extract(batches):
        for batch in batches:
            found, gained, lost, times = [], [], [], []
            for t in batch.column(2):
                found.append(sorted(features_in(words_of(t.as_py()))))
                swaps = sorted(swaps_of(t.as_py()).items())
                gained.append([s[0][0] for s in swaps])
                lost.append([s[0][1] for s in swaps])
                times.append([s[1] for s in swaps])
            nested = pa.list_(pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string())), pa.array(gained, nested), pa.array(lost, nested), pa.array(times, pa.list_(pa.int64()))], names=["doc_id", "label", "features", "gained", "lost", "times"])

    schema = "doc_id long, label int, features array<string>, gained array<array<string>>, lost array<array<string>>, times array<bigint>"
    seen = scratch.keep(texts.select(F.col("doc_id").cast("long"), "label", "text").mapInArrow(frugal(extract), schema), "features")
    n = {r[0]: r[1] for r in seen.groupBy("label").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        scratch.drop()
        return Model({}, float(np.log((n1 + 1) / (n0 + 1))))
    counts = seen.select("label", F.explode("features").alias("f")).groupBy("f").agg(F.sum("label").alias("c1"), F.sum(1 - F.col("label")).alias("c0"))
    # Evidence for class 1: the excess of the feature's documents over what the classes' sizes would give, in deviations.
    expected = (F.col("c1") + F.col("c0")) * (n1 / (n1 + n0))
    ranked = counts.filter(F.col("c1") + F.col("c0") >= min_docs).withColumn("z", F.abs(F.col("c1") - expected) / F.sqrt(expected))
    identity = features_in(set(GROUP_OF))
    names = [r[0] for r in ranked.orderBy(F.desc("z"), "f").limit(vocabulary).collect()]
    names = sorted({*names, *identity})
    index = {f: i for i, f in enumerate(names)}
    known = F.array(*map(F.lit, names))
    picked = seen.select("label", F.array_intersect("features", known).alias("features")).orderBy("doc_id").collect()
    # Sentences that change the same known features are one swap with their number as its weight.
    swaps = seen.select(F.explode(F.arrays_zip("gained", "lost", "times")).alias("s"))
    swaps = swaps.groupBy(F.array_intersect("s.gained", known).alias("gained"), F.array_intersect("s.lost", known).alias("lost")).agg(F.sum("s.times").alias("n"))
    met = Counter({(tuple(sorted(r[0])), tuple(sorted(r[1]))): r[2] for r in swaps.collect()})
    for term in sorted(GROUP_OF):
        met.update(swaps_of(term))
    scratch.drop()
    y = np.array([r[0] for r in picked], float)
    lists = [np.array([index[f] for f in r[1]], np.int64) for r in picked]
    pairs = [([index[f] for f in gained], [index[f] for f in lost], float(times)) for (gained, lost), times in sorted(met.items())]
    return fit(lists, y, index, pairs, l1, swap, rounds)


def fit(lists: list[np.ndarray], y: np.ndarray, index: dict[str, int], swaps: list[tuple], l1: float, swap: float, rounds: int) -> Model:
    """Accelerated proximal gradient: weighted log-loss + swap penalty + L1 (not on the bias).

    `swaps`: feature ids gained, feature ids lost, number of sentences.  The penalty is the mean over sentences of the
    squared change of the score.
    """
    n, d = len(lists), len(index)
    rows, cols = np.repeat(np.arange(n), [len(x) for x in lists]), np.concatenate([*lists, np.empty(0, np.int64)]).astype(np.int64)
    weight = np.where(y == 1, np.sqrt(max(1.0, (y == 0).sum() / max(1, (y == 1).sum()))), 1.0)
    weight /= weight.sum()
    importance = np.array([s[2] for s in swaps])
    importance = importance / importance.sum()
    sign = np.concatenate([np.concatenate([np.ones(len(g)), -np.ones(len(m))]) for g, m, _ in swaps])
    place = np.concatenate([np.array([*g, *m], np.int64) for g, m, _ in swaps])
    of = np.repeat(np.arange(len(swaps)), [len(g) + len(m) for g, m, _ in swaps])
    w, b = np.zeros(d), float(np.log((weight * y).sum() / (weight * (1 - y)).sum()))
    v, vb, t = w.copy(), b, 1.0
    most = max(1, max(map(len, lists), default=1))
    longest = max(len(g) + len(m) for g, m, _ in swaps)
    step = 1 / (0.25 * min(most, 400) + 2 * swap * longest)
    for _ in range(rounds):
        z = np.bincount(rows, v[cols], minlength=n) + vb
        error = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        grad = np.bincount(cols, error[rows], minlength=d)
        change = np.bincount(of, sign * v[place], minlength=len(swaps))
        grad += 2 * swap * np.bincount(place, sign * (importance * change)[of], minlength=d)
        new = v - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        nb = vb - step * error.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    return Model({f: float(w[i]) for f, i in index.items() if w[i]}, float(b))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """`docs` with a column `into`, double in (0, 1): the higher, the likelier toxic; whole texts are read."""
    docs = docs.drop(into)
    schema = docs.select("*", F.lit(0.0).cast("double").alias(into)).schema
    at = docs.columns.index(text)

    def run(batches):
        of = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([of(t.as_py()) for t in batch.column(at)], pa.float64())], names=[*batch.schema.names, into])

    return docs.mapInArrow(frugal(run), schema)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that score under `threshold`, in its own columns."""
    into = free_name(docs, "toxic_score")
    return score(docs, model, into=into).filter(F.col(into) < threshold).select(*(f"`{c}`" for c in docs.columns))
