"""Language identification by Bayesian evidence fusion.

posterior(lang) ~ prior(lang | host) * P(declared | lang) * P(suffix | lang) * P(text | lang) ** temper

- other: a declared language (of two or three letters) that has no text model is a candidate of its own, by its declaration
  and the prior `other`, with the uniform text model;
- unknown: a class of its own with prior `unknown` and the uniform text model, so that only texts that fit no language
  by a wide margin are given up, however short the others are;
- text: hashed byte 4-grams of the lower-cased whole text under one smoothed multinomial per language, fitted on a
  bounded sample (`sample` texts per declared language); likelihoods are integers (1/1024 nat), so sums are exact and do
  not depend on batches.
- declared: the language of the markup (or of the record), taken to be right with probability `trust`.
- suffix: the country suffix of the address, with a fixed table of what suffixes say.
- host: counts of text-only decisions per host, smoothed towards its registered domain, which is smoothed towards all
  rows.  They come from one grouped aggregation with map-side combine, so a host with a third of all rows costs nothing.

Priors meet the rows by host: a broadcast while Spark finds them small enough, else a shuffled join whose hot hosts are
split by adaptive execution.

Defined cases: a null or empty text has no evidence of its own and is rejected as "und"; null declared, suffix or host
count as absent; declared values that are no language code are ignored; repeated rows are decided alike; very long texts are
read whole; columns named like the results are replaced and all others, whatever their names, pass through; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, runs_of, written

BUCKETS = 1 << 16
SCALE = 1024
#: Text scored at a time in a task; its scratch arrays take some 30 times as much.
PART_BYTES = 1_000_000
UNKNOWN = "und"
#: Country suffixes and the language that they speak for.  Fixed values.
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "ch": "de", "fr": "fr", "be": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "ie": "en", "au": "en", "nz": "en"}


@dataclass
class TextModel:
    languages: list[str]
    #: int32[BUCKETS, len(languages)]: gain over the uniform model, in 1/SCALE nats.
    gains: np.ndarray


def gram_buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of every byte 4-gram of the lower-cased texts, end to end, and where each text's begin.

    Each text is followed by three line feeds, so its grams never reach into the next one.
    """
    parts = [(t.lower().encode("utf-8", "surrogatepass") + b"\n\n\n") if t else b"" for t in texts]
    sizes = np.array([max(0, len(p) - 3) for p in parts], np.int64)
    raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    if len(raw) < 4:
        return np.empty(0, np.uint16), np.concatenate([[0], np.cumsum(sizes)])
    grams = raw[:-3] | (raw[1:-2] << np.uint32(8)) | (raw[2:-1] << np.uint32(16)) | (raw[3:] << np.uint32(24))
    keys = ((grams * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)
    begins = np.concatenate([[0], np.cumsum([len(p) for p in parts])])[:-1]
    inside = np.zeros(len(keys) + 4, np.int8)
    np.add.at(inside, begins[sizes > 0], 1)
    np.add.at(inside, (begins + sizes)[sizes > 0], -1)
    return keys[np.cumsum(inside, dtype=np.int8)[: len(keys)] > 0], np.concatenate([[0], np.cumsum(sizes)])


def train(docs: DataFrame, text: str, declared: str, sample: int = 300, max_languages: int = 100, alpha: float = 0.05, seed: int = 3) -> TextModel:
    """Fit on about `sample` distinct texts per declared language; at most BUCKETS counts per language reach the driver.

    `max_languages` bounds the size of the model (256 KB each): the commonest ones get a text model, all others stay
    candidates by their declaration (see the module's text).
    """
    rows = docs.select(F.col(text).cast("string").alias("text"), F.lower(F.col(declared).cast("string")).alias("lang")).filter("text IS NOT NULL AND text <> '' AND lang IS NOT NULL AND lang <> ''")
    totals = [(r[0], r[1]) for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()]
    languages = sorted(x[0] for x in totals)
    if not languages:
        return TextModel([], np.zeros((BUCKETS, 0), np.int32))
    share = F.lit(0.0)
    for lang, n in totals:
        share = F.when(F.col("lang") == lang, min(1.0, sample / n)).otherwise(share)
    # Copies of a text count once, so that a text with many copies does not undo the bound.
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 30)) < share * (1 << 30)).distinct()

    def count(batches):
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                k, n = np.unique(gram_buckets([text.as_py()])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k, pa.int64()), pa.array(n, pa.int64())], names=["lang", "k", "n"])

    table = np.zeros((BUCKETS, len(languages)))
    counted = chosen.select("text", "lang").mapInArrow(frugal(count), "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n"))
    got = counted.toPandas()
    table[got["k"].to_numpy(int), [languages.index(x) for x in got["lang"]]] = got["n"].to_numpy(float)
    rate = (table + alpha) / (table.sum(axis=0) + alpha * BUCKETS)
    return TextModel(languages, np.rint(np.log(rate * BUCKETS) * SCALE).astype(np.int32))


def text_gains(docs: DataFrame, model: TextModel, text: str = "text") -> DataFrame:
    """`docs` with x_gains array<long> (log-likelihood of each language against the uniform model) and x_grams long."""
    docs = docs.drop("x_gains", "x_grams")
    schema = docs.select("*", F.lit(None).cast("array<bigint>").alias("x_gains"), F.lit(0).cast("long").alias("x_grams")).schema
    at, n_lang = docs.columns.index(text), len(model.languages)

    def run(batches):
        for whole in batches:
            lengths = pa.compute.fill_null(pa.compute.binary_length(whole.column(at)), 0).to_pylist()
            for start, end in runs_of(lengths, PART_BYTES):
                batch = whole.slice(start, end - start)
                keys, ends = gram_buckets(batch.column(at).to_pylist())
                sizes = np.diff(ends)
                sums = np.zeros((len(sizes), n_lang), np.int64)
                full = np.flatnonzero(sizes)
                if len(full):
                    for k in range(n_lang):
                        sums[full, k] = np.add.reduceat(model.gains[:, k][keys], ends[:-1][full], dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * n_lang), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(sizes, pa.int64())], names=[*whole.schema.names, "x_gains", "x_grams"])

    return docs.mapInArrow(frugal(run), schema)


def registered_domain(host: Column) -> Column:
    """The last two labels of a host name; a name without a dot belongs to no domain."""
    return F.when(host.contains("."), F.substring_index(host, ".", -2))


def markup_language(html: Column) -> Column:
    """The lang attribute of the html tag, its primary subtag."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def identify(
    docs: DataFrame, model: TextModel, text: str = "text", declared: Column | None = None, host: Column | None = None,
    trust: float = 0.9, temper: float = 0.1, host_weight: float = 20.0, domain_weight: float = 50.0, unknown: float = 0.01, other: float = 0.05,
) -> DataFrame:
    """`docs` with lang_id, lang_posterior, lang_text (text alone) and lang_kept.

    `declared` and `host` are expressions over `docs`; either may be absent.  lang_kept is false where "unknown" is likelier
    than every language, or where there is no text.
    """
    names = [c for c in docs.columns if c not in ("lang_id", "lang_posterior", "lang_text", "lang_kept")]
    langs, none = model.languages, F.lit(None).cast("string")
    if not langs:
        return docs.select(*(f"`{c}`" for c in names), F.lit(UNKNOWN).alias("lang_id"), F.lit(0.0).alias("lang_posterior"), F.lit(UNKNOWN).alias("lang_text"), F.lit(False).alias("lang_kept"))
    # The input's row travels as one struct beside its text, so none of its names can clash with a working column.
    whole = docs.schema[text].dataType.simpleString() != "string"  # then its text is not the column itself
    rest = [c for c in names if c != text or whole]
    row = F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.struct(F.lit(0).alias("none"))
    base = docs.select(row.alias("x_row"), F.col(f"`{text}`").cast("string").alias("x_text"), F.lower(declared if declared is not None else none).alias("x_declared"), F.lower(host if host is not None else none).alias("x_host"))
    scored = text_gains(base, model, "x_text")
    best = F.array_max("x_gains")
    guess = F.when((F.col("x_grams") > 0) & (best > 0), F.element_at(F.array(*map(F.lit, langs)), F.array_position("x_gains", best).cast("int")))
    scored = scored.withColumn("x_guess", guess)

    slim = written(scored.select("x_host", "x_guess").filter("x_guess IS NOT NULL").groupBy("x_host", "x_guess").count(), "op1-hosts")
    seen = dict(slim.groupBy("x_guess").agg(F.sum("count")).collect())  # one number per language of the model
    everywhere = [(seen.get(lang, 0) + 1) / (sum(seen.values()) + len(langs)) for lang in langs]
    priors = host_priors(slim, langs, everywhere, host_weight, domain_weight)
    joined = scored.join(priors, scored["x_host"].eqNullSafe(priors["p_host"]), "left")

    suffix = F.create_map(*(F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair))[F.substring_index("x_host", ".", -1)]
    suffix = F.when(F.col("x_host").contains("."), suffix)
    known = F.col("x_declared").isin(*langs)
    code = F.coalesce(F.col("x_declared").rlike("^[a-z]{2,3}(-|$)") & ~known, F.lit(False))

    def evidence(i: int) -> Column:
        prior = F.log(F.coalesce(F.element_at("p_prior", i + 1), F.lit(everywhere[i])))
        said = F.when(known, F.when(F.col("x_declared") == langs[i], np.log(trust).item()).otherwise(np.log((1 - trust) / max(1, len(langs) - 1)).item())).when(code, np.log((1 - trust) / len(langs)).item()).otherwise(0.0)
        from_suffix = F.when(suffix.isin(*langs), F.when(suffix == langs[i], np.log(0.7).item()).otherwise(np.log(0.3 / max(1, len(langs) - 1)).item())).otherwise(0.0)
        return prior + said + from_suffix + F.element_at("x_gains", i + 1) * F.lit(temper / SCALE)

    # A declared language without a text model: its text says as much as the uniform model's.
    said_other = F.when(code, F.lit(np.log(other * trust).item())).otherwise(F.lit(-1e300))
    logs = joined.withColumn("x_logs", F.array(*(evidence(i) for i in range(len(langs))), said_other))
    nothing = F.lit(np.log(unknown).item()) - F.when(known | code, np.log(len(langs)).item()).otherwise(0.0)
    logs = logs.withColumn("x_top", F.array_max("x_logs")).withColumn("x_none", nothing)
    logs = logs.withColumn("x_most", F.greatest("x_top", "x_none"))
    total = F.aggregate("x_logs", F.exp(F.col("x_none") - F.col("x_most")), lambda a, x: a + F.exp(x - F.col("x_most")))
    winner = F.element_at(F.array(*map(F.lit, langs), F.coalesce("x_declared", F.lit(UNKNOWN))), F.array_position("x_logs", F.col("x_top")).cast("int"))
    fits = F.coalesce((F.col("x_grams") > 0) & (F.col("x_top") >= F.col("x_none")), F.lit(False))
    posterior = F.when(fits, F.round(F.exp(F.col("x_top") - F.col("x_most")) / total, 9)).otherwise(0.0)
    kept = [F.col("x_row").getField(c).alias(c) if c in rest else F.col("x_text").alias(c) for c in names]
    return logs.select(*kept, F.when(fits, winner).otherwise(UNKNOWN).alias("lang_id"), posterior.alias("lang_posterior"), F.coalesce("x_guess", F.lit(UNKNOWN)).alias("lang_text"), fits.alias("lang_kept"))


def host_priors(counts: DataFrame, langs: list[str], everywhere: list[float], host_weight: float, domain_weight: float) -> DataFrame:
    """p_host, p_prior array<double>: per host, smoothed towards its domain, smoothed towards all rows.

    `counts`: x_host, x_guess, count.  Everything is a sum over grouped counts; texts play no part.
    """
    n = F.array(*(F.sum(F.when(F.col("x_guess") == lang, F.col("count")).otherwise(0)).cast("double") for lang in langs))
    host = counts.groupBy("x_host").agg(n.alias("h")).withColumn("x_domain", registered_domain(F.col("x_host")))
    domain = counts.withColumn("x_domain", registered_domain(F.col("x_host"))).groupBy("x_domain").agg(n.alias("d")).withColumnRenamed("x_domain", "y_domain")

    def smooth(own: str, weight: float, towards) -> Column:
        size = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.transform(own, lambda x, i: (x + weight * F.get(towards, i)) / (size + weight))

    joined = host.join(domain, F.col("x_domain").eqNullSafe(F.col("y_domain"))).withColumn("d", smooth("d", domain_weight, F.array(*map(F.lit, everywhere))))
    return written(joined.select(F.col("x_host").alias("p_host"), smooth("h", host_weight, F.col("d")).alias("p_prior")), "op1-priors")
