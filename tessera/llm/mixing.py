"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every row gets an exponential key -ln(u) / w: u a seeded hash of the row in (0, 1), w its document's quality weight.  Sorted
by key, any prefix of a source is a weighted sample without replacement.  Targets share `share` of all words by source
weight, stop at `most` times a source's words, and the excess goes to the others (water filling).  A source gives its
complete epochs first; the rest of its target is a prefix in key order, up to the row whose middle passes the rest.

The prefix is found without sorting a source in one task.  A key's place on a logarithmic scale is cut into bins: any one
octave of a 64th holds under half a percent of a source, whatever its weights.  Sums per (source, bin) give the one bin in
which the budget ends; while that bin holds more than `rank_rows` rows it is cut again, 4096-fold; only its rows are ranked.
The outcome is a cut point per source, applied row by row, so texts are never shuffled for it.

Sources themselves are one row each in the plan of targets, which is ordered in one task.

Defined cases: null text has size 0 and weight 1; null source is a source of its own, last in order; rows that are equal in
all columns get ordinals, and so keys and fates of their own, as do rows that share an id (or a null id) but nothing else; very
long texts count whole; sources without words get target 0; columns that are named like working columns are kept and
untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_PATTERN, Scratch, free_name, with_ordinals

WEIGHTS = (5, 2, 1)
#: Marks of markup, tables and shouting that lower a document's quality weight.
SYMBOLS = "#*$%&|<>!"
#: Keys lie between 2**-OCTAVES_BELOW and 2**(64 - OCTAVES_BELOW); a place has LEVELS digits of DIGIT bits.
OCTAVES_BELOW, LEVELS, DIGIT = 53, 4, 12
OUTPUTS = ("m_size", "m_source_size", "m_target", "m_copies")


def number(x: float) -> Column:
    return F.lit(float(x)).cast("double")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def quality_of(text: Column) -> Column:
    """Between 0.05 and 1: three times the share of SYMBOLS is taken off, times the share of distinct lines; 1 for nothing."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    clean = F.greatest(number(0.05), number(1) - number(3) * symbols / F.length(text))
    lines = F.split(text, "\n", -1)
    fresh = F.size(F.array_distinct(lines)) / F.size(lines)
    return F.when(F.length(text) > 0, F.greatest(number(0.05), clean * fresh)).otherwise(number(1))


def keyed(docs: DataFrame, scratch: Scratch, seed: int, quality: Column | None) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with columns for size, key, tie and place, and their names."""
    own = {}
    for wish in ("m_tie", "m_ordinal", "m_key", "m_place", "m_words"):
        own[wish] = free_name(docs, wish)
    rows = with_ordinals(docs, scratch, own["m_tie"], own["m_ordinal"])
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("#"), F.col(own["m_tie"]), F.lit("#"), F.col(own["m_ordinal"]).cast("string"), F.lit(f"#{seed}"))
    u = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + number(0.5)) / number(1 << 52)
    weight = quality_of(F.col("text")) if quality is None else F.greatest(number(1e-6), F.coalesce(quality.cast("double"), number(1)))
    rows = rows.withColumns({own["m_words"]: size_of(F.col("text")), own["m_key"]: -F.log(u) / weight})
    place = F.floor((F.log2(own["m_key"]) + OCTAVES_BELOW) * number(2.0 ** (LEVELS * DIGIT - 6)))
    place = F.least(F.lit((1 << LEVELS * DIGIT) - 1).cast("long"), F.greatest(F.lit(0).cast("long"), F.coalesce(place, F.lit(0).cast("long"))))
    return rows.withColumn(own["m_place"], place), own


def targets(sizes: DataFrame, share: float, most: float) -> DataFrame:
    """(source, source_size) with weight and target; one row per source, so its windows see sources, never documents."""
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * number(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    t = t.withColumns({
        "budget": F.sum("source_size").over(everything) * number(share),
        "before": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "rest": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
    })
    t = t.withColumn("level", (F.col("budget") - F.col("before")) / F.col("rest"))
    free = F.col("level") * F.col("weight") < F.col("cap")
    t = t.withColumn("water", F.min_by(F.when(free, F.col("level")), F.when(free, F.struct(F.col("cap") / F.col("weight"), F.coalesce("source", F.lit("")), F.col("source").isNull()))).over(everything))
    return t.select("source", "source_size", "weight", F.coalesce(F.least("cap", F.col("water") * F.col("weight")), F.col("cap")).alias("target"))


def same(one: str, two: str) -> Column:
    return F.col(one).eqNullSafe(F.col(two))


def ending_bin(rows: DataFrame, plan: DataFrame, scratch: Scratch, level: int, within: DataFrame | None) -> DataFrame:
    """Per source the bin of this level (`at`, inside `within` of the level before) in which `rest` ends; `begin`, `n`."""
    bins = rows.withColumn("at", F.shiftright("place", (LEVELS - level) * DIGIT))
    if within is not None:
        outer = within.select(F.col("source").alias("w_source"), F.col("at").alias("outer"), F.col("begin").alias("base"))
        bins = bins.join(outer, same("source", "w_source") & (F.shiftright("at", DIGIT) == F.col("outer")))
    else:
        bins = bins.withColumn("base", F.lit(0).cast("long"))
    sums = bins.groupBy("source", "at", "base").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    upto = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("begin", F.col("base") + F.coalesce(F.sum("words").over(upto), F.lit(0)))
    sums = sums.join(plan.select(F.col("source").alias("p_source"), "rest"), same("source", "p_source"))
    return scratch.keep(sums.filter("rest > 0 AND begin <= rest AND rest < begin + words").select("source", "at", "begin", "rest", "n"), "bins")


def cuts(rows: DataFrame, scratch: Scratch, share: float, most: float, rank_rows: int) -> DataFrame:
    """Per source: source_size, target, epochs, and `last`, the (key, tie, ordinal) up to which rows are taken once more.

    `rows`: source, size, key, tie, ordinal, place.
    """
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, most)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = scratch.keep(plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "plan")
    level, edge = 1, ending_bin(rows, plan, scratch, 1, None)
    while level < LEVELS and (edge.agg(F.max("n")).first()[0] or 0) > rank_rows:
        level, edge = level + 1, ending_bin(rows, plan, scratch, level + 1, edge)
    edge = edge.select(F.col("source").alias("e_source"), "at", "begin", "rest")
    near = rows.join(edge, same("source", "e_source") & (F.shiftright("place", (LEVELS - level) * DIGIT) == F.col("at")))
    in_order = Window.partitionBy("source").orderBy("key", "tie", "ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = near.withColumn("upto", F.col("begin") + F.sum("size").over(in_order))
    last = ranked.filter(F.col("upto") - F.col("size") / 2 <= F.col("rest")).groupBy("source").agg(F.max(F.struct("key", "tie", "ordinal")).alias("last"))
    # Where not even the first row of the bin is taken, everything before the bin is.
    before = edge.select("e_source", F.shiftleft("at", (LEVELS - level) * DIGIT).alias("bound"))
    ends = before.join(last.withColumnRenamed("source", "l_source"), same("e_source", "l_source"), "left").drop("l_source")
    return plan.drop("weight", "rest").join(ends, same("source", "e_source"), "left").drop("e_source")


def planned(docs: DataFrame, scratch: Scratch, share: float, most: float, seed: int, quality: Column | None, rank_rows: int):
    """The keyed rows, their slim table (doc_id and what the plan needs) with its working columns, and the cuts per source."""
    rows, own = keyed(docs, scratch, seed, quality)
    facts = rows.select("doc_id", "source", *(F.col(own[k]).alias(v) for k, v in (("m_words", "size"), ("m_key", "key"), ("m_tie", "tie"), ("m_ordinal", "ordinal"), ("m_place", "place"))))
    facts = scratch.keep(facts, "keys")
    return rows, own, facts, scratch.keep(cuts(facts, scratch, share, most, rank_rows), "cuts")


def taken(rows: DataFrame, cut: DataFrame, own: dict[str, str], out: dict[str, str]) -> DataFrame:
    """`rows` with source size, target and copies under the names that `out` gives them; columns of these names are replaced."""
    names = {c: free_name(rows, f"c_{c}") for c in cut.columns}
    joined = rows.join(cut.select(*(F.col(c).alias(n) for c, n in names.items())), same("source", names["source"]))
    before = F.col(own["m_place"]) < F.col(names["bound"])
    row = F.struct(F.col(own["m_key"]).alias("key"), F.col(own["m_tie"]).alias("tie"), F.col(own["m_ordinal"]).alias("ordinal"))
    again = F.coalesce(before, F.lit(False)) | F.coalesce(row <= F.col(names["last"]), F.lit(False))
    figures = {"m_source_size": F.col(names["source_size"]), "m_target": F.col(names["target"]), "m_copies": F.col(names["epochs"]) + again.cast("long")}
    return joined.withColumns({out[k]: v for k, v in figures.items()}).drop(*names.values())


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 17, quality: Column | None = None, rank_rows: int = 100_000) -> DataFrame:
    """Every row of `docs` (doc_id, text, source, ...) with m_size, m_source_size, m_target and m_copies, the times it is taken.

    `quality`: an expression over `docs` for the document's weight (a learned score, say); by default see quality_of.
    Columns of `docs` that are named like the four results are replaced.
    """
    docs = docs.drop(*OUTPUTS)
    scratch = Scratch(docs.sparkSession, "op10")
    rows, own, _, cut = planned(docs, scratch, share, most, seed, quality, rank_rows)
    scratch.drop("keys", "bins", "plan")
    out = taken(rows.withColumn("m_size", F.col(own["m_words"])), cut, own, {c: c for c in OUTPUTS})
    return out.select(*(f"`{c}`" for c in docs.columns), *OUTPUTS)


def mix_sizes(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 17, quality: Column | None = None, rank_rows: int = 100_000) -> DataFrame:
    """The same as doc_id, source and the four figures only; texts are read once."""
    scratch = Scratch(docs.sparkSession, "op10")
    _, _, facts, cut = planned(docs, scratch, share, most, seed, quality, rank_rows)
    scratch.drop("bins", "plan")
    own = {"m_key": "key", "m_tie": "tie", "m_ordinal": "ordinal", "m_place": "place"}
    return taken(facts.withColumn("m_size", F.col("size")), cut, own, {c: c for c in OUTPUTS}).select("doc_id", "source", *OUTPUTS)


def mixture(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 17, quality: Column | None = None, rank_rows: int = 100_000) -> DataFrame:
    """The mixed corpus: the rows of `docs` as often as they are taken, in its own columns."""
    scratch = Scratch(docs.sparkSession, "op10")
    rows, own, _, cut = planned(docs, scratch, share, most, seed, quality, rank_rows)
    scratch.drop("keys", "bins", "plan")
    out = {c: free_name(rows, f"x_{c}") for c in (*OUTPUTS, "copy")}
    times = F.sequence(F.lit(1), F.col(out["m_copies"]).cast("int"))
    return taken(rows, cut, own, out).filter(F.col(out["m_copies"]) > 0).withColumn(out["copy"], F.explode(times)).select(*(f"`{c}`" for c in docs.columns))
