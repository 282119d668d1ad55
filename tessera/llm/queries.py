"""One query per operator over its whole table, and their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, language, licences, minhash, mixing, pieces, quality, sharding, toxicity, video
from .common import read_table, shared_dir


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: text, the declared language of the record, and the source as host."""
    docs = read_table(spark, sf_dir, "documents")
    model = language.train(docs, "text", "lang")
    found = language.identify(docs, model, declared=F.col("lang"), host=F.col("source"))
    return found.select("doc_id", "lang_id", "lang_posterior", "lang_text", F.col("lang_kept").alias("kept"))


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: their visible text, the language that the markup declares, the address' suffix and its host's prior."""
    docs, pages = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "pages")
    model = language.train(docs, "text", "lang")
    visible = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    rows = pages.select("page_id", visible.alias("text"), language.markup_language(F.col("html")).alias("declared"), language.host_of(F.col("url")).alias("host"))
    found = language.identify(rows, model, declared=F.col("declared"), host=F.col("host"))
    return found.select("page_id", "lang_id", "lang_posterior", "lang_text", F.col("lang_kept").alias("kept"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return chat.digests(chat.format_conversations(turns.unionByName(extra)))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = licences.scan(docs, licences.train(docs))
    return found.select("doc_id", "n_paragraphs", F.array_join("families", ",").alias("families"), F.size("hits").cast("long").alias("n_licences"), F.to_json("hits").alias("hits"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read_table(spark, sf_dir, "documents"))
    figures = [F.round(c, 6).alias(c) for c in (*quality.UNITS, "entropy")]
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", *figures)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    stored = video.encode_media(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")).drop("text")
    return video.read_media(stored)


def media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timed clips (shots) of every document's film."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return video.clips(video.encode_media(docs).drop("text"), "doc_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    stored = sharding.write_shards(docs, f"{shared_dir(spark)}/op9-shards-{uuid.uuid4().hex}")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    return stored.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sizes(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("m_size").alias("size"), F.col("m_source_size").alias("source_size"), F.col("m_target").alias("target"), (F.col("m_size") * F.col("m_copies")).alias("taken"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_license_scan": op3_license_scan,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_quality_rules": op6_quality_rules,
    "op7_media_columns": op7_media_columns,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_mixing": op10_mixing,
    "pages_language_id": pages_language_id,
    "media_clips": media_clips,
}

ESCAPED = r"regexp_replace(replace({0}, '␛', '␛e'), '(<|\[)(/?s>|/?INST\])', '\1␛\2', 'g')"
WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES = {
    "op2_chat_formatting": rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
      c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
        CAST(sum(length('<s>[INST] ') + length({ESCAPED.format("role")}) + 1 + length({ESCAPED.format("text")}) + length(' [/INST]</s>')) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id)
      SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, true AS verified FROM c""",
    "op4_minhash_dedup": rf"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(f"translate(text, '{UPPER}', '{LOWER}')")} AS w FROM documents),
      sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
      n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
      pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
      links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
      reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
      least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
      SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
      FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least ON a = d.doc_id""",
    "op10_mixing": rf"""WITH p AS (SELECT *, md5(concat_ws('␟', coalesce(CAST(doc_id AS VARCHAR), '␀'), coalesce(text, '␀'), coalesce(lang, '␀'), coalesce(source, '␀'), coalesce(CAST(n_chars AS VARCHAR), '␀'))) AS tie FROM documents),
      o AS (SELECT *, row_number() OVER (PARTITION BY tie) - 1 AS ordinal FROM p),
      q AS (SELECT *, CASE WHEN length(text) > 0 THEN greatest(CAST(0.05 AS DOUBLE),
          greatest(CAST(0.05 AS DOUBLE), 1 - CAST(3 AS DOUBLE) * (length(text) - length(translate(text, '#*$%&|<>!', ''))) / length(text))
          * (CAST(len(list_distinct(string_split(text, chr(10)))) AS DOUBLE) / len(string_split(text, chr(10))))) ELSE 1 END AS quality FROM o),
      d AS (SELECT doc_id, source, tie, ordinal, CAST(coalesce(len({WORDS.format("text")}), 0) AS BIGINT) AS size,
        -ln((CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '#' || tie || '#' || ordinal || '#17'), 1, 13)) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))
          / quality AS key FROM q),
      s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
      c AS (SELECT *, CAST(2 AS DOUBLE) * source_size AS cap, (SELECT sum(source_size) FROM s) * CAST(1.5 AS DOUBLE) AS budget FROM s),
      l AS (SELECT *, (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM c WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
      t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, cap / w) FROM l WHERE level * w < cap), 1e300) * w) AS target FROM l),
      e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
      r AS (SELECT d.*, source_size, target, epochs, target - epochs * source_size AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY key, tie, ordinal) AS upto
        FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
      SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN rest > 0 AND upto - CAST(size AS DOUBLE) / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r""",
}
