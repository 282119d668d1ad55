"""The corpus pipeline: language ID, toxicity, near-duplicates, mixing, SentencePiece; each stage works on what the last kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, minhash, mixing, pieces, toxicity
from tessera.llm.common import Scratch, read_table, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; nulls and empty texts go."""
    model = language.train(docs, "text", "lang")
    return language.identify(docs, model, declared=F.col("lang"), host=F.col("source")).filter("lang_kept").select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; trained on the labelled documents of the input that are not held out."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (the smallest id)."""
    return minhash.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mixture(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row."""
    return pieces.digests(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("minhash_dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", pieces_stage),
]

#: Trained models, numpy signatures and a tokeniser: SQL cannot express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage's result is written to the shared folder and read again."""
    docs, scratch = read_table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    result = written(STAGES[-1][1](spark, docs, sf_dir), "pipeline-result")
    scratch.drop()
    return result
