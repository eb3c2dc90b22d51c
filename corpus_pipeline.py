"""A training corpus from raw documents, in five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellex.functions.staging import stage
from tessellex.llm import langid, line_dedup, packing, pii, simhash
from tessellex.llm.queries import vocabulary
from tessellex.session import prepare

#: Below this likeness to every learned language a document is in none of them.
LEAST_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that the labelled ones have; lang is what was found. Without any label nothing is rejected."""
    prepare(spark)
    profiles = langid.fit(docs)
    if not profiles.languages:
        return docs
    judged = langid.predict(docs, profiles).filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return judged.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier ones have; n_chars is that of the new text."""
    done = line_dedup.dedup_lines(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    prepare(spark)
    return simhash.representatives(docs).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars is that of the new text."""
    found = pii.find(docs, out="_pii")
    done = found.withColumn("text", pii.redacted(F.col("text"), F.col("_pii")))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    prepare(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("dedup_lines", dedup_lines), ("near_dedup", near_dedup), ("redact", redact), ("pack", pack)]

#: Profiles, SimHash classes and token ids can't be expressed in SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
