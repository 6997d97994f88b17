"""The thin queries over the corpus operators, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_id, lm_scoring, near_dedup, oracle, phrase_dedup, quality_rules, sentencepiece_codec, suffix_dedup, toxicity, warc
from .common import fold, table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold() == 1).alias("held_out"))
    model = lm_scoring.fit(docs.filter(~F.col("held_out")))
    return lm_scoring.score(docs, model, keep=("doc_id", "held_out"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentencepiece_codec.encode(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "parity", "round_trip")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).drop("spans")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(table(spark, sf_dir, "documents"), width=2)


def op10_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.dedup(table(spark, sf_dir, "documents")).drop("spans")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.assess(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold() == 0).alias("held_out"))
    model = toxicity.fit(docs.filter(~F.col("held_out")), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=("doc_id", "held_out"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold() == 0).alias("held_out"))
    return language_id.identify(docs, language_id.fit(docs.filter(~F.col("held_out"))), keep=("doc_id", "held_out"))


#: In the order of the operators' numbers.
QUERIES = (op1_lm_scoring, op2_decontamination, op3_sentencepiece_codec, op4_suffix_dedup, op5_quality_rules, op6_toxicity, op7_warc, op8_language_id, op9_near_dedup, op10_phrase_dedup)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    """The others are learned, or need rules that SQL lacks; tests hold them against brute force."""
    return {"op4_suffix_dedup": oracle.SUFFIX_DEDUP, "op7_warc": oracle.WARC, "op9_near_dedup": oracle.NEAR_DEDUP, "op10_phrase_dedup": oracle.PHRASE_DEDUP}
