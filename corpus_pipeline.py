"""From raw documents to token ids: language, near duplicates, repeated passages,
benchmark leaks, encoding. Each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm import decontamination, language_id, near_dedup, sentencepiece_codec, suffix_dedup
from provena.llm.common import saved, table
from provena.llm.repeats import KEY, text_key

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
#: Repeated passages are cut when they have over so many words, or 400 bytes; so many bytes are
#: looked for, which 51 words have unless they are of under three letters on the average.
PASSAGE_WORDS, PASSAGE_BYTES, PASSAGE_GRAM = 50, 200, 96


def keyed(docs: DataFrame) -> DataFrame:
    """docs (DOCUMENT) with the key of each text."""
    return docs.select(*DOCUMENT, *text_key(F.coalesce("text", F.lit(""))))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for the rows of an id, which may be null, and a text in gone (doc_id, k1, k2)."""
    rows, gone = keyed(docs).alias("d"), gone.alias("g")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.k1") == F.col("g.k1")) & (F.col("d.k2") == F.col("g.k2"))
    return rows.join(gone, same, "left_anti").select(*DOCUMENT)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter, null and empty ones too, and those whose language is ambiguous.
    The languages are learned from the rows of docs that have one; ids do not matter."""
    found = language_id.identify(docs, language_id.fit(docs), keep=DOCUMENT)
    return found.filter(~F.col("ambiguous")).select(*DOCUMENT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) keep the document of
    smallest id. Rows of one id are one document; of those without an id the copies of a
    document that has one go, all others stay. Null and empty texts are no duplicates."""
    gone = near_dedup.dedup(docs, with_keys=True).filter(~F.col("kept")).select("doc_id", *KEY)
    return without(docs, saved(spark, gone.distinct(), "near-duplicates"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take passages of over PASSAGE_WORDS words that occur more than once out of the texts, all
    occurrences; shorter ones stay. Null texts stay null, n_chars follows the text."""
    cut = suffix_dedup.dedup_texts(docs.select(*DOCUMENT), PASSAGE_BYTES, PASSAGE_GRAM, PASSAGE_WORDS)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, also with other numbers, names or units;
    rows are dropped one by one, whatever their id."""
    gone = saved(spark, decontamination.contaminated(keyed(docs), table(spark, sf_dir, "benchmark"), keep=("doc_id", *KEY)).select("doc_id", *KEY).distinct(), "leaks")
    return without(docs, gone)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, as little-endian int32s, row by row; null and empty texts have none."""
    return sentencepiece_codec.encode(docs, keep=("doc_id", "lang", "source", "n_chars"))


STAGES = [
    ("language_id", keep_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]
#: The stages are learned, iterative or beyond SQL; tests hold each against a brute-force version,
#: language identification against known languages, encoding against the original library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
