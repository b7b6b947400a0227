"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Every stage works on all rows that the one before kept. All but the last return the columns
``doc_id, text, lang, source, n_chars``; packing returns one row for each piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import decontaminate, langid, nearduplicates, queries, substrings
from wakeline.llm.text import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Below this share of letters in one language a text is a mixture without a main one.
MIN_LANGUAGE_SHARE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, in scripts that no language uses, or without a main language, go.

    Null and empty texts have no letter. Repeated rows stand or fall together.
    """
    model = langid.learned(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.labelled(docs.select(*COLUMNS), model, name="_language", with_spans=False)
    known = (F.col("_language.lang") != langid.UNKNOWN) & (F.col("_language.score") >= MIN_LANGUAGE_SHARE)
    return found.where(known).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest ``doc_id``, a null one last.

    Documents are told apart by number and text, so copies that share a number or have none go
    too. Of repeated rows one stays. Null texts and those without words are no copies of others.
    """
    found = nearduplicates.members(docs)
    rows = found.groupBy("doc_id", "text_hash").agg(F.bool_or("stays").alias("stays"), F.count(F.lit(1)).alias("rows"))
    rows = stored(rows.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "stays", "rows"), "near-duplicate-rows")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    once = docs.join(rows.where("not stays or rows > 1"), same, "left_anti").select(*COLUMNS)
    again = docs.join(rows.where("stays and rows > 1"), same, "left_semi").select(*COLUMNS)
    return once.unionByName(again.dropDuplicates(["doc_id", "text"]))


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of spans that occur earlier go, and documents of which nothing is left.

    Texts without words stay as they are. Rows that share a number are one document here.
    """
    found = substrings.without_repeats(docs)
    some_left = (F.col("n_words") == 0) | (F.col("n_removed") < F.col("n_words"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return found.where(some_left).withColumn("n_chars", n_chars).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold most of a benchmark item go; null texts and items hold nothing."""
    found = decontaminate.contaminated(docs, queries.table(spark, sf_dir, "benchmark"))
    bad = found.select(F.col("doc_id").alias("_bad"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_bad")) & (F.xxhash64("text") == F.col("_hash"))
    return docs.join(bad, same, "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece; a null or empty text gives the one that holds the end."""
    return queries.packed_digest(docs)


STAGES = [
    ("language", language),
    ("near-duplicates", near_duplicates),
    ("repeated-spans", repeated_spans),
    ("decontamination", decontamination),
    ("packing", packing),
]

# SQL has neither the tokenizer nor the language model; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
