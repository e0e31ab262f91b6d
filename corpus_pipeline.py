"""A corpus from raw documents to packed training sequences, one operator a stage.

Each stage takes the documents that its predecessor kept and returns documents (doc_id, text, lang,
source, n_chars); the last returns the pieces of the packed sequences.

All stages take nulls in any column, empty and very long texts, repeated and null ids, repeated rows, an empty table (which
gives an empty one) and further columns, which they drop. Rows are documents of their own, whatever their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactspark.llm import packing, quality, secrets, simhash, suffix
from contactspark.llm.common import numbered, remove, scratch, stored, table
from contactspark.llm.queries import WORD_BPE

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_text(docs: DataFrame, text) -> DataFrame:
    """Documents with another text and its length in characters."""
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. Null, empty and short texts go; repeated rows share a verdict; a null language is as good as a known one."""
    return quality.judge(docs, lang="lang").where("kept").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id (nulls last); of equal ids or none one or the other.

    Null and blank texts are copies of each other, so one of them stays.
    """
    rows = numbered(docs.select(COLUMNS), "doc_id", "row")
    first = simhash.near_duplicates(rows, "row").where("row = component_id").select(F.col("row").alias("first"))
    return rows.join(first.hint("shuffle_hash"), F.expr("row = first"), "left_semi").select(COLUMNS)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages; bytes of a character cut in half go, and so do documents without a word left, null and empty ones among them."""
    cut = suffix.remove_repeats(docs.select(COLUMNS))
    whole = F.when(F.size("removed") == 0, F.col("text")).otherwise(F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit("")))
    cut = with_text(cut, whole)
    return cut.where(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked; null and empty texts stay as they are."""
    found = secrets.scan(docs.select(COLUMNS))
    return with_text(found, secrets.redacted(F.col("text"), F.col("secret_spans")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 2048 tokens. Null and empty texts are one token, repeated rows documents of their own."""
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("repeat removal", repeat_removal), ("secret scan", secret_scan), ("packing", packed)]

#: Fingerprints, repeats and token ids are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the documents of a folder. What a stage has stored goes as soon as the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as made:
            docs = stored(stage(spark, docs, sf_dir), f"stage{k}")
            own = made.pop()  # what this stage returns stays for the next
        remove(spark, before)
        before = [own]
    return STAGES[-1][1](spark, docs, sf_dir)
