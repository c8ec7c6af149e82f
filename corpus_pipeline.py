"""Corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame that the next one gets as its docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconlake.llm import packing, quality_rules, secret_scan, simhash, suffix_dedup
from reconlake.llm.queries import TOKENIZER
from reconlake.plans.lineage import importable, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least length in bytes of a repeated passage of over 50 words: 51 words at under five bytes with their space; and its anchor's.
PASSAGE, PASSAGE_ANCHOR = 240, 64


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the log-likelihood threshold go. Null and empty texts fail; repeated rows are judged
    alike; an empty table stays empty; columns other than COLUMNS go.

    Verdicts are stored before they filter: a filter on them would be pushed down and have them worked out twice.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = stored(quality_rules.quality(docs, labels).select(*COLUMNS, "kept"), "judged")
    return judged.where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: 0.8 of the 5-word windows in common, found by SimHash.

    The smallest id stays, ids may be null and repeat; texts without words, null or empty, are one group. An empty table stays
    empty; columns other than COLUMNS go.
    """
    return simhash.one_of_each(docs, COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that occur twice or more go from the texts, all occurrences; every document stays, if need be with an empty text.

    Repeats are strings of PASSAGE bytes, merged where they overlap; a merged one goes if it holds over 50 words, or 400 bytes
    of whatever kind. Null texts become empty, repeated rows lose all that they share, an empty table stays empty; columns
    other than COLUMNS are not read.
    """
    out = suffix_dedup.remove_repeats(docs, length=PASSAGE, anchor=PASSAGE_ANCHOR, keep=("lang", "source"), as_text=True, min_words=51, long=400)
    return out.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Owner-specific live-looking credentials are replaced by a mark; widely copied ones stay.

    Every row stays, repeated rows too. Null texts stay null, null sources count as one; an empty table stays empty.
    """
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every row with its place in a sequence of at most 2048 tokens. Null texts count as empty and give one piece."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("suffix_array_dedup", suffix_array_dedup), ("secret_scans", secret_scans), ("best_fit_packing", best_fit_packing)]

#: SQL can express neither the fingerprints nor the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = importable(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
