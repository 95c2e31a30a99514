"""Training-corpus pipeline: quality rules, exact dedup, near-dedup, source mix, BPE encoding.

Every stage works on all rows its predecessor kept; each is written as Parquet in the
shared folder and read again, so a lost executor costs part of one stage. Repeated rows, very
long texts, empty tables and further columns of any name pass through every stage but the
last, which returns columns of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pergament.llm import bpe, chunk_dedup, common, mixing, quality, simhash
from pergament.llm.registry import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null, empty and white-space texts are rejected."""
    return quality.keep(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal after white-space normalisation, the smallest doc_id's row (a null doc_id last, null text as empty)."""
    return chunk_dedup.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles, similarity 0.8), the smallest doc_id's row (a null doc_id last)."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; a null source is a source of its own."""
    return mixing.take(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text; a null text has no tokens."""
    return bpe.digest(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", bpe_encode),
]

#: The mix and the fingerprints have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.save(stage(spark, docs, sf_dir), name)
    return docs
