"""The corpus pipeline: each stage works on all that its predecessor kept, written as Parquet in the shared folder between them.

Null, empty and very long texts, ties, repeated rows, empty tables and clashing column names are treated as the stages'
operators state; a row with a null doc_id always stays, since no stage can name it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempograph.llm import decontamination, exact_dedup, near_dedup, packing, quality
from tempograph.llm.common import delete, scratch, table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.without_near_duplicates(docs)  # five words, 0.8


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("exact_dedup", exact_copies),
    ("minhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark_free),
    ("packing", packed),
]
#: SQL expresses neither the trees nor the dynamic program; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's tables, and its predecessor's documents, are deleted once its own are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
