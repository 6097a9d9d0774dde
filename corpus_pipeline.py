"""From documents to training pieces: five operators in a row, each stage's table written before the next reads it.

quality rules drop documents, near-duplicates keep one of each group, found secrets are blanked out, sources are mixed
(every document at least once, at most twice), and what is left is encoded. All stages but the last return the columns
of documents. Before a stage the executors give back what the one before it has left in their heaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import mixing, near_dup, pieces, quality_rules, secret_scan
from docloom.llm.common import documents, release, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filtered(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return near_dup.deduplicated(docs, k=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return secret_scan.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return mixing.mixed_documents(docs, floor=1.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return pieces.encoded(docs)


STAGES = [("quality_rules", quality), ("near_dedup", dedup), ("secret_scan", secrets), ("source_mix", mix), ("sentencepiece", encode)]

#: Near-duplicates and piece encoding have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
