"""Corpus pipeline: toxicity, near duplicates, benchmark leaks, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run`` writes
each stage's rows as Parquet to the shared folder and reads them back as the next one's docs.  All
stages but the last return the columns of ``docs``; the last adds the copy number ``mix_copy``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postlens.llm import decontam, mixing, ngram_join, pii_feistel, toxicity_crf
from postlens.llm.jobs import table, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents predicted toxic go."""
    return toxicity_crf.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each component stays."""
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that hold a benchmark item go."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: personal data become pseudonyms."""
    return pii_feistel.pseudonymise(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents as often as the mix takes them."""
    return mixing.emit(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("mixing", mixing_stage)]

# a trained sequence model and hashed comparisons: not expressible in SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
