"""The corpus pipeline over ``documents``: each stage calls one operator of ``clickrank.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads again
as the next stage's ``docs``.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickrank.llm import decontaminate, jaccard_join, mixing, quality_rules, secret_scan
from clickrank.llm.common import settled, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    return quality_rules.keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 or more, the smallest id stays."""
    return jaccard_join.keep_one(docs, jaccard_join.JaccardConfig(words=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark windows in a twentieth of their words or more go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that the scan finds is replaced by a mark; all documents stay."""
    ledger, _ = secret_scan.scan(docs)
    return secret_scan.redact(docs, ledger)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows by epoch, in the proportions of the domain, language and source weights."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secrets),
    ("mixing", mixture),
]

#: The decision list is learned from labels step by step, which SQL can't express; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, f"pipeline-{name}", lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
