"""The corpus pipeline: quality classifier, near copies, decontamination, secrets, mixing.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; it works on all its predecessor kept, and
its result is written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.llm import decontam, jaccard, mixing, quality, secrets
from strata.llm.common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_quality(docs, _table(spark, sf_dir, "labels"))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a Jaccard similarity of 0.8 stays."""
    return jaccard.drop_near_copies(docs, k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontam.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redact_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes anything of, with ``mix_size``, ``mix_target``, ``mix_taken``."""
    return mixing.mixed_documents(docs)


STAGES = [("quality", quality_stage), ("near_copies", near_copy_stage), ("decontamination", decontamination_stage),
          ("secrets", secret_stage), ("mixing", mixing_stage)]

ORACLE_SQL = None  # trees and component search are beyond SQL: tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    before = None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
