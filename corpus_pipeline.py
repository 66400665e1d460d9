"""The corpus pipeline: language ID, quality rules, exact and near dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the
columns of documents; the last returns the packed pieces with their token ids.
When a stage begins, the result of the one before is written, so the tables that one
worked with are deleted: only a single stage's tables take up space.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import exact_dedup, language, near_dedup, packing, quality
from panelspark.llm.common import discard, recorded, table
from panelspark.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# working tables of the last stage of each application
_working: dict[str, list[str]] = {}


def stage(function: Stage) -> Stage:
    """A stage that begins by deleting what the one before it worked with."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        application = spark.sparkContext.applicationId
        discard(spark, _working.pop(application, []))
        with recorded() as paths:
            result = function(spark, docs, sf_dir)
        _working[application] = paths
        return result

    run_stage.__doc__ = function.__doc__
    return run_stage


@stage
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the others go."""
    return language.keep_identified(docs)


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@stage
def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.exact_dedup(docs)


@stage
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group on five-word shingles at a similarity of 0.8."""
    return near_dedup.near_dedup(docs)


@stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents in windows of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

# SQL expresses neither the learned verdicts nor the packing; tests use brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, function in STAGES[:-1]:
        path = scratch_path(spark, name)
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        discard(spark, before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
