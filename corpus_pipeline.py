"""Corpus pipeline: quality rules, near-dedup, secret removal, source mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of ``documents``.  A stage
first deletes the scratch tables of the stage called before it, whose result
has been written by then.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from aerolens.llm import op1_minhash, op3_packing, op4_secrets, op6_mixing, op10_quality
from aerolens.llm.common import delete, noting, scratch, table

_before: list[str] = []


def _tidy(stage):
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete(spark, _before)
        _before.clear()
        with noting(_before):
            return stage(spark, docs, sf_dir)
    return run_stage


@_tidy
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return op10_quality.keep_good(docs)


@_tidy
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return op1_minhash.drop_near_duplicates(docs)


@_tidy
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts replaced."""
    return op4_secrets.redact(docs)


@_tidy
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix."""
    return op6_mixing.mix(docs)


@_tidy
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences, in the order of the mix.

    Files are read back in any order, so the order is made here again.
    """
    return op3_packing.pack(op6_mixing.mix(docs.select("doc_id", "text", "source")).select("doc_id", "text"))


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("secret_scan", secrets), ("source_mixing", mixing),
          ("packing", packing)]

#: SQL can't express the forest and the packing; the stages are tested against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
