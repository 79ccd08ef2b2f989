"""The training-text pipeline: documents in, packed token sequences out. Every stage works on all rows the one before kept."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assaylake.llm import decontamination, near_copies, packing, personal_data, quality
from assaylake.llm.staging import recorded, release, staged
from assaylake.plans.catalog import Query

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders that the stage before has staged, by application and thread: its result is written by the time the next stage starts.
_LEFT: dict[tuple[str, int], list[str]] = {}


def _stage(work: Stage) -> Stage:
    """The stage, which first deletes what the stage before staged and its documents do not read."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, threading.get_ident())
        stay = release(spark, _LEFT.pop(key, []), docs)
        with recorded() as made:
            out = work(spark, docs, sf_dir)
        _LEFT[key] = stay + made
        return out

    run_stage.__doc__ = work.__doc__
    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules accept."""
    return quality.accepted(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_copies.without_near_copies(docs)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in the text replaced by its kind."""
    return personal_data.redacted(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.packing_report(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_personal_data", redact_personal_data),
    ("pack", pack),
]

#: The near-copy signatures, the posterior and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with recorded() as made:
            rows = staged(stage(spark, rows, sf_dir), name)
        release(spark, before)
        before = made
    return STAGES[-1][1](spark, rows, sf_dir)


QUERIES = {"pipeline": Query(run, ORACLE_SQL)}
