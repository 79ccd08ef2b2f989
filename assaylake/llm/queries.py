"""Registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.catalog import Query, Tables
from . import decontamination, languages, near_copies, packing, periodic_runs, personal_data, quality, secrets, sharding, token_counts, token_files, toxicity, whitening

QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = Query(lambda spark, folder: fn(Tables(spark, folder)), sql)
        return fn
    return wrap


@query("op10_benchmark_decontamination")
def op10(t: Tables) -> DataFrame:
    return decontamination.leaking_pairs(t.documents, t.benchmark)


@query("op6_quality_rules")
def op6(t: Tables) -> DataFrame:
    return quality.quality_report(t.documents)


@query("op5_token_counts")
def op5(t: Tables) -> DataFrame:
    return token_counts.token_counts(t.documents)


@query("op4_packing")
def op4(t: Tables) -> DataFrame:
    return packing.packing_report(t.documents)


@query("op8_sharding")
def op8(t: Tables) -> DataFrame:
    return sharding.sharding_report(t.documents)


@query("op9_personal_data")
def op9(t: Tables) -> DataFrame:
    return personal_data.personal_data_report(t.documents)


@query("op2_secret_scan")
def op2(t: Tables) -> DataFrame:
    return secrets.secrets_report(t.documents)


@query("op1_near_copies")
def op1(t: Tables) -> DataFrame:
    return near_copies.near_copy_classes(t.documents)


@query("op7_language_id")
def op7(t: Tables) -> DataFrame:
    return languages.languages_of(t.documents)


@query("op3_toxicity")
def op3(t: Tables) -> DataFrame:
    return toxicity.toxicity(t.documents, t.labels)


@query("op11_periodic_runs")
def op11(t: Tables) -> DataFrame:
    return periodic_runs.runs_report(t.documents)


@query("op12_embedding_whitening")
def op12(t: Tables) -> DataFrame:
    return whitening.whitening_report(t.embeddings)


@query("op13_token_files")
def op13(t: Tables) -> DataFrame:
    return token_files.token_files_report(t.documents)
