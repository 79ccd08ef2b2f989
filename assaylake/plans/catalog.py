"""Registry of named queries: a Spark callable over a table folder and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under a name."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = Query(lambda spark, folder: fn(Tables(spark, folder)), sql)
        return fn
    return wrap


class Tables:
    """The given tables of one folder, read lazily by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def with_sql(*parts: str) -> str:
    """`WITH` list of named parts followed by the final select."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]
