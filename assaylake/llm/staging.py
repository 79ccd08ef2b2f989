"""Tables written between passes, and the shape every operator takes its documents in."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONF = "spark.checkpoint.dir"
#: Folders staged inside `recorded`, so that they can go before the session ends.
_MADE: ContextVar[list[str] | None] = ContextVar("staged_folders", default=None)
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; only a local session without the setting gets a folder of its own."""
    folder = spark.conf.get(CONF, None)
    if not folder:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError(f"set {CONF} to a folder every executor can reach")
        folder = "file://" + tempfile.mkdtemp(prefix="assaylake-")
        spark.conf.set(CONF, folder)
    return folder.rstrip("/")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Rows of an Arrow batch for what is written inside, so that a task holds few whole texts at once."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write the rows to the shared folder and read them again.

    Later passes read the files, so a lost executor costs only its running tasks and values made by position
    (row numbers, offsets) are fixed. The files go when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _delete_at_exit(spark, path)
    if _MADE.get() is not None:
        _MADE.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that are staged inside."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)


def _folders(table: DataFrame) -> set[str]:
    """Names of the folders a table reads; staged ones have names of their own."""
    return {file.rsplit("/", 2)[-2] for file in table.inputFiles()}


def release(spark: SparkSession, folders: list[str], *readers: DataFrame) -> list[str]:
    """Delete staged folders that none of the readers reads; gives those that stay."""
    used = set().union(*(_folders(r) for r in readers)) if folders else set()
    stay = [f for f in folders if f.rsplit("/", 1)[-1] in used]
    for folder in folders:
        if folder not in stay:
            _path(spark, folder, lambda system, target: system.delete(target, True))
    return stay


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """make(), whose last step is staged; what it staged on the way is deleted."""
    with recorded() as made:
        out = make()
    stay = release(spark, made, out)
    if _MADE.get() is not None:
        _MADE.get().extend(stay)
    return out


def _path(spark: SparkSession, path: str, act) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    act(target.getFileSystem(spark._jsc.hadoopConfiguration()), target)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    _path(spark, path, lambda system, target: system.deleteOnExit(target))


def with_uid(df: DataFrame, **columns) -> DataFrame:
    """The whole row as struct `doc` (so that no column of it can clash), a row number `uid`, and more columns.

    The number is by position and holds only once the rows are staged.
    """
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("doc"),
                     *[c.alias(k) for k, c in columns.items()],
                     F.monotonically_increasing_id().alias("uid"))
