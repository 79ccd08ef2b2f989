"""A stream over what is there now, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

_NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def start_available(rows: DataFrame, folder: str, name: str, *, timers: bool = True) -> StreamingQuery:
    """Start a query that takes all data there is now, writes Parquet to folder/name and ends.

    With timers in processing time, empty batches would go on for ever, so there are none; without (`timers=False`) a last
    empty batch gives the windows that the final watermark has closed.
    """
    conf = rows.sparkSession.conf
    before = conf.get(_NO_DATA_BATCHES)
    conf.set(_NO_DATA_BATCHES, "false" if timers else "true")
    try:
        return (rows.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/{name}")
                .option("checkpointLocation", f"{folder}/_checkpoint_{name}").trigger(availableNow=True).start())
    finally:
        conf.set(_NO_DATA_BATCHES, before)


def drained(rows: DataFrame, folder: str, name: str, *, timers: bool = True) -> DataFrame:
    """The rows that a stream gives for all data there is now."""
    start_available(rows, folder, name, timers=timers).awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{name}")
