"""Streaming forms of record checks and the shift summary, with the rules of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import ShiftConfig
from ..fixed_values import GENESIS_HASH
from ..operators.chain import ChainSpec, record_hash


def stream_chain_links(records: DataFrame, spec: ChainSpec) -> DataFrame:
    """Tampering, broken links and gaps of records that arrive in order per chain.

    State per chain is the head hash and the next sequence; the record hash is checked in the JVM.
    """
    previous, current = spec.previous, spec.hash
    rows = records.select("chain_id", "pos", "sequence", previous, current, record_hash(spec).alias("_expected"))

    def check(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        head, expected = state.get if state.exists else (GENESIS_HASH, 1)
        found = []
        for r in pd.concat(list(batches)).sort_values("pos").to_dict("records"):
            for hit, issue in ((r["_expected"] != r[current], spec.tampering), (r[previous] != head, "broken_chain"),
                               (r["sequence"] != expected, "sequence_discontinuity")):
                if hit:
                    found.append((key[0], r["pos"], r["sequence"], issue))
            head, expected = r[current], expected + 1
        state.update((head, expected))
        yield pd.DataFrame(found, columns=["chain_id", "pos", "sequence", "issue_type"])

    return rows.groupBy("chain_id").applyInPandasWithState(
        check, "chain_id string, pos long, sequence long, issue_type string", "head string, expected long", "append", GroupStateTimeout.NoTimeout)


def stream_replays(records: DataFrame, known: DataFrame) -> DataFrame:
    """Incoming records whose hash, nonce or sequence is in the known table: stream-static joins per key."""
    result = records
    for column in ("record_hash", "nonce", "sequence"):
        keys = known.select(column).distinct().withColumn(f"_{column}", F.lit(True))
        result = result.join(keys, column, "left")
    flags = [F.coalesce(f"_{c}", F.lit(False)).alias(f"{c}_known") for c in ("record_hash", "nonce", "sequence")]
    marked = result.select(*records.columns, *flags)
    return marked.where("record_hash_known or nonce_known or sequence_known")


def stream_shift(values: DataFrame, feature: str, reference_mean: float, *, window: str = "1 day", delay: str = "1 hour",
                 config: ShiftConfig = ShiftConfig()) -> DataFrame:
    """Mean of one feature per event-time window against the fixed reference mean, flagged as in the batch check."""
    windows = values.withWatermark("ts", delay).groupBy(F.window("ts", window)).agg(
        F.count(F.lit(1)).alias("count"), F.avg(feature).alias("mean"), F.stddev_pop(feature).alias("std"))
    distance = F.abs(F.col("mean") - F.lit(reference_mean))
    return windows.select(F.col("window.start").alias("start"), "count", "mean", "std", distance.alias("distance"),
                          (distance >= config.threshold(feature)).alias("shifted"))
