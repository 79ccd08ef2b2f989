"""C1.6 inside one stream: values that come again, found by what keyed deduplication drops.

For each kind of value (hash, nonce, sequence) a stream keeps the first record of a value and drops those that follow
within the watermark. Arrivals are written beside it, and the difference of the two tables is the audit: a dropped record whose value has
a kept record is a replay of it, any other came after the watermark had passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.keyed import lookup_by_key
from .chain_state import use_keyed_state
from .drain import start_available

KINDS = ("record_hash", "nonce", "sequence")


def first_uses(records: DataFrame, kind: str, delay: str, *, time: str = "ts") -> DataFrame:
    """`record_id, kind, value, ts` of the first record of each value in the stream; null values are all kept out."""
    rows = records.where(F.col(kind).isNotNull()).select(
        "record_id", F.lit(kind).alias("kind"), F.col(kind).cast("string").alias("value"), F.col(time).alias("ts"))
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["value"])


def start_replay_streams(records: DataFrame, folder: str, delay: str, *, time: str = "ts") -> list[StreamingQuery]:
    """Start the streams of all kinds and that of the arrivals over the data there is now; each writes Parquet under `folder`."""
    use_keyed_state(records.sparkSession)
    kept = [start_available(first_uses(records, kind, delay, time=time), folder, f"kept_{kind}") for kind in KINDS]
    return [*kept, start_available(records.select("record_id", F.col(time).alias("ts"), *KINDS), folder, "arrivals")]


def replay_audit(arrivals: DataFrame, kept: DataFrame, kind: str) -> DataFrame:
    """`record_id, kind, value, outcome, first_record_id` of every arrival of one kind that the stream dropped.

    `outcome` is `replay` where a kept record has the value (the earliest of them is named), `late` where none has.
    """
    own = arrivals.where(F.col(kind).isNotNull()).select("record_id", F.col(kind).cast("string").alias("value"))
    dropped = own.join(kept.select("record_id"), "record_id", "left_anti")
    sizes = dropped.groupBy("value").agg(F.count(F.lit(1)).alias("_n"))
    first = kept.groupBy("value").agg(F.min_by("record_id", F.struct("ts", "record_id")).alias("first_record_id"))
    named = lookup_by_key(dropped, first.join(sizes, "value"), ["value"], size="_n", spread=[F.col("record_id")])
    outcome = F.when(F.col("first_record_id").isNull(), "late").otherwise("replay")
    return named.select("record_id", F.lit(kind).alias("kind"), "value", outcome.alias("outcome"), "first_record_id")


def audit_totals(audit: DataFrame) -> DataFrame:
    """Dropped records by kind and outcome."""
    return audit.groupBy("kind", "outcome").agg(F.count(F.lit(1)).alias("records"))
