"""DI analyst decisions bound to audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import DISPOSITIONS
from ..functions.hashing import canonical_json, sha256_text
from ..session import cut_lineage
from .chain import AUDIT, build_chain, chain_heads
from .ordering import previous_in_group

NOTE_LIMIT = 4_000


def binding_digest() -> Column:
    return sha256_text(canonical_json(
        assessment_id="assessment_id", finding_id="finding_id", old_disposition="old_disposition",
        new_disposition="disposition", analyst_note=F.coalesce("analyst_note", F.lit("")), finding_digest="finding_digest"))


def current_dispositions(decisions: DataFrame) -> DataFrame:
    """DI.1 the last decision per finding; `pos` is the order of the store."""
    last = F.max(F.struct("pos", "disposition", "analyst_note", "timestamp", "audit_event_id"))
    return decisions.groupBy("assessment_id", "finding_id").agg(last.alias("d")).select(
        "assessment_id", "finding_id", "d.disposition", "d.analyst_note", "d.timestamp", "d.audit_event_id")


def rejected_decisions(batch: DataFrame) -> DataFrame:
    """DI.2 rows that may not be stored, with the reason."""
    reason = (F.when(~F.upper("disposition").isin(*DISPOSITIONS), "unknown disposition")
              .when(F.trim(F.coalesce("finding_id", F.lit(""))) == "", "finding id is required")
              .when(F.length(F.coalesce("analyst_note", F.lit(""))) > NOTE_LIMIT, "analyst note is too long"))
    return batch.withColumn("reject_reason", reason)


def append_decisions(decisions: DataFrame, audit_chain: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DI.2 new decisions and their audit entries for a batch of valid rows.

    `batch`: `assessment_id, finding_id, disposition, analyst_note, finding_digest, affected_asset,
    timestamp, event_id, pos` with `pos` counted from 0 per assessment. The old value comes from the
    previous decision on the finding, in the batch or in the store.
    """
    good = rejected_decisions(batch).where("reject_reason is null").drop("reject_reason")
    good = good.withColumn("disposition", F.upper("disposition"))
    stored = current_dispositions(decisions).select("assessment_id", "finding_id", F.col("disposition").alias("_stored"))
    # the previous decision in the batch is the one placed just before on the same finding
    keys = ["assessment_id", "finding_id"]
    rows = (previous_in_group(good, keys, [F.col("pos")], "disposition", "_batch").join(stored, keys, "left")
            .withColumn("old_disposition", F.coalesce("_batch", "_stored")).drop("_batch", "_stored")
            .withColumn("payload_digest", binding_digest()))
    heads = cut_lineage(chain_heads(audit_chain, AUDIT))
    placed = (rows.withColumn("chain_id", F.col("assessment_id")).join(heads.select("chain_id", "length"), "chain_id", "left")
              .withColumn("pos", F.col("pos") + F.coalesce("length", F.lit(0))).withColumn("sequence", F.col("pos") + 1))
    placed = placed.withColumns({"event_type": F.lit("ANALYST_DISPOSITION_CHANGED"), "source_engine": F.lit("C3")}).drop("length")
    linked = cut_lineage(build_chain(placed, AUDIT, heads=heads.select("chain_id", "head")))  # both results are columns of it
    entries = linked.select("chain_id", "pos", "sequence", "event_id", "timestamp", "event_type", "source_engine", "affected_asset",
                            "payload_digest", "previous_entry_hash", "entry_hash")
    stored_rows = linked.select(
        "assessment_id", "finding_id", "pos", "old_disposition", "disposition", "analyst_note", "finding_digest", "timestamp",
        F.col("event_id").alias("audit_event_id"), F.col("entry_hash").alias("audit_entry_hash"))
    return stored_rows, entries


def verify_decisions(decisions: DataFrame, entries: DataFrame) -> DataFrame:
    """DI.3 every decision with its audit event: missing, repeated event id, hash or payload mismatch."""
    events = entries.where(F.col("event_type") == "ANALYST_DISPOSITION_CHANGED").groupBy(F.col("event_id").alias("audit_event_id")).agg(
        F.count(F.lit(1)).alias("events"), F.max("entry_hash").alias("entry_hash"), F.max("payload_digest").alias("payload_digest"))
    state = (F.when(F.col("events").isNull(), "missing_event").when(F.col("events") > 1, "repeated_event")
             .when(~F.col("entry_hash").eqNullSafe(F.col("audit_entry_hash")), "entry_hash_mismatch")
             .when(F.col("payload_digest") != binding_digest(), "payload_mismatch").otherwise("bound"))
    # merged: as many events as decisions, and their packed files may look small enough for a broadcast
    return decisions.join(events.hint("merge"), "audit_event_id", "left").withColumn("binding_state", state).drop("events", "entry_hash", "payload_digest")


def store_consistency(decisions: DataFrame, entries: DataFrame) -> DataFrame:
    """DI.3 per assessment: as many decisions as events, and unique event ids."""
    d = decisions.groupBy("assessment_id").agg(F.count(F.lit(1)).alias("decisions"))
    e = (entries.where(F.col("event_type") == "ANALYST_DISPOSITION_CHANGED").groupBy(F.col("chain_id").alias("assessment_id"), "event_id")
         .agg(F.count(F.lit(1)).alias("n")).groupBy("assessment_id").agg(F.sum("n").alias("events"), F.max("n").alias("most")))
    return d.join(e, "assessment_id", "full").fillna(0).select(
        "assessment_id", "decisions", "events", ((F.col("decisions") == F.col("events")) & (F.col("most") <= 1)).alias("consistent"))
