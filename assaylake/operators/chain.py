"""C1 / C4 hash-linked records: hashes, building, appending, verification and replay.

Rows carry `chain_id` and `pos`, their dense 0-based place in the chain's list. Checks use equal keys on
(chain_id, pos range), so one very long chain is spread over many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import AUDIT_ISSUE_MESSAGES, GENESIS_HASH, ISSUE_MESSAGES
from ..functions.hashing import canonical_json, sha256_text
from ..session import cut_lineage
from .keyed import HOT_ROWS, lookup_by_key

RUN_ROWS = 500_000


@dataclass(frozen=True)
class ChainSpec:
    """Which columns a record hash covers and how its checks are named."""
    fields: tuple[str, ...]
    previous: str
    hash: str
    unique: str
    tampering: str
    reuse: str
    messages: dict = field(hash=False)


PROVENANCE = ChainSpec(
    ("sequence", "nonce", "timestamp", "input_digest", "model_id", "preprocessing_digest", "output_digest"),
    "previous_record_hash", "record_hash", "nonce", "record_tampering", "nonce_reuse", ISSUE_MESSAGES)
AUDIT = ChainSpec(
    ("sequence", "event_id", "timestamp", "event_type", "source_engine", "affected_asset", "payload_digest"),
    "previous_entry_hash", "entry_hash", "event_id", "entry_tampering", "event_id_reuse", AUDIT_ISSUE_MESSAGES)


def record_hash(spec: ChainSpec) -> Column:
    """C1.2 / C4.1 hash over the canonical JSON of the covered fields and the previous hash."""
    return sha256_text(canonical_json(**{c: F.col(c) for c in (*spec.fields, spec.previous)}))


def _around(spec: ChainSpec) -> tuple[Column, Column]:
    """JSON text before and after the previous hash."""
    low = {c: F.col(c) for c in spec.fields if c < spec.previous}
    high = {c: F.col(c) for c in spec.fields if c > spec.previous}
    before, after = canonical_json(**low), canonical_json(**high)
    return (F.concat(F.substring(before, F.lit(1), F.length(before) - 1), F.lit(f',"{spec.previous}":"')),
            F.concat(F.lit('",'), F.substring(after, F.lit(2), F.length(after))))


def _fold(batches: Iterator[pd.DataFrame], previous: str, current: str) -> Iterator[pd.DataFrame]:
    """Rows come sorted by chain and position; only the running hash is kept."""
    chain, head = None, ""
    for pdf in batches:
        hashes, links = [], []
        for cid, start, before, after in zip(pdf["chain_id"], pdf["_head"], pdf["_before"], pdf["_after"]):
            if cid != chain:
                chain, head = cid, start
            links.append(head)
            head = hashlib.sha256(f"{before}{head}{after}".encode("utf-8")).hexdigest()
            hashes.append(head)
        yield pdf.drop(columns=["_head", "_before", "_after"]).assign(**{previous: links, current: hashes})


def build_chain(rows: DataFrame, spec: ChainSpec, *, heads: DataFrame | None = None) -> DataFrame:
    """C1.3 / C4.2 link rows into chains: adds the previous hash and the record hash.

    `rows` has the covered fields; `heads` (`chain_id, head`) continues existing chains. A hash needs its predecessor,
    so a chain is one ordered pass by nature: one shuffle on the chain, a sort that spills, and a fold that keeps only
    the running hash. The JSON text around the hash is made in the JVM, after the sort: before it, every field would be
    shuffled and sorted twice. The Python side only hashes.
    """
    before, after = _around(spec)
    columns = [c for c in rows.columns if c not in (spec.previous, spec.hash)]
    schema = rows.select(*columns).schema.add(spec.previous, "string").add(spec.hash, "string")
    part = rows.select(*columns)
    start = F.lit(GENESIS_HASH)
    if heads is not None:
        part = part.join(heads.select("chain_id", F.col("head").alias("_head")), "chain_id", "left")
        start = F.coalesce("_head", start)
    previous_col, hash_col = spec.previous, spec.hash

    def fold(batches):
        return _fold(batches, previous_col, hash_col)

    part = part.withColumn("_head", start)
    ordered = part.repartition("chain_id").sortWithinPartitions("chain_id", "pos")
    return ordered.withColumns({"_before": before, "_after": after}).mapInPandas(fold, schema)


def chain_heads(chain: DataFrame, spec: ChainSpec) -> DataFrame:
    """Head hash and length per chain."""
    return chain.groupBy("chain_id").agg(F.max_by(spec.hash, "pos").alias("head"), F.count(F.lit(1)).alias("length"))


def append_to_chain(chain: DataFrame, batch: DataFrame, spec: ChainSpec) -> DataFrame:
    """C4.2 next records: `batch` has `pos` counted from 0 inside the batch; position and sequence
    continue after the chain's length. Gives the new rows only."""
    heads = chain_heads(chain, spec)
    offset = F.coalesce("length", F.lit(0))
    placed = (batch.join(heads.select("chain_id", "length"), "chain_id", "left")
              .withColumn("pos", F.col("pos") + offset).withColumn("sequence", F.col("pos") + 1).drop("length"))
    return build_chain(placed, spec, heads=heads.select("chain_id", "head"))


def previous_value(rows: DataFrame, column: str, name: str, *, run_rows: int = RUN_ROWS) -> DataFrame:
    """Value of the row at `pos - 1` of the chain (null at 0).

    A window per (chain, run of positions) gives it inside a run; the first row of a run takes it from
    the last row of the run before, one row per run.
    """
    run = F.floor(F.col("pos") / run_rows)
    window = Window.partitionBy("chain_id", "_run").orderBy("pos")
    edges = rows.where((F.col("pos") + 1) % run_rows == 0).select(
        "chain_id", (run + 1).alias("_run"), F.col(column).alias("_edge"))
    lagged = rows.withColumn("_run", run).withColumn(name, F.lag(column).over(window))
    joined = lagged.join(edges, ["chain_id", "_run"], "left")
    at_start = F.col("pos") % run_rows == 0
    return joined.withColumn(name, F.when(at_start, F.col("_edge")).otherwise(F.col(name))).drop("_run", "_edge")


def _repeated(rows: DataFrame, base: DataFrame, key: str, flag: str, hot_rows: int) -> DataFrame:
    """True where an earlier position of the chain already has the same value; `base` has the same records."""
    seen = (base.groupBy("chain_id", key).agg(F.count(F.lit(1)).alias("_n"), F.min("pos").alias("_first"))
            .where("_n > 1"))
    looked = lookup_by_key(rows, seen, ["chain_id", key], size="_n", spread=[F.col("pos")], hot_rows=hot_rows)
    return looked.withColumn(flag, F.coalesce(F.col("pos") > F.col("_first"), F.lit(False))).drop("_n", "_first")


def verify_records(chain: DataFrame, spec: ChainSpec, *, signature_valid: Column | None = None) -> DataFrame:
    """C1.4 / C4.3 each record on its own: hash and, with a verifier's column, signature.

    A missing signature is invalid when signatures are checked.
    """
    hash_ok = record_hash(spec).eqNullSafe(F.col(spec.hash))
    checked = signature_valid is not None
    signed = F.coalesce(signature_valid, F.lit(False)) if checked else F.lit(None).cast("boolean")
    return chain.withColumns({"hash_valid": hash_ok, "signature_checked": F.lit(checked), "signature_valid": signed}).withColumn(
        "valid", F.col("hash_valid") & (~F.col("signature_checked") | F.coalesce("signature_valid", F.lit(False))))


def chain_issues(chain: DataFrame, spec: ChainSpec, *, signature_valid: Column | None = None,
                 run_rows: int = RUN_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """C1.5 / C4.4 all integrity issues: `chain_id, pos, sequence, issue_type, expected_sequence, message`."""
    columns = ["chain_id", "pos", "sequence", spec.unique, spec.previous, spec.hash, "hash_valid", "signature_checked", "signature_valid"]
    base = cut_lineage(verify_records(chain, spec, signature_valid=signature_valid).select(*columns))  # every record is hashed once
    rows = previous_value(base, spec.hash, "_prev", run_rows=run_rows)
    rows = _repeated(rows, base, "sequence", "_seq_again", hot_rows)
    rows = _repeated(rows, base, spec.unique, "_id_again", hot_rows)
    expected = F.col("pos") + 1
    gap = ~F.col("sequence").eqNullSafe(expected)

    def issue(hit: Column, name: str, wanted: Column | None = None) -> Column:
        return F.when(hit, F.struct(F.lit(name).alias("issue_type"),
                                    (wanted if wanted is not None else F.lit(None)).cast("long").alias("expected_sequence"),
                                    F.lit(spec.messages[name]).alias("message")))

    linked = F.col(spec.previous).eqNullSafe(F.coalesce("_prev", F.lit(GENESIS_HASH)))
    issues = [issue(~F.col("hash_valid"), spec.tampering)]
    if "invalid_signature" in spec.messages:
        issues.append(issue(F.col("signature_checked") & ~F.coalesce("signature_valid", F.lit(False)), "invalid_signature"))
    issues += [issue(~linked, "broken_chain"), issue(gap, "sequence_discontinuity", expected),
               issue(F.col("_seq_again"), "duplicate_sequence"), issue(F.col("_id_again"), spec.reuse)]
    found = F.filter(F.array(*issues), lambda i: i.isNotNull())
    return (rows.select("chain_id", "pos", "sequence", F.explode(found).alias("i"))
            .select("chain_id", "pos", "sequence", "i.*"))


def chain_status(chain: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per chain: record count, issue count, valid."""
    counts = issues.groupBy("chain_id").agg(F.count(F.lit(1)).alias("issue_count"))
    return (chain.groupBy("chain_id").agg(F.count(F.lit(1)).alias("record_count")).join(counts, "chain_id", "left")
            .select("chain_id", "record_count", F.coalesce("issue_count", F.lit(0)).alias("issue_count"))
            .withColumn("valid", F.col("issue_count") == 0))


def replay_matches(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """C1.6 incoming records whose hash, nonce or sequence is already known.

    Each kind is one equi-join to the known values with their match count and first index, so a nonce
    reused a billion times is still one row. `incoming` has `record_id`; `known` has `index`.
    """
    result = incoming
    for kind, column in (("record_hash", "record_hash"), ("nonce", "nonce"), ("sequence", "sequence")):
        values = known.groupBy(column).agg(F.count(F.lit(1)).alias(f"{kind}_matches"), F.min("index").alias(f"first_{kind}_index"))
        sizes = incoming.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
        result = lookup_by_key(result, values.join(sizes, column), [column], size="_n", spread=[F.col("record_id")]).drop("_n")
        result = result.withColumn(f"{kind}_matches", F.coalesce(f"{kind}_matches", F.lit(0)))
    hit = (F.col("record_hash_matches") > 0) | (F.col("nonce_matches") > 0) | (F.col("sequence_matches") > 0)
    return result.withColumn("replay_detected", hit)


def audit_events(lifecycle: DataFrame, engines: DataFrame, findings: DataFrame) -> DataFrame:
    """C4.5 audit events of assessments from their history, before numbering and linking.

    lifecycle: `assessment_id, event_type, timestamp, status`; engines: `assessment_id, engine, status,
    affected_asset, started_at, completed_at`; findings: `assessment_id, affected_asset, severity, timestamp`.
    Gives `chain_id, timestamp, phase, event_type, source_engine, affected_asset, payload_digest`.
    """
    payload = sha256_text(canonical_json(assessment_id=F.col("assessment_id"), stage_status=F.col("stage_status")))

    def shape(df: DataFrame, phase: int, event: Column, source: Column, asset: Column, status: Column, when: Column) -> DataFrame:
        return (df.select("assessment_id", when.alias("timestamp"), F.lit(phase).alias("phase"), event.alias("event_type"),
                          source.alias("source_engine"), asset.alias("affected_asset"), status.alias("stage_status"))
                .withColumn("payload_digest", payload)
                .select(F.col("assessment_id").alias("chain_id"), "timestamp", "phase", "event_type", "source_engine",
                        "affected_asset", "payload_digest"))

    ran = engines.where(~F.col("status").isin("not_assessed", "unavailable") | F.col("started_at").isNotNull())
    idle = engines.where("started_at is null and status in ('not_assessed', 'unavailable')")
    ended = (F.when(F.col("status").isin("error", "failed"), "ENGINE_FAILED")
             .when(F.col("status") == "unavailable", "ENGINE_UNAVAILABLE").otherwise("ENGINE_COMPLETED"))
    missed = F.when(F.col("status") == "unavailable", "ENGINE_UNAVAILABLE").otherwise("ENGINE_SKIPPED")
    aid = F.col("assessment_id")
    return (shape(lifecycle, 0, F.col("event_type"), F.lit("assessment"), aid, F.col("status"), F.col("timestamp"))
            .unionByName(shape(ran, 1, F.lit("ENGINE_STARTED"), F.col("engine"), F.col("affected_asset"), F.lit("started"), F.col("started_at")))
            .unionByName(shape(ran, 2, ended, F.col("engine"), F.col("affected_asset"), F.col("status"), F.col("completed_at")))
            .unionByName(shape(idle, 3, missed, F.col("engine"), aid, F.col("status"), F.col("completed_at")))
            .unionByName(shape(findings, 4, F.lit("FINDING_CREATED"), F.lit("C3"), F.col("affected_asset"), F.col("severity"), F.col("timestamp"))))
