"""Q analyst queries over results, findings, evidence, audit records and assessments."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed_values import (AUDIT_CATEGORIES, CAPABILITIES, DIGEST_FIELDS, FINDING_COUNT_FIELDS, REPORT_SECTIONS, SAMPLE_KEYS, STATE_TRANSITIONS,
                            STATUS_LABELS)
from ..functions.text import severity_name, severity_rank
from .keyed import attach_scalars

SEARCH_FIELDS = ("finding_id", "title", "category", "explanation", "affected_asset", "source_engine", "recommended_action")


def _lookup(pairs: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def _path(payload: str, name: str) -> Column:
    return F.get_json_object(payload, f"$.{name}")


def engine_overview(results: DataFrame, findings: DataFrame) -> DataFrame:
    """Q1 `assessment_id, engine, status, payload` to status label, finding count and severity.

    Severity: explicit, else the highest linked finding (`assessment_id, source_engine`), else the risk
    or severity counts in the result, else from the finding count.
    """
    raw = F.lower(F.trim(F.coalesce("status", _path("payload", "status"), F.lit("unavailable"))))
    empty = F.coalesce("payload", F.lit("")).isin("", "{}")
    label = F.when(F.startswith(raw, F.lit("completed")) & empty, "UNAVAILABLE").otherwise(
        F.coalesce(_lookup(STATUS_LABELS, raw), F.upper(raw)))
    count = F.lit(None).cast("long")
    for engine, field in FINDING_COUNT_FIELDS.items():
        count = F.when(F.col("engine") == engine, _path("payload", field).try_cast("long")).otherwise(count)
    count = F.when((F.col("engine") == "A1_manifest") & _path("payload", "dataset_sha256").isNotNull(), 0).otherwise(count)
    linked = findings.groupBy("assessment_id", F.col("source_engine").alias("code")).agg(F.max(severity_rank(F.col("severity"))).alias("rank"))
    rows = results.withColumn("code", F.split("engine", "_")[0]).join(linked, ["assessment_id", "code"], "left").withColumn("finding_count", count)
    has = lambda f: F.coalesce(_path("payload", f).try_cast("long"), F.lit(0)) > 0
    levels = [F.when(has(f"image_findings_by_severity.{s}"), s.upper()) for s in ("critical", "high", "medium", "low", "info")]
    severity = F.coalesce(
        F.upper(F.nullif(_path("payload", "severity"), F.lit(""))), F.upper(severity_name(F.col("rank"))),
        F.when(has("high_risk_contributors"), "HIGH").when(has("medium_risk_contributors"), "MEDIUM"), *levels,
        F.when(F.col("finding_count") == 0, "NONE REPORTED").when(F.col("finding_count").isNotNull(), "NOT ASSIGNED"), F.lit("NOT AVAILABLE"))
    return rows.select("assessment_id", "engine", label.alias("status_label"), "finding_count", severity.alias("severity"))


def filter_findings(findings: DataFrame, *, severity: str | None = None, category: str | None = None, source: str | None = None,
                    asset: str | None = None, text: str | None = None) -> DataFrame:
    """Q2 exact filters and a case-folded substring over the searchable fields."""
    for column, value in (("severity", severity), ("category", category), ("source_engine", source), ("affected_asset", asset)):
        if value is not None:
            findings = findings.where(F.coalesce(column, F.lit("Unavailable")) == value)
    if text and text.strip():
        blob = F.lower(F.concat_ws(" ", *[F.col(c) for c in SEARCH_FIELDS if c in findings.columns]))
        findings = findings.where(F.contains(blob, F.lit(text.strip().lower())))
    return findings


def finding_counts(findings: DataFrame) -> DataFrame:
    """Q3 counts by severity, category and source in one pass with grouping sets."""
    keys = [F.col("severity"), F.col("category"), F.col("source_engine")]
    sets = findings.groupingSets([[k] for k in keys], *keys).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    field = F.when(F.col("g") == 3, "severity").when(F.col("g") == 5, "category").otherwise("source_engine")
    return sets.select(field.alias("field"), F.coalesce("severity", "category", "source_engine").alias("value"), "n")


def sort_findings(findings: DataFrame, by: str = "severity", descending: bool = False) -> DataFrame:
    """Q4 sorted view; severity by rank, a missing confidence below all others, finding_id settles ties."""
    key = {"severity": severity_rank(F.col("severity")), "confidence": F.coalesce("confidence", F.lit(-1.0))}.get(by, F.lower(F.col(by)))
    return findings.orderBy(key.desc() if descending else key.asc(), "finding_id")


def persisted_digest(payload: str) -> Column:
    """First digest field present in a JSON payload."""
    return F.coalesce(*[F.nullif(_path(payload, f), F.lit("")) for f in DIGEST_FIELDS])


def evidence_index(results: DataFrame, findings: DataFrame, records: DataFrame) -> DataFrame:
    """Q5 one row per engine result, finding evidence item and hash-linked record.

    `records`: `assessment_id, producer, native_id, source_engine, category, affected_asset, timestamp, digest, pos`.
    """
    none = F.lit(None).cast("string")
    columns = ("assessment_id", "display_key", "source_engine", "producer", "category", "affected_asset", "timestamp", "finding_id", "severity", "confidence",
               "title", "digest", "raw_data")
    code = F.split("engine", "_")[0]
    digest = F.coalesce(F.nullif(_path("payload", "evidence.sha256"), F.lit("")), persisted_digest("payload"))
    a = results.select(
        "assessment_id", F.concat_ws("-", F.lit("UI"), code, F.coalesce(F.substring(digest, 1, 12), F.col("engine"))).alias("display_key"), code.alias("source_engine"),
        F.col("engine").alias("producer"), F.coalesce(_path("payload", "type"), F.lit("Engine result snapshot")).alias("category"),
        _path("payload", "affected_asset").alias("affected_asset"), _path("payload", "timestamp").alias("timestamp"), _path("payload", "finding_id").alias("finding_id"),
        _path("payload", "severity").alias("severity"), _path("payload", "confidence").try_cast("double").alias("confidence"), _path("payload", "title").alias("title"),
        digest.alias("digest"), F.col("payload").alias("raw_data"))
    items = findings.select("*", F.posexplode("evidence").alias("i", "item"))
    native = F.get_json_object("item", "$.evidence_id")
    b = items.select(
        "assessment_id", F.coalesce(native, F.concat_ws("-", F.lit("UI-EVIDENCE"), "finding_id", F.col("i") + 1)).alias("display_key"), "source_engine",
        F.lit("C3 findings record").alias("producer"), F.coalesce(F.get_json_object("item", "$.type"), F.col("category"), F.lit("Finding evidence")).alias("category"),
        "affected_asset", F.get_json_object("item", "$.timestamp").alias("timestamp"), "finding_id", "severity", "confidence", "title",
        persisted_digest("item").alias("digest"), F.col("item").alias("raw_data"))
    c = records.select(
        "assessment_id", F.coalesce("native_id", F.concat_ws("-", F.lit("UI"), F.split("producer", "_")[0], F.lit("RECORD"), F.col("pos") + 1)).alias("display_key"),
        "source_engine", "producer", "category", "affected_asset", "timestamp", none.alias("finding_id"), none.alias("severity"),
        F.lit(None).cast("double").alias("confidence"), F.col("category").alias("title"), "digest", none.alias("raw_data"))
    return a.select(*columns).unionByName(b.select(*columns)).unionByName(c.select(*columns))


def filter_evidence(index: DataFrame, *, text: str | None = None, linked: bool | None = None, **equal: str) -> DataFrame:
    """Q6 predicates on evidence rows: field equality, link to a finding, substring."""
    for column, value in equal.items():
        index = index.where(F.coalesce(F.col(column).cast("string"), F.lit("Unavailable")) == value)
    if linked is not None:
        has = F.coalesce("finding_id", F.lit("")) != ""
        index = index.where(has if linked else ~has)
    if text:
        blob = F.lower(F.concat_ws(" ", "display_key", "source_engine", "category", "affected_asset", "finding_id", "title", "digest", "raw_data"))
        index = index.where(F.contains(blob, F.lit(text.lower().strip())))
    return index


def evidence_overview(index: DataFrame) -> DataFrame:
    """Q6 totals of the evidence index; distinct values are pre-aggregated."""
    return index.agg(
        F.count(F.lit(1)).alias("items"), F.countDistinct(F.nullif("source_engine", F.lit(""))).alias("source_engines"),
        F.countDistinct("affected_asset").alias("affected_assets"), F.count_if(F.coalesce("finding_id", F.lit("")) != "").alias("finding_linked"),
        F.count_if(F.coalesce("digest", F.lit("")) != "").alias("digest_bearing"))


def entry_integrity(entries: DataFrame, issues: DataFrame, status: DataFrame) -> DataFrame:
    """Q7 audit entries with their integrity state.

    An entry is marked when an issue names its sequence, event id or hash: three flags from three
    equi-joins on distinct issue keys. `status` is `chain_id, valid`.
    """
    rows = entries
    for column in ("sequence", "event_id", "entry_hash"):
        if column in issues.columns:
            keys = issues.where(F.col(column).isNotNull()).select("chain_id", column, F.lit(True).alias(f"_by_{column}")).distinct()
            rows = rows.join(keys, ["chain_id", column], "left")
        else:
            rows = rows.withColumn(f"_by_{column}", F.lit(None).cast("boolean"))
    marked = F.coalesce("_by_sequence", "_by_event_id", "_by_entry_hash", F.lit(False))
    rows = rows.join(status.select("chain_id", "valid"), "chain_id", "left")
    state = (F.when(marked, "Issue identified").when(F.col("valid"), "No issue reported").when(~F.col("valid"), "Not individually identified")
             .otherwise("Not reported"))
    return rows.withColumn("integrity", state).drop("_by_sequence", "_by_event_id", "_by_entry_hash", "valid")


# one small recursive walk serves Q10, Q11 and Q17
def _leaves(value, path: str = "", key: str = "") -> Iterator[tuple[str, str, str]]:
    if isinstance(value, dict):
        for name, child in value.items():
            yield from _leaves(child, f"{path}.{name}" if path else str(name), str(name).lower())
    elif isinstance(value, list):
        for i, child in enumerate(value):
            yield from _leaves(child, f"{path}[{i}]", key)
    elif value is not None:
        yield path, key, value if isinstance(value, str) else json.dumps(value)


def flatten_json(df: DataFrame, key: str, column: str) -> DataFrame:
    """Q11 / Q17 nested JSON to `key, position, path, field, value`, one row per scalar, no cap."""
    type_name = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, *leaf) for k, text in zip(pdf[key], pdf[column]) if text for i, leaf in enumerate(_leaves(json.loads(text)))]
            yield pd.DataFrame(rows, columns=[key, "position", "path", "field", "value"])

    return df.select(key, column).where(F.try_parse_json(F.col(column)).isNotNull()).mapInPandas(
        run, f"{key} {type_name}, position int, path string, field string, value string")


def sample_references(flat: DataFrame, key: str) -> DataFrame:
    """Q10 distinct sample references of flattened evidence, first position kept."""
    hits = flat.where(F.col("field").isin(*SAMPLE_KEYS) & ~F.col("value").isin("", "UNKNOWN", "None"))
    return hits.groupBy(key, F.col("value").alias("sample")).agg(F.min("position").alias("position"))


def evidence_table(flat: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Q11 display rows (label, value) of each evidence item; a view may pass its own limit a item."""
    shown = flat if limit is None else flat.where(F.col("position") < limit)
    return shown.select(key, "position", F.col("path").alias("label"), "value")


def filter_engines(results: DataFrame, *, contributor: str | None = None, class_name: str | None = None, sample: str | None = None) -> DataFrame:
    """Q13 engine results whose text mentions the chosen contributor, class and sample."""
    for needle in (contributor, class_name, sample):
        if needle:
            results = results.where(F.contains(F.lower(F.concat_ws(" ", "engine", "payload")), F.lit(needle.lower())))
    return results


def recoverable(assessments: DataFrame) -> DataFrame:
    """Q14 queued or running assessments."""
    return assessments.where(F.upper("status").isin("QUEUED", "RUNNING"))


def mark_interrupted(assessments: DataFrame) -> DataFrame:
    """Q14 running work of a closed session becomes FAILED."""
    return assessments.withColumn("status", F.when(F.upper("status").isin("QUEUED", "RUNNING"), "FAILED").otherwise(F.col("status")))


def illegal_transitions(events: DataFrame, spark: SparkSession) -> DataFrame:
    """Q15 lifecycle steps (`assessment_id, pos, status`) that the state machine does not allow."""
    allowed = spark.createDataFrame([(a, b) for a, targets in STATE_TRANSITIONS.items() for b in targets], "previous string, status string")
    last = F.lag("status").over(Window.partitionBy("assessment_id").orderBy("pos"))
    steps = events.withColumn("previous", last).where("previous is not null")
    return steps.join(F.broadcast(allowed), ["previous", "status"], "left_anti").select("assessment_id", "pos", "previous", "status")


def capabilities(spark: SparkSession) -> DataFrame:
    """Q16 capability dimension."""
    return spark.createDataFrame(list(CAPABILITIES), "engine string, area string, state string")


def capability_coverage(results: DataFrame) -> DataFrame:
    """Q16 each capability with the number of assessments that have a result for it."""
    used = results.groupBy(F.split("engine", "_")[0].alias("engine")).agg(F.countDistinct("assessment_id").alias("assessments"))
    return capabilities(results.sparkSession).join(used, "engine", "left").select("engine", "area", "state", F.coalesce("assessments", F.lit(0)).alias("assessments"))


def search(index: DataFrame, needle: str, limit: int | None = None) -> DataFrame:
    """Q17 case-folded substring over a search table (`kind, key, label`): all hits, or a view's first `limit` by kind
    and key with the count of all in `hits`."""
    found = index.where(F.contains(F.lower("label"), F.lit(needle.lower())))
    if limit is None:
        return found
    total = found.agg(F.count(F.lit(1)).alias("hits"))
    return attach_scalars(found.orderBy("kind", "key", "label").limit(limit), total)


def activity_feed(audit: DataFrame, assessments: DataFrame, limit: int | None = None) -> DataFrame:
    """Q18 audit entries and assessment times, all or a view's newest `limit`: `timestamp, event, source, asset, id, route`."""
    a = audit.select("timestamp", F.col("event_type").alias("event"), F.col("source_engine").alias("source"), F.col("affected_asset").alias("asset"),
                     F.col("event_id").alias("id"), F.lit("AUDIT").alias("route"))
    times = F.array(*[F.struct(F.lit(label).alias("event"), F.col(column).alias("timestamp")) for label, column in (
        ("Assessment created", "created_at"), ("Assessment started", "started_at"), ("Assessment completed", "completed_at"))])
    b = assessments.select("assessment_id", "name", F.explode(times).alias("m")).where("m.timestamp is not null").select(
        "m.timestamp", "m.event", F.lit("Assessment").alias("source"), F.col("name").alias("asset"), F.col("assessment_id").alias("id"), F.lit("ASSESSMENT").alias("route"))
    feed = a.unionByName(b)
    return feed if limit is None else feed.orderBy(F.desc("timestamp"), "event", "id").limit(limit)


def integrity_table(issues: DataFrame, status: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Q19 one row per chain and issue type with count and state; "no issue" only for valid chains."""
    kinds = F.array(*[F.lit(k) for k in labels])
    counts = issues.groupBy("chain_id", "issue_type").agg(F.count(F.lit(1)).alias("n"), F.max("message").alias("message"))
    rows = status.select("chain_id", "valid", F.explode(kinds).alias("issue_type")).join(counts, ["chain_id", "issue_type"], "left")
    state = (F.when(F.col("n").isNotNull(), F.format_string("Reported (%d)", "n")).when(F.col("valid"), "No issue reported")
             .when(~F.col("valid"), "Not specified").otherwise("Unavailable"))
    return rows.select("chain_id", "issue_type", state.alias("state"), F.coalesce("n", F.lit(0)).alias("n"), "message")


def report_state(reports: DataFrame) -> DataFrame:
    """Q20 `assessment_id, status, payload` to the completeness ladder of a stored report."""
    keys = F.coalesce(F.json_object_keys("payload"), F.array().cast("array<string>"))
    missing = F.array_except(F.array(*[F.lit(k) for k in REPORT_SECTIONS]), keys)
    wrong = F.filter(F.array(*[F.when(
        ~F.startswith(F.trim(_path("payload", k)), F.lit("{" if kind == "object" else "[")), F.lit(k)) for k, kind in REPORT_SECTIONS.items()]), lambda x: x.isNotNull())
    status = F.lower("status")
    state = (F.when(F.coalesce("payload", F.lit("")) == "", "UNAVAILABLE").when(F.size(missing) == len(REPORT_SECTIONS), "MALFORMED")
             .when((F.size(missing) > 0) | (F.size(wrong) > 0), "PARTIAL").when(status.isin("error", "failed"), "FAILED")
             .when(status.isin("completed_with_errors", "completed_with_warnings"), "COMPLETED WITH WARNINGS")
             .when(status.isin("completed", "complete"), "COMPLETED").otherwise("PARTIAL"))
    return reports.select("assessment_id", state.alias("report_state"), F.size(missing).alias("missing_sections"))


def related_findings(findings: DataFrame, area: str) -> DataFrame:
    """Q21 findings of the shift or the audit area, by source or category."""
    source, category = F.upper("source_engine"), F.replace(F.lower("category"), F.lit("-"), F.lit("_"))
    if area == "shift":
        return findings.where((source == "C2") | (F.col("category") == "distribution_shift"))
    return findings.where((source == "C4") | category.isin(*AUDIT_CATEGORIES))


def signed_records(records: DataFrame) -> DataFrame:
    """Q20 records that carry a signature, per chain."""
    return records.groupBy("chain_id").agg(F.count_if(F.coalesce("signature", F.lit("")) != "").alias("signed"), F.count(F.lit(1)).alias("records"))

