"""C5 report: coverage, executive summary, sections, recommended actions, limitations and digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import REPORT_AREAS, SEVERITIES
from ..functions.hashing import canonical_json, json_list, sha256_text
from ..functions.text import known_severity, severity_name, severity_rank
from .findings import evidence_digest
from .keyed import attach_scalars

#: Code and text of what the operators of this engine leave open.
DEFAULT_LIMITATIONS = {
    "rows_given": "Results cover the rows that were given; what was never loaded is not assessed.",
    "equal_bytes": "Exact duplicates are equal SHA-256 digests; near duplicates are equal or close hashes within the set threshold.",
    "text_model": "Model checks compare given outputs and tensors; no model is run here.",
    "null_unknown": "A null stands for unknown and is counted in no share.",
    "thresholds": "Findings follow the configured thresholds and change with them.",
    "chain_scope": "Chain checks show changes inside a chain, not records that were left out before it was built.",
    "fixed_decimals": "Digests over numbers use fixed-decimal text, so smaller differences do not show.",
}
#: Code and text of the next step for each state of the summary.
ACTIONS = {
    "critical": "open_critical: look at every finding of severity critical.",
    "high": "open_high: look at every finding of severity high and compare the asset with its source.",
    "provenance": "rebuild_provenance: find the first record that fails in the provenance chain.",
    "audit": "rebuild_audit: find the first entry that fails in the audit chain.",
    "none": "no_step: nothing above severity medium and no failed chain.",
}


def severity_counts(findings: DataFrame) -> DataFrame:
    """C5.1 zero-filled counts and highest severity; unknown severities count as none."""
    severity = known_severity(F.col("severity"), "none")
    return findings.agg(
        F.count(F.lit(1)).alias("finding_count"),
        F.coalesce(severity_name(F.max(severity_rank(severity))), F.lit("none")).alias("highest_severity"),
        *[F.count_if(severity == s).alias(f"{s}_count") for s in reversed(SEVERITIES)])


def coverage(results: DataFrame, findings: DataFrame) -> DataFrame:
    """C5.2 each report area with its state; results are `area` rows that were produced."""
    spark = results.sparkSession
    areas = spark.createDataFrame([(i, a) for i, a in enumerate(REPORT_AREAS)], "position int, area string")
    present = results.select("area").distinct().withColumn("present", F.lit(True))
    counted = findings.agg(F.count(F.lit(1)).alias("finding_count"))
    assessed = F.coalesce("present", F.lit(False)) | (F.col("area") == "findings_and_evidence")
    return attach_scalars(areas.join(present, "area", "left"), counted).select(
        "position", "area", assessed.alias("assessed"), F.when(assessed, "available").otherwise("not_assessed").alias("status"),
        F.when(F.col("area") == "findings_and_evidence", F.col("finding_count")).alias("finding_count"))


def executive_summary(findings: DataFrame, *, provenance: DataFrame | None = None, audit: DataFrame | None = None,
                      shift: DataFrame | None = None) -> DataFrame:
    """C5.3 one row. `provenance` and `audit` are chain status tables (valid = every chain valid), `shift`
    the overall shift row; a missing input stays null."""
    row = severity_counts(findings)

    def whole(status: DataFrame | None) -> Column:
        if status is None:
            return F.lit(None).cast("boolean")
        return status.agg(F.coalesce(F.bool_and("valid"), F.lit(True))).scalar()

    detected = (F.lit(None).cast("boolean") if shift is None else
                shift.select(F.when(F.col("status") == "completed", F.col("severity") != "none").alias("d")).scalar())
    return row.withColumns({"provenance_chain_valid": whole(provenance), "audit_chain_valid": whole(audit),
                            "distribution_shift_detected": detected})


def sections(results: DataFrame) -> DataFrame:
    """C5.4 one row per area: status, validity or severity where the area has one, and the result text.

    `results` is `area, status, valid, severity, shift_detected, result` with nulls where not applicable.
    """
    spark = results.sparkSession
    areas = spark.createDataFrame([(i, a) for i, a in enumerate(REPORT_AREAS)], "position int, area string")
    ran = F.col("status").isNotNull()
    return areas.join(results, "area", "left").select(
        "position", "area", F.when(ran, "assessed").otherwise("not_assessed").alias("status"), "valid",
        F.when(F.col("area") == "distribution_shift", known_severity(F.coalesce("severity", F.lit("none")), "none")).alias("severity"),
        "shift_detected", "result",
        F.when(~ran, F.concat(F.initcap(F.replace(F.col("area"), F.lit("_"), F.lit(" "))), F.lit(" was not assessed."))).alias("message"))


def recommended_actions(summary: DataFrame) -> DataFrame:
    """C5.5 actions by rule from the executive summary, first occurrence kept."""
    rules = F.array(
        F.when(F.col("critical_count") > 0, ACTIONS["critical"]), F.when(F.col("high_count") > 0, ACTIONS["high"]),
        F.when(F.col("provenance_chain_valid") == F.lit(False), ACTIONS["provenance"]),
        F.when(F.col("audit_chain_valid") == F.lit(False), ACTIONS["audit"]))
    hit = F.filter(rules, lambda a: a.isNotNull())
    actions = F.when(F.size(hit) > 0, hit).otherwise(F.array(F.lit(ACTIONS["none"])))
    return summary.select(F.posexplode(F.array_distinct(actions)).alias("position", "action"))


def limitations(extra: DataFrame | None = None, spark=None) -> DataFrame:
    """C5.5 default limitations, then extra `limitation` texts, first occurrence kept."""
    spark = spark or extra.sparkSession
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(DEFAULT_LIMITATIONS.values())], "position long, limitation string")
    if extra is not None:
        more = extra.where(F.trim("limitation") != "").groupBy("limitation").agg(F.lit(1_000).cast("long").alias("position"))
        rows = rows.unionByName(more.select("position", "limitation"))
    return rows.groupBy("limitation").agg(F.min("position").alias("position"))


def assurance_report(assessment_id: str, summary: DataFrame, covered: DataFrame, areas: DataFrame, actions: DataFrame,
                     limits: DataFrame, findings: DataFrame) -> DataFrame:
    """C5.6 the report as one row of JSON parts with its digest.

    Coverage, sections, actions and limitations are short fixed lists; findings enter by their digest.
    """
    packed = lambda df, order: json_list(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("j")))),
        lambda x: x["j"]))
    row = summary.select(F.to_json(F.struct(*sorted(summary.columns)), {"ignoreNullFields": "false"}).alias("executive_summary"))
    for name, df, order in (("asset_coverage", covered, "position"), ("sections", areas, "position"),
                            ("recommended_actions", actions, "position"), ("limitations", limits, "position")):
        row = row.withColumn(name, df.agg(packed(df, order)).scalar())
    row = row.withColumn("findings_digest", evidence_digest(findings).select("digest").scalar())
    row = row.withColumn("assessment_id", F.lit(assessment_id))
    return row.withColumn("report_digest", sha256_text(canonical_json(**{c: F.col(c) for c in row.columns})))


def text_report(report: DataFrame, findings: DataFrame) -> DataFrame:
    """S12 the report as ordered text lines: head lines, then one line per finding."""
    head = F.array(
        F.concat(F.lit("Assessment: "), F.col("assessment_id")), F.concat(F.lit("Report digest: "), F.col("report_digest")),
        F.concat(F.lit("Summary: "), F.col("executive_summary")), F.concat(F.lit("Coverage: "), F.col("asset_coverage")),
        F.concat(F.lit("Actions: "), F.col("recommended_actions")), F.concat(F.lit("Limitations: "), F.col("limitations")))
    top = report.select(F.posexplode(head).alias("line_no", "line")).select(F.lit(0).alias("part"), F.lit("").alias("key"), "line_no", "line")
    body = findings.select(
        F.lit(1).alias("part"), F.col("finding_id").alias("key"), F.lit(0).alias("line_no"),
        F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("finding_id"), F.lit(" "), F.col("title"), F.lit(" — "), F.col("affected_asset")).alias("line"))
    return top.unionByName(body)
