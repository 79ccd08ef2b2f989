"""C3 findings: every source of evidence mapped to one finding schema, and their aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import MEDIUM_CHAIN_ISSUES, SEVERITIES
from ..functions.hashing import canonical_json, json_list, sha256_text
from ..functions.numeric import clamp, safe_float
from ..functions.text import known_severity, severity_name, severity_rank
from .keyed import attach_scalars
from .ordering import ordered_digest

FINDING_COLUMNS = (
    "finding_id", "category", "severity", "confidence", "affected_asset", "title", "explanation", "evidence",
    "recommended_action", "limitations", "source_engine",
)


def finding_id(category: Column, title: Column, asset: Column, evidence: Column) -> Column:
    """C3.5 `C3-` and 12 hex of the canonical object; `evidence` is an array of canonical JSON texts."""
    head = canonical_json(asset=asset, category=category)
    tail = canonical_json(title=title)
    text = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"evidence":'), json_list(evidence), F.lit(","),
                    F.substring(tail, F.lit(2), F.length(tail)))
    return F.concat(F.lit("C3-"), F.substring(sha256_text(text), 1, 12))


def as_findings(df: DataFrame, *, category: str | Column, severity: Column, confidence: Column, asset: Column, title: Column,
                explanation: Column, evidence: Column, action: str, limitations: tuple[str, ...], source: str | Column) -> DataFrame:
    """Rows to findings: unknown severities become low, confidence is clamped to [0, 1]."""
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    rows = df.select(
        lit(category).alias("category"), known_severity(severity, "low").alias("severity"),
        clamp(safe_float(confidence)).alias("confidence"), asset.alias("affected_asset"), title.alias("title"),
        explanation.alias("explanation"), evidence.alias("evidence"), F.lit(action).alias("recommended_action"),
        F.array(*[F.lit(t) for t in limitations]).alias("limitations"), lit(source).alias("source_engine"))
    key = finding_id(F.col("category"), F.col("title"), F.col("affected_asset"), F.col("evidence"))
    return rows.withColumn("finding_id", key).select(*FINDING_COLUMNS)


def findings_from_engine(raw: DataFrame, engine: str, *, asset: str = "affected_asset") -> DataFrame:
    """C3.1 / C3.2 generic engine rows (`affected_asset, type, title, message, severity, confidence,
    finding_index, data`) of a `dataset` or `model` engine."""
    dataset = engine == "dataset"
    kind = "Dataset" if dataset else "Model"
    default_title = "Dataset integrity finding" if dataset else "Model assurance finding"
    evidence = F.array(F.concat(
        F.lit('{"data":'), F.col("data"), F.lit(',"finding_index":'), F.col("finding_index").cast("string"),
        F.lit(f',"source":"{engine}_engine"}}')))
    return as_findings(
        raw, category=f"{engine}_integrity", severity=F.coalesce("severity", F.lit("medium")),
        confidence=F.coalesce("confidence", F.lit(0.80 if dataset else 0.75)), asset=F.col(asset),
        title=F.coalesce("title", "type", F.lit(default_title)),
        explanation=F.coalesce("message", F.lit(f"{kind} analysis produced measurable evidence.")),
        evidence=evidence, action=f"Review the {engine} evidence against trusted reference data.",
        limitations=(f"{kind} evidence does not by itself establish intent.",), source=engine)


def findings_from_duplicates(totals: DataFrame, asset: str, groups_digest: Column) -> DataFrame:
    """C3.1 one medium finding when any exact-duplicate group exists.

    The evidence names the counts and the digest of the group table instead of listing every group.
    """
    evidence = F.array(canonical_json(
        type=F.lit("exact_duplicate_groups"), group_count=F.col("duplicate_group_count"),
        file_count=F.col("duplicate_file_count"), groups_digest=groups_digest))
    return as_findings(
        totals.where("duplicate_group_count > 0"), category="dataset_integrity", severity=F.lit("medium"), confidence=F.lit(0.90),
        asset=F.lit(asset), title=F.lit("Exact duplicate samples detected"),
        explanation=F.lit("Groups of files share one content hash."), evidence=evidence,
        action="Review the duplicate groups and decide whether the duplication is expected.",
        limitations=("Duplicates may be legitimate and do not prove poisoning.",), source="A2")


def findings_from_triggers(graded: DataFrame, asset: str = "model") -> DataFrame:
    """C3.2 one high finding when the trigger search found candidates."""
    hits = graded.agg(F.count_if("candidate_trigger_like").alias("n")).where("n > 0")
    evidence = F.array(
        canonical_json(type=F.lit("candidate_trigger_count"), value=F.col("n")),
        canonical_json(type=F.lit("trigger_search_assessment"), value=F.lit("candidate_trigger_like_behavior")))
    return as_findings(
        hits, category="model_integrity", severity=F.lit("high"), confidence=F.lit(0.90), asset=F.lit(asset),
        title=F.lit("Candidate trigger-like behavior detected"),
        explanation=F.lit("A localized pattern repeatedly changed predictions under the configured criteria."), evidence=evidence,
        action="Inspect the pattern and compare the model with a trusted reference model.",
        limitations=("Trigger-like behavior is not proof of a backdoor.", "The search grid is finite."), source="B4")


def findings_from_chain(issues: DataFrame, asset: Column) -> DataFrame:
    """C3.3 one finding per chain issue; gaps and reused nonces are medium, everything else high."""
    data = canonical_json(chain=F.col("chain_id").cast("string"), index=F.col("pos"), message=F.col("message"),
                          sequence=F.col("sequence"), type=F.col("issue_type"))
    evidence = F.array(F.concat(F.lit('{"data":'), data, F.lit(',"finding_index":'), F.col("pos").cast("string"), F.lit(',"source":"C1"}')))
    severity = F.when(F.col("issue_type").isin(*MEDIUM_CHAIN_ISSUES), "medium").otherwise("high")
    return as_findings(
        issues, category="inference_provenance", severity=severity, confidence=F.lit(0.98), asset=asset,
        title=F.initcap(F.replace(F.col("issue_type"), F.lit("_"), F.lit(" "))), explanation=F.col("message"), evidence=evidence,
        action="Do not rely on the affected chain until the record issue is reviewed.",
        limitations=("A provenance failure names a record problem, not an actor.",), source="C1")


def findings_from_shift(overall: DataFrame, anomaly_count: DataFrame, asset: str = "candidate_dataset") -> DataFrame:
    """C3.4 a shift finding with confidence min(1, 0.5 + shift), and a medium one for outlying images."""
    number = lambda c: F.format_string("%.9f", F.col(c))
    shift = as_findings(
        overall.where("status = 'completed' and severity <> 'none'"), category="distribution_shift", severity=F.col("severity"),
        confidence=F.least(F.lit(1.0), F.lit(0.5) + F.col("overall_shift")), asset=F.lit(asset), title=F.lit("Distribution shift detected"),
        explanation=F.lit("The candidate population differs measurably from the reference population."),
        evidence=F.array(canonical_json(type=F.lit("overall_shift"), value=number("overall_shift"))),
        action="Review acquisition conditions and reference data before relying on the candidates.",
        limitations=("A shift does not prove manipulation.", "Sensor or environment changes can cause it."), source="C2")
    odd = as_findings(
        anomaly_count.where("n > 0"), category="distribution_shift", severity=F.lit("medium"), confidence=F.lit(0.85),
        asset=F.lit(asset), title=F.lit("Statistical image outliers detected"),
        explanation=F.lit("Candidate images are statistical outliers of the reference features."),
        evidence=F.array(canonical_json(type=F.lit("anomalous_images"), count=F.col("n"))),
        action="Inspect the listed images for acquisition, format or processing differences.",
        limitations=("Outliers may be legitimate observations.",), source="C2")
    return shift.unionByName(odd)


def aggregate_findings(findings: DataFrame) -> DataFrame:
    """C3.6 count, highest severity and zero-filled counts per severity: one row."""
    severity = known_severity(F.col("severity"), "low")
    return findings.agg(
        F.count(F.lit(1)).alias("finding_count"),
        F.coalesce(severity_name(F.max(severity_rank(severity))), F.lit("none")).alias("overall_severity"),
        *[F.count_if(severity == s).alias(f"{s}_count") for s in reversed(SEVERITIES)])


def evidence_digest(findings: DataFrame) -> DataFrame:
    """C3.6 digest over the findings in id order."""
    row = canonical_json(
        finding_id="finding_id", category="category", severity="severity", confidence=F.format_string("%.6f", "confidence"),
        affected_asset="affected_asset", title="title", evidence=json_list(F.col("evidence")), source_engine="source_engine")
    return ordered_digest(findings, [F.col("finding_id"), F.col("affected_asset")], row)


def with_totals(findings: DataFrame) -> DataFrame:
    """Each finding next to the overall count and severity."""
    return attach_scalars(findings, aggregate_findings(findings).select("finding_count", "overall_severity"))
