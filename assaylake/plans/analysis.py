"""Queries Q1-Q21 and stores S6-S12 over results, findings and records derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import ISSUE_MESSAGES
from ..functions.text import severity_rank
from ..operators import analyst as an
from ..operators import search_index as si
from ..operators import shift as sh
from ..operators.chain import PROVENANCE, chain_issues, chain_status
from ..session import cut_lineage
from ..sources import stores
from ..sources.tables import parse_records, pick_engine_payload
from . import inputs, records
from .catalog import QUERIES, Tables, query, with_sql

# one assessment per document source, with four engine results as JSON
_RESULTS = """per_source AS (SELECT source, count(*) AS n, count(*) FILTER (n_chars < 300) AS short, count(*) FILTER (n_chars > 6000) AS long FROM documents GROUP BY source),
results AS (
  SELECT source AS assessment_id, 'A1_manifest' AS engine, 'completed' AS status, '{"dataset_sha256":"' || sha256(source) || '","file_count":' || n || '}' AS payload FROM per_source
  UNION ALL SELECT source, 'A2_exact_duplicates', 'completed', '{"duplicate_group_count":' || short || ',"groups":[{"files":["' || source || '/a.txt","' || source || '/b.txt"]}]}' FROM per_source
  UNION ALL SELECT source, 'A6_contributor_risk', 'completed_with_errors', '{"finding_count":' || long || ',"high_risk_contributors":' || CASE WHEN long > 3 THEN 1 ELSE 0 END || '}' FROM per_source
  UNION ALL SELECT source, 'A8_poison_trigger_forensics', CASE WHEN short > 1 THEN 'error' ELSE 'completed' END, '{}' FROM per_source)"""


def _results(t: Tables):
    per = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") < 300).alias("short"), F.count_if(F.col("n_chars") > 6000).alias("long"))
    s = F.col("source")
    a1 = F.concat(F.lit('{"dataset_sha256":"'), F.sha2(s.cast("binary"), 256), F.lit('","file_count":'), "n", F.lit("}"))
    a2 = F.concat(F.lit('{"duplicate_group_count":'), "short", F.lit(',"groups":[{"files":["'), s, F.lit('/a.txt","'), s, F.lit('/b.txt"]}]}'))
    a6 = F.concat(F.lit('{"finding_count":'), "long", F.lit(',"high_risk_contributors":'), F.when(F.col("long") > 3, "1").otherwise("0"), F.lit("}"))

    def row(engine, status, payload):
        return F.struct(F.lit(engine).alias("engine"), status.alias("status"), payload.alias("payload"))

    rows = F.array(
        row("A1_manifest", F.lit("completed"), a1), row("A2_exact_duplicates", F.lit("completed"), a2),
        row("A6_contributor_risk", F.lit("completed_with_errors"), a6),
        row("A8_poison_trigger_forensics", F.when(F.col("short") > 1, "error").otherwise("completed"), F.lit("{}")))
    return per.select(s.alias("assessment_id"), F.explode(rows).alias("r")).select("assessment_id", "r.*")


_FINDINGS = records.DOCUMENT_FINDINGS


def _findings(t: Tables):
    return records.document_findings(t)


def _linked(t: Tables):
    """Findings with their source as assessment, the toxic ones attributed to A2."""
    return _findings(t).withColumn("assessment_id", F.split("affected_asset", "/")[0]).withColumn(
        "source_engine", F.when(F.col("title") == "toxic", "A2").otherwise(F.col("source_engine")))


@query("q1_engine_overview", with_sql(_RESULTS, _FINDINGS, """
SELECT assessment_id, engine, CASE WHEN payload = '{}' AND status = 'completed' THEN 'UNAVAILABLE' WHEN status = 'completed' THEN 'COMPLETED' WHEN status = 'error' THEN 'FAILED' ELSE 'COMPLETED WITH WARNINGS' END AS status_label,
  CASE WHEN engine = 'A1_manifest' THEN 0 WHEN engine LIKE 'A2%' THEN short WHEN engine LIKE 'A6%' THEN long END AS finding_count,
  CASE WHEN engine = 'A2_exact_duplicates' AND EXISTS (FROM findings f WHERE f.title = 'toxic' AND split_part(f.affected_asset, '/', 1) = r.assessment_id) THEN 'HIGH' WHEN engine LIKE 'A6%' AND long > 3 THEN 'HIGH'
    WHEN engine LIKE 'A8%' THEN 'NOT AVAILABLE' WHEN CASE WHEN engine = 'A1_manifest' THEN 0 WHEN engine LIKE 'A2%' THEN short ELSE long END = 0 THEN 'NONE REPORTED' ELSE 'NOT ASSIGNED' END AS severity
FROM results r JOIN per_source ON source = assessment_id"""))
def q1_engine_overview(t: Tables):
    return an.engine_overview(_results(t), _linked(t))


@query("q2_filtered_findings", with_sql(_FINDINGS, "SELECT finding_id, severity, title FROM findings WHERE severity = 'low' AND contains(lower(affected_asset), 'src1')"))
def q2_filtered_findings(t: Tables):
    return an.filter_findings(_findings(t), severity="low", text=" SRC1").select("finding_id", "severity", "title")


@query("q3_finding_counts", with_sql(_FINDINGS, """
SELECT 'severity' AS field, severity AS value, count(*) AS n FROM findings GROUP BY severity UNION ALL SELECT 'category', category, count(*) FROM findings GROUP BY category
UNION ALL SELECT 'source_engine', source_engine, count(*) FROM findings GROUP BY source_engine"""))
def q3_finding_counts(t: Tables):
    return an.finding_counts(_findings(t))


@query("q4_sorted_findings", with_sql(_FINDINGS, "SELECT finding_id, severity, title FROM findings"))
def q4_sorted_findings(t: Tables):
    return an.sort_findings(_findings(t), "severity", descending=True).select("finding_id", "severity", "title")


def _index(t: Tables):
    hashed = t.events.select(
        F.col("user_id").cast("string").alias("assessment_id"), F.lit("C4_audit_trail").alias("producer"), F.when(F.col("value") < 200, F.concat(F.lit("E"), F.col("event_id"))).alias("native_id"),
        F.lit("C4").alias("source_engine"), F.col("event_type").alias("category"), F.col("event_type").alias("affected_asset"), F.col("ts").cast("string").alias("timestamp"),
        F.sha2(F.col("props").cast("binary"), 256).alias("digest"), F.col("event_id").alias("pos"))
    return an.evidence_index(_results(t), _linked(t), hashed)


_INDEX = """evidence AS (
  SELECT assessment_id, 'UI-' || split_part(engine, '_', 1) || '-' || engine AS display_key, split_part(engine, '_', 1) AS source_engine, NULL AS affected_asset, NULL AS finding_id, NULL AS digest FROM results
  UNION ALL SELECT split_part(affected_asset, '/', 1), 'UI-EVIDENCE-' || finding_id || '-1', CASE WHEN title = 'toxic' THEN 'A2' ELSE source_engine END, affected_asset, finding_id, NULL FROM findings
  UNION ALL SELECT CAST(user_id AS VARCHAR), CASE WHEN value < 200 THEN 'E' || event_id ELSE 'UI-C4-RECORD-' || (event_id + 1) END, 'C4', event_type, NULL, sha256(props) FROM events)"""


@query("q5_evidence_index", with_sql(_RESULTS, _FINDINGS, _INDEX, "SELECT assessment_id, display_key, source_engine, affected_asset, finding_id, digest FROM evidence"))
def q5_evidence_index(t: Tables):
    return _index(t).select("assessment_id", "display_key", "source_engine", "affected_asset", "finding_id", "digest")


@query("q6_evidence_overview", with_sql(_RESULTS, _FINDINGS, _INDEX, """
SELECT count(*) AS items, count(DISTINCT source_engine) AS source_engines, count(DISTINCT affected_asset) AS affected_assets, count(finding_id) AS finding_linked, count(digest) AS digest_bearing FROM evidence"""))
def q6_evidence_overview(t: Tables):
    return an.evidence_overview(_index(t))


@query("q6_evidence_filter", with_sql(_RESULTS, _FINDINGS, _INDEX, "SELECT display_key FROM evidence WHERE source_engine = 'A2' AND finding_id IS NOT NULL"))
def q6_evidence_filter(t: Tables):
    return an.filter_evidence(_index(t), linked=True, source_engine="A2").select("display_key")


def _chain(t: Tables):
    chain = cut_lineage(inputs.tampered(t))
    issues = cut_lineage(chain_issues(chain, PROVENANCE))
    return chain, issues, chain_status(chain, issues)


@query("q7_entry_integrity", records._recursive(inputs.TAMPERED, records._PREVIOUS, records._STATUS, """
SELECT t.chain_id, pos, CASE WHEN EXISTS (FROM issues i WHERE i.chain_id = t.chain_id AND i.sequence = t.sequence) THEN 'Issue identified' WHEN valid THEN 'No issue reported' ELSE 'Not individually identified' END AS integrity
FROM tampered t JOIN status USING (chain_id)"""))
def q7_entry_integrity(t: Tables):
    chain, issues, status = _chain(t)
    return an.entry_integrity(chain, issues, status).select("chain_id", "pos", "integrity")


@query("q19_integrity_table", records._recursive(inputs.TAMPERED, records._PREVIOUS, records._STATUS, """kinds AS (
  SELECT unnest(['record_tampering', 'invalid_signature', 'broken_chain', 'sequence_discontinuity', 'duplicate_sequence', 'nonce_reuse']) AS issue_type)""", """
SELECT s.chain_id, k.issue_type, count(i.pos) AS n, CASE WHEN count(i.pos) > 0 THEN 'Reported (' || count(i.pos) || ')' WHEN any_value(s.valid) THEN 'No issue reported' ELSE 'Not specified' END AS state
FROM status s CROSS JOIN kinds k LEFT JOIN issues i ON i.chain_id = s.chain_id AND i.issue_type = k.issue_type GROUP BY ALL"""))
def q19_integrity_table(t: Tables):
    _, issues, status = _chain(t)
    return an.integrity_table(issues, status, ISSUE_MESSAGES).drop("message")


@query("q8_dominant_feature", with_sql(*records._SHIFT, """
SELECT file, CASE WHEN z1 >= max_z THEN 'brightness' WHEN z2 >= max_z THEN 'contrast' WHEN z3 >= max_z THEN 'saturation' ELSE 'edge_density' END AS dominant_feature FROM anomalies"""))
def q8_dominant_feature(t: Tables):
    return sh.dominant_feature(records.shift_parts(t)[5]).select("file", "dominant_feature")


@query("q9_feature_table", with_sql(*records._SHIFT, """
SELECT feature, round(reference_mean, 6) AS reference_mean, round(candidate_mean, 6) AS candidate_mean, round(distance, 6) AS distance, threshold, CASE WHEN distance >= threshold THEN 'SHIFTED' ELSE 'NOT SHIFTED' END AS state FROM distances"""))
def q9_feature_table(t: Tables):
    parts = records.shift_parts(t)
    return sh.feature_table(parts[1], parts[2]).withColumns({c: F.round(c, 6) for c in ("reference_mean", "candidate_mean", "distance")})


# nested evidence of each document: one file, a pair and a nested detail
_NESTED = """nested AS (SELECT doc_id, source || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt' AS path, lang, n_chars FROM documents),
flat AS (
  SELECT doc_id, 0 AS position, 'file' AS path, path AS value FROM nested UNION ALL SELECT doc_id, 1, 'detail.lang', lang FROM nested UNION ALL SELECT doc_id, 2, 'detail.n_chars', CAST(n_chars AS VARCHAR) FROM nested
  UNION ALL SELECT doc_id, 3, 'pairs[0].file_a', path FROM nested UNION ALL SELECT doc_id, 4, 'pairs[0].file_b', lang FROM nested)"""


def _flat(t: Tables):
    path, lang = F.col("path"), F.col("lang")
    text = F.to_json(F.struct(path.alias("file"), F.struct(lang.alias("lang"), F.col("n_chars").alias("n_chars")).alias("detail"),
                              F.array(F.struct(path.alias("file_a"), lang.alias("file_b"))).alias("pairs")))
    return an.flatten_json(t.documents.select("doc_id", inputs.doc_path(), "lang", "n_chars").select("doc_id", text.alias("evidence")), "doc_id", "evidence")


@query("q10_sample_references", with_sql(_NESTED, "SELECT doc_id, value AS sample, min(position) AS position FROM flat WHERE position IN (0, 3, 4) GROUP BY ALL"))
def q10_sample_references(t: Tables):
    return an.sample_references(_flat(t), "doc_id")


@query("q11_evidence_table", with_sql(_NESTED, "SELECT doc_id, position, path AS label, value FROM flat"))
def q11_evidence_table(t: Tables):
    return an.evidence_table(_flat(t), "doc_id")


@query("q13_engine_filter", with_sql(_RESULTS, "SELECT assessment_id, engine FROM results WHERE contains(lower(engine || ' ' || payload), 'src1/a.txt')"))
def q13_engine_filter(t: Tables):
    return an.filter_engines(_results(t), sample="SRC1/a.txt").select("assessment_id", "engine")


# orders are assessments: their status code gives the state
_ASSESSMENTS = """assessments AS (SELECT CAST(o_orderkey AS VARCHAR) AS assessment_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'RUNNING' ELSE 'QUEUED' END AS status, CAST(o_orderdate AS VARCHAR) AS updated_at FROM orders)"""


def _assessments(t: Tables):
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("QUEUED")
    return t.orders.select(F.col("o_orderkey").cast("string").alias("assessment_id"), status.alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query("q14_recoverable", with_sql(_ASSESSMENTS, "SELECT assessment_id, status, updated_at FROM assessments WHERE status IN ('QUEUED', 'RUNNING')"))
def q14_recoverable(t: Tables):
    return an.recoverable(_assessments(t))


@query("q14_interrupted", with_sql(_ASSESSMENTS, "SELECT CASE WHEN status = 'COMPLETED' THEN status ELSE 'FAILED' END AS status, count(*) AS n FROM assessments GROUP BY 1"))
def q14_interrupted(t: Tables):
    return an.mark_interrupted(_assessments(t)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_STEPS = """steps AS (SELECT user_id AS assessment_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
  CASE event_type WHEN 'signup' THEN 'CREATED' WHEN 'view' THEN 'QUEUED' WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END AS status FROM events)"""


@query("q15_illegal_transitions", with_sql(_STEPS, """
SELECT * FROM (SELECT assessment_id, pos, lag(status) OVER (PARTITION BY assessment_id ORDER BY pos) AS previous, status FROM steps) WHERE previous IS NOT NULL AND NOT ((previous = 'CREATED' AND status = 'QUEUED')
  OR (previous = 'QUEUED' AND status IN ('RUNNING', 'FAILED')) OR (previous = 'RUNNING' AND status IN ('COMPLETED', 'FAILED')))"""))
def q15_illegal_transitions(t: Tables):
    from ..operators.ordering import position_in_group
    kind = F.col("event_type")
    status = F.when(kind == "signup", "CREATED").when(kind == "view", "QUEUED").when(kind == "click", "RUNNING").when(kind == "purchase", "COMPLETED").otherwise("FAILED")
    steps = position_in_group(t.events, ["user_id"], [F.col("ts"), F.col("event_id")]).select(F.col("user_id").alias("assessment_id"), "pos", status.alias("status"))
    return an.illegal_transitions(steps, t.spark)


@query("q16_capability_coverage", with_sql(_RESULTS, """
SELECT c.engine, (SELECT count(DISTINCT assessment_id) FROM results WHERE split_part(results.engine, '_', 1) = c.engine) AS assessments
FROM (SELECT unnest(['A1','A2','A3','A4','A5','A6','A7','A8','B1','B2','B3','B4','C1','C2','C3','C4','C5']) AS engine) c"""))
def q16_capability_coverage(t: Tables):
    return an.capability_coverage(_results(t)).select("engine", "assessments")


@query("q17_search", with_sql(_NESTED, "SELECT kind, key, label FROM (SELECT 'Document' AS kind, doc_id AS key, path || ': ' || value AS label FROM flat) WHERE contains(lower(label), 'src7/')"))
def q17_search(t: Tables):
    """Documents by their flattened content."""
    index = _flat(t).select(F.lit("Document").alias("kind"), F.col("doc_id").alias("key"), F.concat("path", F.lit(": "), "value").alias("label"))
    return an.search(index, "SRC7/")


_SEARCH_TABLE = """indexed AS (
  SELECT 'Finding' AS kind, finding_id AS key, title || ' ' || severity || ' ' || affected_asset AS label FROM findings
  UNION ALL SELECT 'Asset', sha256, path FROM manifest
  UNION ALL SELECT 'Assessment', CAST(o_orderkey AS VARCHAR), o_orderpriority || ' ' || o_orderstatus FROM orders
  UNION ALL SELECT 'Audit', CAST(event_id AS VARCHAR), event_type || ' asset-src1/' || user_id FROM events
  UNION ALL SELECT 'Engine', CAST(item_id AS VARCHAR), text FROM benchmark
  UNION ALL SELECT 'Record', CAST(conv_id AS VARCHAR) || '/' || turn, role || ': ' || text FROM conversations)"""


@query("q17_search_all_kinds", with_sql(_FINDINGS, inputs.MANIFEST, _SEARCH_TABLE, """
SELECT DISTINCT kind, key, label FROM indexed WHERE contains(lower(label), 'src1/') OR contains(lower(label), 'urgent')"""))
def q17_search_all_kinds(t: Tables):
    index = _search_table(t)
    return an.search(index, "SRC1/").unionByName(an.search(index, "Urgent")).distinct()


def _search_table(t: Tables):
    """One search table over findings, assets, assessments, audit entries, engine texts and records."""
    def rows(df, kind, key, *label):
        return df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key") if isinstance(key, str) else key.alias("key"), F.concat(*label).alias("label"))

    blank = F.lit(" ")
    return (rows(records.document_findings(t), "Finding", "finding_id", "title", blank, "severity", blank, "affected_asset")
             .unionByName(rows(inputs.manifest(t), "Asset", "sha256", "path"))
             .unionByName(rows(t.orders, "Assessment", "o_orderkey", "o_orderpriority", blank, "o_orderstatus"))
             .unionByName(rows(t.events, "Audit", "event_id", "event_type", F.lit(" asset-src1/"), F.col("user_id").cast("string")))
             .unionByName(rows(t.benchmark, "Engine", "item_id", "text"))
             .unionByName(rows(t.conversations, "Record", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")), "role", F.lit(": "), "text")))


@query("q17_indexed_search", QUERIES["q17_search_all_kinds"].sql)
def q17_indexed_search(t: Tables):
    """The same hits by the trigram index."""
    index = si.build_index(_search_table(t))
    return si.search(index, "SRC1/").unionByName(si.search(index, "Urgent")).distinct()


@query("q17_search_cost", with_sql(_FINDINGS, inputs.MANIFEST, _SEARCH_TABLE, """
SELECT needle, (SELECT count(*) FROM indexed) AS labels, count(*) FILTER (contains(lower(label), lower(needle))) AS hits, true AS few_checked
FROM indexed, (SELECT unnest(['SRC1/', 'Urgent', 'nowhere to be found']) AS needle) GROUP BY needle"""))
def q17_search_cost(t: Tables):
    """How many labels each needle has, and whether the index compared less than two labels for each hit."""
    index = si.build_index(_search_table(t))
    costs = [si.search_cost(index, needle) for needle in ("SRC1/", "Urgent", "nowhere to be found")]
    rows = costs[0].unionByName(costs[1]).unionByName(costs[2])
    return rows.select("needle", "labels", "hits", (F.col("checked") <= 2 * F.col("hits")).alias("few_checked"))


@query("q18_activity_feed", """
SELECT * FROM (SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, event_type AS event, 'user' AS source, CAST(user_id AS VARCHAR) AS asset, CAST(event_id AS VARCHAR) AS id, 'AUDIT' AS route FROM events
UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), 'Assessment created', 'Assessment', o_orderpriority, CAST(o_orderkey AS VARCHAR), 'ASSESSMENT' FROM orders)""")
def q18_activity_feed(t: Tables):
    audit = t.events.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "event_type", F.lit("user").alias("source_engine"),
                            F.col("user_id").cast("string").alias("affected_asset"), F.col("event_id").cast("string").alias("event_id"))
    none = F.lit(None).cast("string")
    runs = t.orders.select(F.col("o_orderkey").cast("string").alias("assessment_id"), F.col("o_orderpriority").alias("name"),
                           F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("created_at"), none.alias("started_at"), none.alias("completed_at"))
    return an.activity_feed(audit, runs)


@query("q20_report_state", """
SELECT CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_orderstatus = 'P' THEN 'PARTIAL' ELSE 'MALFORMED' END AS report_state, count(*) AS n FROM orders GROUP BY 1""")
def q20_report_state(t: Tables):
    whole = ('{"executive_summary":{},"asset_coverage":{},"dataset_integrity":{},"model_integrity":{},"inference_provenance":{},"distribution_shift":{},'
             '"findings_and_evidence":{},"audit_trail":{},"recommended_actions":[],"limitations":[]}')
    code = F.col("o_orderstatus")
    payload = F.when(code == "F", whole).when(code == "P", whole.replace('"limitations":[]', '"limitations":{}')).otherwise('{"other":1}')
    rows = t.orders.select(F.col("o_orderkey").alias("assessment_id"), F.lit("completed").alias("status"), payload.alias("payload"))
    return an.report_state(rows).groupBy("report_state").agg(F.count(F.lit(1)).alias("n"))


@query("q20_signed_records", "SELECT user_id AS chain_id, count(*) FILTER (value > 50) AS signed, count(*) AS records FROM events GROUP BY user_id")
def q20_signed_records(t: Tables):
    return an.signed_records(t.events.select(F.col("user_id").alias("chain_id"), F.when(F.col("value") > 50, "sig").alias("signature")))


@query("q21_related_findings", """
SELECT 'shift' AS area, count(*) FILTER (event_type = 'view') AS n FROM events UNION ALL SELECT 'audit', count(*) FILTER (event_type IN ('click', 'error')) FROM events""")
def q21_related_findings(t: Tables):
    kind = F.col("event_type")
    rows = t.events.select(F.when(kind == "view", "C2").when(kind == "click", "c4").otherwise("A1").alias("source_engine"),
                           F.when(kind == "error", "Audit-Trail").otherwise("other").alias("category"))
    count = lambda area: an.related_findings(rows, area).agg(F.lit(area).alias("area"), F.count(F.lit(1)).alias("n"))
    return count("shift").unionByName(count("audit"))


# --- stores ---------------------------------------------------------------------------------
@query("s6_engine_payloads", with_sql(_RESULTS, """
SELECT assessment_id, engine, CASE WHEN engine LIKE 'A8%' THEN NULL ELSE payload END AS payload, CASE WHEN engine LIKE 'A8%' THEN 'stored result could not be interpreted' WHEN engine LIKE 'A1%' THEN 'evidence_object' ELSE 'result_file' END AS storage_status FROM results"""))
def s6_engine_payloads(t: Tables):
    engine = F.col("engine")
    rows = _results(t).select("assessment_id", "engine", F.when(F.startswith(engine, F.lit("A8")), "{broken").otherwise(F.col("payload")).alias("file_payload"),
                              F.when(F.startswith(engine, F.lit("A1")), F.col("payload")).alias("evidence_payload"))
    return pick_engine_payload(rows)


@query("s7_parsed_records", "SELECT count(*) FILTER (value <= 100) AS records, count(*) FILTER (value > 100) AS rejected FROM events")
def s7_parsed_records(t: Tables):
    fields = [*PROVENANCE.fields, PROVENANCE.previous, PROVENANCE.hash]
    record = F.struct(*[F.col("event_id").alias(c) if c == "sequence" else F.when((F.col("value") <= 100) | F.lit(c != "nonce"), F.col("event_type")).alias(c) for c in fields])
    good, bad = parse_records(t.events.select("event_id", F.to_json(record).alias("json")), PROVENANCE)
    return good.agg(F.count(F.lit(1)).alias("records")).withColumn("rejected", bad.agg(F.count(F.lit(1))).scalar())


@query("s9_evidence_rows", "SELECT sha256(props) AS sha256, any_value(strlen(props)) AS size_bytes, substr(sha256(props), 1, 2) AS prefix FROM events GROUP BY 1, 3")
def s9_evidence_rows(t: Tables):
    return stores.evidence_rows(t.events.select(F.col("props").alias("payload"))).select("sha256", "size_bytes", "prefix")


@query("s10_asset_rows", with_sql(inputs.MANIFEST, """
SELECT sha256('{"kind":"document","path":"' || path || '","sha256":"' || sha256 || '","size":' || size_bytes || '}') AS asset_id, split_part(path, '/', 2) AS display_name, 'trusted_for_hashing' AS trust_state FROM manifest"""))
def s10_asset_rows(t: Tables):
    files = inputs.manifest(t).select(F.col("path").alias("local_path"), F.lit("document").alias("kind"), "sha256", "size_bytes", F.lit("2024-01-01").alias("registered_at"))
    return stores.asset_rows(files).select("asset_id", "display_name", "trust_state")


@query("s11_latest_assessments", """
SELECT CAST(o_custkey AS VARCHAR) AS assessment_id, arg_max(o_orderstatus, (o_orderdate, o_orderpriority, o_orderstatus)) AS status, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS created_at FROM orders GROUP BY o_custkey""")
def s11_latest_assessments(t: Tables):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    versions = t.orders.select(F.col("o_custkey").cast("string").alias("assessment_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("status"),
                               day.alias("created_at"), day.alias("updated_at"), F.lit("{}").alias("payload"))
    return stores.latest_assessments(versions).select("assessment_id", "status", "created_at")


@query("q4_engine_severity_order", with_sql(_FINDINGS, "SELECT severity, CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 0 END AS severity_rank, count(*) AS n FROM findings GROUP BY severity"))
def q4_engine_severity_order(t: Tables):
    return _findings(t).groupBy("severity", severity_rank(F.col("severity")).alias("severity_rank")).agg(F.count(F.lit(1)).alias("n"))
