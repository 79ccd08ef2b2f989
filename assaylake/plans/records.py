"""Queries C1-C5 and DI over events (as record streams) and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chain as ch
from ..operators import dispositions as di
from ..operators import findings as fi
from ..operators import manifest as ma
from ..operators import report as re
from ..operators import shift as sh
from ..operators.ordering import position_in_group, tree_digest_sql
from ..session import cut_lineage
from . import inputs
from .catalog import Tables, query, with_sql
from .dataset import r6


def _recursive(*parts: str) -> str:
    return with_sql(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


# --- C1 -------------------------------------------------------------------------------------
_PREVIOUS = """checked AS (
  SELECT *, lag(record_hash) OVER (PARTITION BY chain_id ORDER BY pos) AS before, row_number() OVER (PARTITION BY chain_id, sequence ORDER BY pos) AS seq_no,
    row_number() OVER (PARTITION BY chain_id, nonce ORDER BY pos) AS nonce_no, """ + inputs.RECORD_HASH_SQL + """ AS expected FROM tampered),
issues AS (
  SELECT chain_id, pos, sequence, 'record_tampering' AS issue_type, NULL::BIGINT AS expected_sequence FROM checked WHERE expected <> record_hash
  UNION ALL SELECT chain_id, pos, sequence, 'broken_chain', NULL FROM checked WHERE previous_record_hash <> coalesce(before, repeat('0', 64))
  UNION ALL SELECT chain_id, pos, sequence, 'sequence_discontinuity', pos + 1 FROM checked WHERE sequence <> pos + 1
  UNION ALL SELECT chain_id, pos, sequence, 'duplicate_sequence', NULL FROM checked WHERE seq_no > 1
  UNION ALL SELECT chain_id, pos, sequence, 'nonce_reuse', NULL FROM checked WHERE nonce_no > 1)"""
_STATUS = """status AS (
  SELECT chain_id, record_count, coalesce(n, 0) AS issue_count, n IS NULL AS valid FROM (SELECT chain_id, count(*) AS record_count FROM tampered GROUP BY chain_id)
  LEFT JOIN (SELECT chain_id, count(*) AS n FROM issues GROUP BY chain_id) USING (chain_id))"""


def _issues(t: Tables):
    chain = cut_lineage(inputs.tampered(t))
    return chain, ch.chain_issues(chain, ch.PROVENANCE)


@query("c1_build_chain", _recursive(inputs.RECORDS, "SELECT chain_id, pos, previous_record_hash, record_hash FROM records"))
def c1_build_chain(t: Tables):
    return inputs.records(t).select("chain_id", "pos", "previous_record_hash", "record_hash")


@query("c1_verify_records", _recursive(inputs.TAMPERED, f"SELECT chain_id, pos, {inputs.RECORD_HASH_SQL} = record_hash AS hash_valid FROM tampered"))
def c1_verify_records(t: Tables):
    return ch.verify_records(inputs.tampered(t), ch.PROVENANCE).select("chain_id", "pos", "hash_valid")


@query("c1_chain_issues", _recursive(inputs.TAMPERED, _PREVIOUS, "SELECT * FROM issues"))
def c1_chain_issues(t: Tables):
    return _issues(t)[1].drop("message")


@query("c1_signature_issues", _recursive(inputs.TAMPERED, "SELECT chain_id, pos, sequence FROM tampered WHERE model_id = 'model-other' OR pos % 7 = 3"))
def c1_signature_issues(t: Tables):
    """Records signed over their stored hash; one signer's signatures are wrong and some records have none."""
    right = F.sha2(F.concat(F.lit("signing-key|"), "record_hash").cast("binary"), 256)
    signature = F.when(F.col("model_id") == "model-other", "forged").when(F.col("pos") % 7 == 3, None).otherwise(right)
    chain = inputs.tampered(t).withColumn("signature", signature)
    found = ch.chain_issues(chain, ch.PROVENANCE, signature_valid=F.col("signature") == right)
    return found.where("issue_type = 'invalid_signature'").select("chain_id", "pos", "sequence")


@query("c1_chain_status", _recursive(inputs.TAMPERED, _PREVIOUS, _STATUS, "SELECT * FROM status"))
def c1_chain_status(t: Tables):
    return ch.chain_status(*_issues(t))


@query("c1_replay", """
WITH k AS (SELECT event_id AS i, sha256(event_type || CAST(value AS VARCHAR)) AS record_hash, props AS nonce, user_id AS sequence FROM events WHERE day(ts) <= 15),
n AS (SELECT event_id AS record_id, sha256(event_type || CAST(value AS VARCHAR)) AS record_hash, props AS nonce, user_id AS sequence FROM events WHERE day(ts) > 15)
SELECT record_id, (SELECT count(*) FROM k WHERE k.record_hash = n.record_hash) AS record_hash_matches, (SELECT count(*) FROM k WHERE k.nonce = n.nonce) AS nonce_matches,
  (SELECT count(*) FROM k WHERE k.sequence = n.sequence) AS sequence_matches, (SELECT min(i) FROM k WHERE k.nonce = n.nonce) AS first_nonce_index FROM n""")
def c1_replay(t: Tables):
    text = F.concat("event_type", F.col("value").cast("string")).cast("binary")
    rows = t.events.select("event_id", F.sha2(text, 256).alias("record_hash"), F.col("props").alias("nonce"), F.col("user_id").alias("sequence"), F.dayofmonth("ts").alias("day"))
    known = rows.where("day <= 15").withColumnRenamed("event_id", "index")
    incoming = rows.where("day > 15").withColumnRenamed("event_id", "record_id")
    return ch.replay_matches(incoming, known).select("record_id", "record_hash_matches", "nonce_matches", "sequence_matches", "first_nonce_index")


# --- C4 -------------------------------------------------------------------------------------
# each user is one assessment with a life cycle, engine runs and findings taken from its events
_EVENTS = """moments AS (SELECT CAST(user_id AS VARCHAR) AS a, event_id, event_type, value, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS w FROM events),
audit_events AS (
  SELECT a AS chain_id, w AS timestamp, 0 AS phase, CASE event_type WHEN 'signup' THEN 'ASSESSMENT_QUEUED' ELSE 'ASSESSMENT_COMPLETED' END AS event_type, 'assessment' AS source_engine, a AS affected_asset, 'recorded' AS s, event_id FROM moments WHERE event_type IN ('signup', 'purchase')
  UNION ALL SELECT a, w, 1, 'ENGINE_STARTED', 'A' || event_type, 'asset-' || a, 'started', event_id FROM moments WHERE event_type IN ('view', 'click') AND value <= 100
  UNION ALL SELECT a, w, 2, CASE WHEN event_type = 'click' THEN 'ENGINE_FAILED' ELSE 'ENGINE_COMPLETED' END, 'A' || event_type, 'asset-' || a, CASE WHEN event_type = 'click' THEN 'failed' ELSE 'completed' END, event_id
    FROM moments WHERE event_type IN ('view', 'click') AND value <= 100
  UNION ALL SELECT a, w, 3, 'ENGINE_SKIPPED', 'A' || event_type, a, 'not_assessed', event_id FROM moments WHERE event_type IN ('view', 'click') AND value > 100
  UNION ALL SELECT a, w, 4, 'FINDING_CREATED', 'C3', 'asset-' || a, 'high', event_id FROM moments WHERE event_type = 'error')"""


def _audit_events(t: Tables):
    e = t.events.select(F.col("user_id").cast("string").alias("assessment_id"), "event_type", "value",
                        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))
    asset = F.concat(F.lit("asset-"), F.col("assessment_id"))
    step = F.when(F.col("event_type") == "signup", "ASSESSMENT_QUEUED").otherwise("ASSESSMENT_COMPLETED")
    life = e.where("event_type in ('signup', 'purchase')").select("assessment_id", step.alias("event_type"), "timestamp", F.lit("recorded").alias("status"))
    idle = F.col("value") > 100
    engines = e.where("event_type in ('view', 'click')").select(
        "assessment_id", F.concat(F.lit("A"), F.col("event_type")).alias("engine"), asset.alias("affected_asset"),
        F.when(idle, "not_assessed").when(F.col("event_type") == "click", "failed").otherwise("completed").alias("status"),
        F.when(~idle, F.col("timestamp")).alias("started_at"), F.col("timestamp").alias("completed_at"))
    found = e.where("event_type = 'error'").select("assessment_id", asset.alias("affected_asset"), F.lit("high").alias("severity"), "timestamp")
    return ch.audit_events(life, engines, found)


def _audit_chain(t: Tables):
    order = [F.col(c) for c in ("timestamp", "phase", "event_type", "source_engine", "affected_asset", "payload_digest")]
    placed = position_in_group(_audit_events(t), ["chain_id"], order)
    rows = placed.withColumn("sequence", F.col("pos") + 1).withColumn("event_id", F.concat_ws("-", F.lit("EVT"), "chain_id", "pos")).drop("phase")
    return ch.build_chain(rows, ch.AUDIT)


@query("c4_audit_events", with_sql(_EVENTS, """
SELECT chain_id, timestamp, phase, event_type, source_engine, affected_asset, sha256('{"assessment_id":"' || chain_id || '","stage_status":"' || s || '"}') AS payload_digest FROM audit_events"""))
def c4_audit_events(t: Tables):
    return _audit_events(t)


@query("c4_audit_heads", _recursive(_EVENTS, """digested AS (SELECT *, sha256('{"assessment_id":"' || chain_id || '","stage_status":"' || s || '"}') AS d FROM audit_events),
placed AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY timestamp, phase, event_type, source_engine, affected_asset, d) - 1 AS pos FROM digested),
walk AS (
  SELECT chain_id, CAST(-1 AS BIGINT) AS pos, repeat('0', 64) AS h FROM (SELECT DISTINCT chain_id FROM placed)
  UNION ALL
  SELECT p.chain_id, p.pos, sha256('{"affected_asset":"' || affected_asset || '","event_id":"EVT-' || p.chain_id || '-' || p.pos || '","event_type":"' || event_type || '","payload_digest":"' || d
    || '","previous_entry_hash":"' || w.h || '","sequence":' || (p.pos + 1) || ',"source_engine":"' || source_engine || '","timestamp":"' || timestamp || '"}')
  FROM walk w JOIN placed p ON p.chain_id = w.chain_id AND p.pos = w.pos + 1)""", "SELECT chain_id, arg_max(h, pos) AS head, max(pos) + 1 AS length FROM walk GROUP BY chain_id"))
def c4_audit_heads(t: Tables):
    return ch.chain_heads(_audit_chain(t), ch.AUDIT)


@query("c4_audit_issues", with_sql(_EVENTS, """digested AS (SELECT *, sha256('{"assessment_id":"' || chain_id || '","stage_status":"' || s || '"}') AS d FROM audit_events),
placed AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY timestamp, phase, event_type, source_engine, affected_asset, d) - 1 AS pos FROM digested),
reused AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY pos) AS again FROM placed WHERE event_type = 'ENGINE_SKIPPED')""", """
SELECT chain_id, pos, 'entry_tampering' AS issue_type FROM placed WHERE event_type IN ('FINDING_CREATED', 'ENGINE_SKIPPED', 'ASSESSMENT_COMPLETED')
UNION ALL SELECT chain_id, pos, 'sequence_discontinuity' FROM placed WHERE event_type = 'FINDING_CREATED'
UNION ALL SELECT chain_id, pos, 'event_id_reuse' FROM reused WHERE again > 1"""))
def c4_audit_issues(t: Tables):
    """A stored audit chain changed afterwards: sequences lost, event ids reused, payloads replaced."""
    kind = F.col("event_type")
    chain = _audit_chain(t).withColumns({
        "sequence": F.when(kind != "FINDING_CREATED", F.col("sequence")),
        "event_id": F.when(kind == "ENGINE_SKIPPED", "EVT-reused").otherwise(F.col("event_id")),
        "payload_digest": F.when(kind == "ASSESSMENT_COMPLETED", "0" * 64).otherwise(F.col("payload_digest"))})
    return ch.chain_issues(chain, ch.AUDIT).select("chain_id", "pos", "issue_type")


@query("c4_append", _recursive(inputs.RECORDS, "SELECT chain_id, pos, record_hash FROM records"))
def c4_append(t: Tables):
    """The second half of every chain appended to the first gives the same hashes as one build."""
    rows = cut_lineage(inputs.unlinked(t))
    cut = rows.groupBy("chain_id").agg(F.floor(F.max("pos") / 2).alias("cut"))
    marked = cut_lineage(rows.join(cut, "chain_id"))
    first = cut_lineage(ch.build_chain(marked.where("pos <= cut").drop("cut"), ch.PROVENANCE))
    batch = marked.where("pos > cut").withColumn("pos", F.col("pos") - F.col("cut") - 1).drop("cut", "sequence")
    columns = ["chain_id", "pos", "record_hash"]
    return first.select(*columns).unionByName(ch.append_to_chain(first, batch, ch.PROVENANCE).select(*columns))


@query("c4_audit_status", with_sql(_EVENTS, "SELECT chain_id, count(*) AS record_count, 0 AS issue_count, true AS valid FROM audit_events GROUP BY chain_id"))
def c4_audit_status(t: Tables):
    chain = cut_lineage(_audit_chain(t))
    return ch.chain_status(chain, ch.chain_issues(chain, ch.AUDIT))


# --- C2 -------------------------------------------------------------------------------------
_FEATURES = ("brightness", "contrast", "saturation", "edge_density")
_HISTS = ("red_hist", "green_hist", "blue_hist", "gray_hist")


def _shift_sql(scale: str) -> tuple[str, ...]:
    summary = "summary AS (" + " UNION ALL ".join(
        f"SELECT population, '{f}' AS feature, avg({f}) AS mean, stddev_pop({f}) AS std, count({f}) AS count FROM shift_rows GROUP BY population" for f in _FEATURES) + ")"
    hists = "hist_counts AS (" + " UNION ALL ".join(
        f"SELECT population, '{h}' AS histogram, least(floor({f} * 16), 15) AS bin, count(*) AS n FROM shift_rows WHERE {f} BETWEEN 0 AND 1 GROUP BY ALL" for f, h in zip(_FEATURES, _HISTS)) + """),
  hist_shares AS (SELECT population, histogram, CAST(bin AS INTEGER) AS bin, n / sum(n) OVER (PARTITION BY population, histogram) AS share FROM hist_counts)"""
    distances = """distances AS (SELECT feature, r.mean AS reference_mean, c.mean AS candidate_mean, abs(r.mean - c.mean) AS distance, 0.08 AS threshold FROM summary r JOIN summary c USING (feature)
    WHERE r.population = 'reference' AND c.population = 'candidate'),
  hist_distances AS (SELECT histogram, 0.5 * sum(abs(coalesce(r.share, 0) - coalesce(c.share, 0))) AS distance FROM (SELECT * FROM hist_shares WHERE population = 'reference') r
    FULL JOIN (SELECT * FROM hist_shares WHERE population = 'candidate') c USING (histogram, bin) GROUP BY histogram),
  overall AS (SELECT *, 0.6 * s + 0.4 * h AS overall_shift, CASE WHEN 0.6 * s + 0.4 * h >= 0.2 THEN 'high' WHEN n >= 2 THEN 'medium' WHEN n = 1 THEN 'low' ELSE 'none' END AS severity
    FROM (SELECT avg(distance) AS s, count(*) FILTER (distance >= 0.08) AS n, (SELECT avg(distance) FROM hist_distances) AS h FROM distances)),
  anomalies AS (SELECT file, greatest(z1, z2, z3, z4) AS max_z, z1, z2, z3, z4 FROM (SELECT file, """ + ", ".join(
        f"abs({f} - (SELECT mean FROM summary WHERE population = 'reference' AND feature = '{f}')) / greatest((SELECT std FROM summary WHERE population = 'reference' AND feature = '{f}'), 1e-6) AS z{i}"
        for i, f in enumerate(_FEATURES, 1)) + " FROM shift_rows WHERE population = 'candidate') WHERE greatest(z1, z2, z3, z4) >= 3)"
    return inputs.shift_rows_sql("shift_rows", scale), summary, hists, distances


_SHIFT = _shift_sql("1.5")


def shift_parts(t: Tables):
    rows = inputs.shift_rows(t, 1.5)
    summary = sh.feature_summary(rows)
    distances = sh.feature_distances(summary)
    hists = sh.histogram_distances(sh.histogram_summary(rows))
    return rows, summary, distances, hists, sh.overall_shift(distances, hists), sh.image_anomalies(rows, summary)


@query("c2_feature_summary", with_sql(*_SHIFT, "SELECT population, feature, round(mean, 6) AS mean, round(std, 6) AS std, count FROM summary"))
def c2_feature_summary(t: Tables):
    return sh.feature_summary(inputs.shift_rows(t, 1.5)).select("population", "feature", r6("mean"), r6("std"), "count")


@query("c2_histogram_distances", with_sql(*_SHIFT, "SELECT histogram, round(distance, 6) AS distance FROM hist_distances"))
def c2_histogram_distances(t: Tables):
    return shift_parts(t)[3].select("histogram", r6("distance"))


@query("c2_feature_distances", with_sql(*_SHIFT, """
SELECT feature, round(reference_mean, 6) AS reference_mean, round(candidate_mean, 6) AS candidate_mean, round(distance, 6) AS distance, threshold, distance >= threshold AS shifted FROM distances"""))
def c2_feature_distances(t: Tables):
    return shift_parts(t)[2].select("feature", r6("reference_mean"), r6("candidate_mean"), r6("distance"), "threshold", "shifted")


@query("c2_overall_shift", with_sql(*_SHIFT, "SELECT round(overall_shift, 6) AS overall_shift, severity, n AS shifted_feature_count FROM overall"))
def c2_overall_shift(t: Tables):
    return shift_parts(t)[4].select(r6("overall_shift"), "severity", "shifted_feature_count")


@query("c2_overall_shift_unscaled", with_sql(*_shift_sql("1.0"), "SELECT round(overall_shift, 6) AS overall_shift, severity, n AS shifted_feature_count FROM overall"))
def c2_overall_shift_unscaled(t: Tables):
    rows = inputs.shift_rows(t)
    distances = sh.feature_distances(sh.feature_summary(rows))
    return sh.overall_shift(distances, sh.histogram_distances(sh.histogram_summary(rows))).select(r6("overall_shift"), "severity", "shifted_feature_count")


_Z = ", ".join(f"round(z{i}, 4) AS z_{f}" for i, f in enumerate(_FEATURES, 1))


@query("c2_image_anomalies", with_sql(*_SHIFT, f"SELECT file, round(max_z, 4) AS max_z_score, {_Z} FROM anomalies"))
def c2_image_anomalies(t: Tables):
    found = shift_parts(t)[5]
    return found.select("file", *[F.round(c, 4).alias(c) for c in found.columns if c != "file"])


@query("c2_findings", with_sql(*_SHIFT, """
SELECT 'distribution_shift' AS type, severity, round(overall_shift, 6) AS overall_shift, NULL::BIGINT AS count FROM overall WHERE severity <> 'none'
UNION ALL SELECT 'candidate_image_anomalies', CASE WHEN count(*) < 5 THEN 'medium' ELSE 'high' END, NULL, count(*) FROM anomalies HAVING count(*) > 0"""))
def c2_findings(t: Tables):
    parts = shift_parts(t)
    return sh.shift_findings(parts[4], parts[5]).withColumn("overall_shift", F.round("overall_shift", 6))


_RESULT_ROWS = """result_rows AS (
  SELECT 'overall' AS kind, 'overall' AS k, printf('%.9f', overall_shift) || '|' || severity AS v FROM overall
  UNION ALL SELECT 'feature', feature, printf('%.9f', distance) || '|' || CAST(distance >= threshold AS VARCHAR) FROM distances
  UNION ALL SELECT 'histogram', histogram, printf('%.9f', distance) FROM hist_distances
  UNION ALL SELECT 'image', CAST(file AS VARCHAR), printf('%.9f', max_z) FROM anomalies)"""


@query("c2_result_digest", with_sql(*_SHIFT, _RESULT_ROWS, "SELECT * FROM " + tree_digest_sql(
    "result_rows", "kind, k", """'{"key":"' || k || '","values":"' || v || '"}'""")))
def c2_result_digest(t: Tables):
    parts = shift_parts(t)
    return sh.result_digest(parts[4], parts[2], parts[3], parts[5])


# --- C3 -------------------------------------------------------------------------------------
# raw engine findings of the documents: short texts, toxic labels and low-quality labels
_RAW = """raw_findings AS (
  SELECT d.source || '/' || lpad(CAST(d.doc_id AS VARCHAR), 8, '0') || '.txt' AS affected_asset, k.type, k.severity, d.n_chars, d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id),
    (SELECT unnest(['short_text', 'toxic', 'low_quality', 'long_text']) AS type, unnest(['LOW', 'high', NULL, 'urgent']) AS severity) k
  WHERE (k.type = 'short_text' AND n_chars < 300) OR (k.type = 'toxic' AND toxic = 1) OR (k.type = 'low_quality' AND quality = 0) OR (k.type = 'long_text' AND n_chars > 8000)),
findings AS (
  SELECT 'C3-' || substr(sha256('{"asset":"' || affected_asset || '","category":"dataset_integrity","evidence":[{"data":{"n_chars":' || n_chars || ',"type":"' || type || '"},"finding_index":' || doc_id
    || ',"source":"dataset_engine"}],"title":"' || type || '"}'), 1, 12) AS finding_id, 'dataset_integrity' AS category,
    CASE WHEN severity IS NULL THEN 'medium' WHEN lower(severity) IN ('none', 'low', 'medium', 'high', 'critical') THEN lower(severity) ELSE 'low' END AS severity,
    0.8::DOUBLE AS confidence, affected_asset, type AS title, 'dataset' AS source_engine,
    '[{"data":{"n_chars":' || n_chars || ',"type":"' || type || '"},"finding_index":' || doc_id || ',"source":"dataset_engine"}]' AS evidence FROM raw_findings)"""
DOCUMENT_FINDINGS = _RAW


def document_findings(t: Tables):
    labelled = t.documents.join(t.labels, "doc_id", "left")
    rule = lambda hit, name, severity: F.when(hit, F.struct(F.lit(name).alias("type"), F.lit(severity).cast("string").alias("severity")))
    hits = F.filter(F.array(
        rule(F.col("n_chars") < 300, "short_text", "LOW"), rule(F.col("toxic") == 1, "toxic", "high"),
        rule(F.col("quality") == 0, "low_quality", None), rule(F.col("n_chars") > 8000, "long_text", "urgent")), lambda h: h.isNotNull())
    rows = labelled.select(inputs.doc_path().alias("affected_asset"), "n_chars", F.col("doc_id").alias("finding_index"), F.explode(hits).alias("h"))
    raw = rows.select(
        "affected_asset", "h.type", "h.severity", "finding_index", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("message"),
        F.lit(None).cast("double").alias("confidence"), F.concat(F.lit('{"n_chars":'), F.col("n_chars"), F.lit(',"type":"'), F.col("h.type"), F.lit('"}')).alias("data"))
    return fi.findings_from_engine(raw, "dataset")


_FINDING = "finding_id, category, severity, confidence, affected_asset, title, source_engine"


@query("c3_dataset_findings", with_sql(_RAW, f"SELECT {_FINDING} FROM findings"))
def c3_dataset_findings(t: Tables):
    return document_findings(t).select(*_FINDING.split(", "))


@query("c3_aggregate", with_sql(_RAW, inputs.MANIFEST, """everything AS (SELECT severity FROM findings UNION ALL SELECT 'medium' FROM (SELECT count(*) AS g FROM (SELECT sha256 FROM manifest GROUP BY sha256 HAVING count(*) > 1)) WHERE g > 0)""", """
SELECT count(*) AS finding_count, list_extract(['none', 'low', 'medium', 'high', 'critical'], max(list_position(['none', 'low', 'medium', 'high', 'critical'], severity))) AS overall_severity,
  count(*) FILTER (severity = 'critical') AS critical_count, count(*) FILTER (severity = 'high') AS high_count, count(*) FILTER (severity = 'medium') AS medium_count,
  count(*) FILTER (severity = 'low') AS low_count, count(*) FILTER (severity = 'none') AS none_count FROM everything"""))
def c3_aggregate(t: Tables):
    return fi.aggregate_findings(_all_findings(t))


def _duplicate_finding(t: Tables):
    manifest = cut_lineage(inputs.manifest(t))
    digest = fi.ordered_digest(ma.duplicate_groups(manifest), [F.col("sha256")], F.concat(F.lit('"'), F.col("sha256"), F.lit('"')))
    return fi.findings_from_duplicates(ma.duplicate_totals(manifest), "documents", digest.select("digest").scalar())


def _all_findings(t: Tables):
    return document_findings(t).unionByName(_duplicate_finding(t))


@query("c3_duplicate_finding", with_sql(inputs.MANIFEST, "g AS (SELECT sha256, count(*) AS n FROM manifest GROUP BY sha256 HAVING count(*) > 1)", """
SELECT 'C3-' || substr(sha256('{"asset":"documents","category":"dataset_integrity","evidence":[{"file_count":' || sum(n) || ',"group_count":' || count(*) || ',"groups_digest":"'
  || (SELECT digest FROM """ + tree_digest_sql("g", "sha256", "'\"' || sha256 || '\"'") + """) || '","type":"exact_duplicate_groups"}],"title":"Exact duplicate samples detected"}'), 1, 12) AS finding_id,
  'medium' AS severity, 0.9::DOUBLE AS confidence FROM g HAVING count(*) > 0"""))
def c3_duplicate_finding(t: Tables):
    return _duplicate_finding(t).select("finding_id", "severity", "confidence")


@query("c3_chain_findings", _recursive(inputs.TAMPERED, _PREVIOUS, """
SELECT chain_id AS affected_asset, CASE issue_type WHEN 'record_tampering' THEN 'Record Tampering' WHEN 'broken_chain' THEN 'Broken Chain' WHEN 'sequence_discontinuity' THEN 'Sequence Discontinuity'
    WHEN 'duplicate_sequence' THEN 'Duplicate Sequence' ELSE 'Nonce Reuse' END AS title, CASE WHEN issue_type IN ('sequence_discontinuity', 'nonce_reuse') THEN 'medium' ELSE 'high' END AS severity,
  0.98::DOUBLE AS confidence, count(*) AS n FROM issues GROUP BY ALL"""))
def c3_chain_findings(t: Tables):
    found = fi.findings_from_chain(_issues(t)[1], F.col("chain_id"))
    return found.groupBy("affected_asset", "title", "severity", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query("c3_shift_findings", with_sql(*_SHIFT, """
SELECT 'Distribution shift detected' AS title, severity, round(least(1, 0.5 + overall_shift), 6) AS confidence FROM overall WHERE severity <> 'none'
UNION ALL SELECT 'Statistical image outliers detected', 'medium', 0.85 FROM anomalies HAVING count(*) > 0"""))
def c3_shift_findings(t: Tables):
    parts = shift_parts(t)
    found = fi.findings_from_shift(parts[4], parts[5].agg(F.count(F.lit(1)).alias("n")))
    return found.select("title", "severity", r6("confidence"))


@query("c3_trigger_finding", """
SELECT 'model' AS affected_asset, 'high' AS severity, 0.9::DOUBLE AS confidence, 'C3-' || substr(sha256('{"asset":"model","category":"model_integrity","evidence":[{"type":"candidate_trigger_count","value":' || count(*)
  || '},{"type":"trigger_search_assessment","value":"candidate_trigger_like_behavior"}],"title":"Candidate trigger-like behavior detected"}'), 1, 12) AS finding_id FROM events WHERE value > 150 HAVING count(*) > 0""")
def c3_trigger_finding(t: Tables):
    graded = t.events.select((F.col("value") > 150).alias("candidate_trigger_like"))
    return fi.findings_from_triggers(graded).select("affected_asset", "severity", "confidence", "finding_id")


_FINDING_ITEM = """
  '{"affected_asset":"' || affected_asset || '","category":"' || category || '","confidence":"' || printf('%.6f', confidence) || '","evidence":"' || replace(evidence, '"', chr(92) || '"')
  || '","finding_id":"' || finding_id || '","severity":"' || severity || '","source_engine":"' || source_engine || '","title":"' || title || '"}'"""


@query("c3_evidence_digest", with_sql(_RAW, "SELECT * FROM " + tree_digest_sql("findings", "finding_id, affected_asset", _FINDING_ITEM)))
def c3_evidence_digest(t: Tables):
    return fi.evidence_digest(document_findings(t))


# --- C5 -------------------------------------------------------------------------------------
def _summary(t: Tables):
    chain, issues = _issues(t)
    provenance = cut_lineage(ch.chain_status(chain, issues))
    return re.executive_summary(document_findings(t), provenance=provenance, audit=provenance.select("chain_id", F.lit(True).alias("valid")),
                                shift=cut_lineage(shift_parts(t)[4]))


_SUMMARY_SQL = """exec AS (SELECT count(*) AS finding_count, max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS top, count(*) FILTER (severity = 'high') AS high_count,
  (SELECT bool_and(valid) FROM status) AS provenance_chain_valid, (SELECT severity <> 'none' FROM overall) AS distribution_shift_detected FROM findings)"""


@query("c5_executive_summary", _recursive(inputs.TAMPERED, _PREVIOUS, _STATUS, _RAW, *_SHIFT, _SUMMARY_SQL, """
SELECT finding_count, ['none', 'low', 'medium', 'high'][top + 1] AS highest_severity, high_count, provenance_chain_valid, true AS audit_chain_valid, distribution_shift_detected FROM exec"""))
def c5_executive_summary(t: Tables):
    return _summary(t).select("finding_count", "highest_severity", "high_count", "provenance_chain_valid", "audit_chain_valid", "distribution_shift_detected")


@query("c5_recommended_actions", _recursive(inputs.TAMPERED, _PREVIOUS, _STATUS, _RAW, *_SHIFT, _SUMMARY_SQL, f"""
SELECT row_number() OVER (ORDER BY o) - 1 AS position, action FROM (
  SELECT 1 AS o, '{re.ACTIONS["high"]}' AS action FROM exec WHERE high_count > 0
  UNION ALL SELECT 2, '{re.ACTIONS["provenance"]}' FROM exec WHERE NOT provenance_chain_valid
  UNION ALL SELECT 3, '{re.ACTIONS["none"]}' FROM exec WHERE high_count = 0 AND provenance_chain_valid)"""))
def c5_recommended_actions(t: Tables):
    return re.recommended_actions(_summary(t))


@query("c5_coverage", with_sql(_RAW, """
SELECT position, area, area IN ('dataset_integrity', 'audit_trail', 'findings_and_evidence') AS assessed,
  CASE WHEN area IN ('dataset_integrity', 'audit_trail', 'findings_and_evidence') THEN 'available' ELSE 'not_assessed' END AS status,
  CASE WHEN area = 'findings_and_evidence' THEN (SELECT count(*) FROM findings) END AS finding_count
FROM (SELECT unnest(range(6)) AS position, unnest(['dataset_integrity', 'model_integrity', 'inference_provenance', 'distribution_shift', 'findings_and_evidence', 'audit_trail']) AS area)"""))
def c5_coverage(t: Tables):
    results = t.documents.select(F.lit("dataset_integrity").alias("area")).unionByName(t.events.select(F.lit("audit_trail").alias("area")))
    return re.coverage(results, document_findings(t))


_LIMITS = " UNION ALL ".join(f"SELECT {i} AS position, '{text}' AS limitation" for i, text in enumerate(re.DEFAULT_LIMITATIONS.values()))


@query("c5_limitations", f"""
SELECT limitation, CAST(min(position) AS BIGINT) AS position FROM ({_LIMITS} UNION ALL SELECT 1000, 'Source ' || source || ' was read as given.' FROM documents) GROUP BY limitation""")
def c5_limitations(t: Tables):
    extra = t.documents.select(F.concat(F.lit("Source "), "source", F.lit(" was read as given.")).alias("limitation"))
    return re.limitations(extra)


_AREAS = ("dataset_integrity", "model_integrity", "inference_provenance", "distribution_shift", "findings_and_evidence", "audit_trail")
_SECTIONS_SQL = f"""section_rows AS (
  SELECT i AS position, area, CASE WHEN i = 0 THEN 'assessed' ELSE 'not_assessed' END AS status, NULL::BOOLEAN AS valid, CASE WHEN area = 'distribution_shift' THEN 'none' END AS severity,
    NULL::BOOLEAN AS shift_detected, CASE WHEN i = 0 THEN (SELECT CAST(count(*) AS VARCHAR) FROM findings) END AS result, CASE WHEN i > 0 THEN name || ' was not assessed.' END AS message
  FROM (SELECT unnest(range(6)) AS i, unnest({list(_AREAS)}) AS area, unnest({[a.replace("_", " ").title() for a in _AREAS]}) AS name))"""


def _results(findings):
    return findings.agg(F.lit("dataset_integrity").alias("area"), F.lit("completed").alias("status"), F.lit(None).cast("boolean").alias("valid"),
                        F.max("severity").alias("severity"), F.lit(None).cast("boolean").alias("shift_detected"), F.count(F.lit(1)).cast("string").alias("result"))


@query("c5_sections", with_sql(_RAW, _SECTIONS_SQL, "SELECT * FROM section_rows"))
def c5_sections(t: Tables):
    """The areas of a report of which one ran."""
    return re.sections(_results(document_findings(t)))


def _json_sql(**columns: str) -> str:
    """A JSON object of text, numbers and truth values; nulls are written."""
    part = lambda name, kind: f"""'"{name}":' || """ + (f"""coalesce('"' || {name} || '"', 'null')""" if kind == "text" else f"coalesce(CAST({name} AS VARCHAR), 'null')")
    return "'{' || " + " || ',' || ".join(part(name, kind) for name, kind in sorted(columns.items())) + " || '}'"


def _list_sql(source: str, **columns: str) -> str:
    return f"(SELECT '[' || string_agg(j, ',' ORDER BY position, j) || ']' FROM (SELECT position, {_json_sql(**columns)} AS j FROM {source}))"


_FIXED_LIMITS = " UNION ALL ".join(f"SELECT {i} AS position, '{text}' AS limitation" for i, text in enumerate(re.DEFAULT_LIMITATIONS.values()))
_REPORT_SQL = ("""counted AS (SELECT 0 AS critical_count, count(*) FILTER (severity = 'high') AS high_count, count(*) FILTER (severity = 'medium') AS medium_count,
  count(*) FILTER (severity = 'low') AS low_count, count(*) FILTER (severity = 'none') AS none_count FROM findings),
told AS (SELECT counted.*, finding_count, ['none', 'low', 'medium', 'high'][top + 1] AS highest_severity, provenance_chain_valid, true AS audit_chain_valid, distribution_shift_detected FROM counted, exec)""",
               f"""covered AS (SELECT i AS position, area, i IN (0, 4) AS assessed, CASE WHEN i IN (0, 4) THEN 'available' ELSE 'not_assessed' END AS status,
  CASE WHEN i = 4 THEN (SELECT count(*) FROM findings) END AS finding_count FROM (SELECT unnest(range(6)) AS i, unnest({list(_AREAS)}) AS area))""",
               f"""actions AS (SELECT row_number() OVER (ORDER BY position) - 1 AS position, action FROM (
  SELECT 1 AS position, '{re.ACTIONS["high"]}' AS action FROM exec WHERE high_count > 0 UNION ALL SELECT 2, '{re.ACTIONS["provenance"]}' FROM exec WHERE NOT provenance_chain_valid
  UNION ALL SELECT 3, '{re.ACTIONS["none"]}' FROM exec WHERE high_count = 0 AND provenance_chain_valid))""",
               f"limits AS ({_FIXED_LIMITS} UNION ALL SELECT 1000, 'Dataset evidence does not by itself establish intent.' WHERE EXISTS (FROM findings))",
               "parts AS (SELECT 'documents' AS assessment_id, " + ", ".join((
                   _list_sql("covered", area="text", assessed="bool", finding_count="number", position="number", status="text") + " AS asset_coverage",
                   f"(SELECT {_json_sql(audit_chain_valid='bool', critical_count='number', distribution_shift_detected='bool', finding_count='number', high_count='number', highest_severity='text', low_count='number', medium_count='number', none_count='number', provenance_chain_valid='bool')} FROM told) AS executive_summary",
                   "(SELECT digest FROM " + tree_digest_sql("findings", "finding_id, affected_asset", _FINDING_ITEM) + ") AS findings_digest",
                   _list_sql("limits", limitation="text", position="number") + " AS limitations",
                   _list_sql("actions", action="text", position="number") + " AS recommended_actions",
                   _list_sql("section_rows", area="text", message="text", position="number", result="text", severity="text", shift_detected="bool", status="text", valid="bool") + " AS sections")) + ")")
_REPORT_DIGEST = "sha256('{' || " + " || ',' || ".join(
    f"""'"{c}":"' || replace(replace({c}, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"'"""
    for c in ("assessment_id", "asset_coverage", "executive_summary", "findings_digest", "limitations", "recommended_actions", "sections")) + " || '}')"


@query("c5_report", _recursive(inputs.TAMPERED, _PREVIOUS, _STATUS, _RAW, *_SHIFT, _SUMMARY_SQL, _SECTIONS_SQL, *_REPORT_SQL, f"SELECT *, {_REPORT_DIGEST} AS report_digest FROM parts"))
def c5_report(t: Tables):
    findings = cut_lineage(document_findings(t))
    summary = cut_lineage(_summary(t))
    results = _results(findings)
    limits = re.limitations(findings.select(F.explode("limitations").alias("limitation")))
    return re.assurance_report("documents", summary, re.coverage(results.select("area"), findings), re.sections(results),
                               re.recommended_actions(summary), limits, findings)


# --- DI -------------------------------------------------------------------------------------
# every event is one decision of an analyst on the finding of its user and type
_DECISIONS = """decisions AS (
  SELECT CAST(user_id AS VARCHAR) AS assessment_id, event_type AS finding_id, CASE WHEN value < 30 THEN 'ACCEPT' WHEN value < 80 THEN 'REVIEW' ELSE 'QUARANTINE' END AS disposition,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_id FROM events)"""


def _batch(t: Tables):
    v = F.col("value")
    placed = position_in_group(t.events, ["user_id"], [F.col("ts"), F.col("event_id")])
    return placed.select(
        F.col("user_id").cast("string").alias("assessment_id"), F.col("event_type").alias("finding_id"), "pos",
        F.when(v < 30, "accept").when(v < 80, "REVIEW").otherwise("QUARANTINE").alias("disposition"), F.lit("").alias("analyst_note"),
        F.sha2(F.col("event_type").cast("binary"), 256).alias("finding_digest"), F.col("event_type").alias("affected_asset"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.concat(F.lit("D"), F.col("event_id")).alias("event_id"))


def _stored(t: Tables):
    batch = _batch(t)
    nothing = batch.select("assessment_id", "finding_id", "pos", "disposition", "analyst_note", "timestamp", F.col("event_id").alias("audit_event_id")).limit(0)
    no_chain = batch.select(F.col("assessment_id").alias("chain_id"), "pos", F.lit("").alias("entry_hash")).limit(0)
    return di.append_decisions(nothing, no_chain, batch)


@query("di_append", with_sql(_DECISIONS, """
SELECT assessment_id, finding_id, pos, lag(disposition) OVER (PARTITION BY assessment_id, finding_id ORDER BY pos) AS old_disposition, disposition, 'D' || event_id AS audit_event_id FROM decisions"""))
def di_append(t: Tables):
    return _stored(t)[0].select("assessment_id", "finding_id", "pos", "old_disposition", "disposition", "audit_event_id")


@query("di_current", with_sql(_DECISIONS, "SELECT assessment_id, finding_id, arg_max(disposition, pos) AS disposition FROM decisions GROUP BY ALL"))
def di_current(t: Tables):
    rows = _batch(t).withColumn("audit_event_id", F.col("event_id")).withColumn("disposition", F.upper("disposition"))
    return di.current_dispositions(rows).select("assessment_id", "finding_id", "disposition")


@query("di_verify", with_sql(_DECISIONS, """
SELECT CASE WHEN d.disposition = 'REVIEW' AND e.value > 70 THEN 'payload_mismatch' ELSE 'bound' END AS binding_state, count(*) AS n FROM decisions d JOIN events e USING (event_id) GROUP BY ALL"""))
def di_verify(t: Tables):
    decisions, entries = _stored(t)
    values = t.events.select(F.concat(F.lit("D"), F.col("event_id")).alias("audit_event_id"), "value")
    changed = decisions.join(values.hint("merge"), "audit_event_id").withColumn(
        "analyst_note", F.when((F.col("disposition") == "REVIEW") & (F.col("value") > 70), "edited later").otherwise(F.col("analyst_note")))
    return di.verify_decisions(changed, entries).groupBy("binding_state").agg(F.count(F.lit(1)).alias("n"))


@query("di_consistency", with_sql(_DECISIONS, "SELECT assessment_id, count(*) AS decisions, count(*) AS events, true AS consistent FROM decisions GROUP BY assessment_id"))
def di_consistency(t: Tables):
    return di.store_consistency(*_stored(t))
