"""Queries A1-A8 over documents, labels and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contributor as co
from ..operators import labels as la
from ..operators import manifest as ma
from ..operators import metadata as me
from ..operators import near_duplicates as nd
from ..operators import nearest as ne
from ..operators import order_statistics as os_
from ..operators import patterns as pa
from ..operators.ordering import tree_digest_sql
from ..session import cut_lineage
from ..sources.tables import contributor_rows
from . import inputs
from .catalog import Tables, query, with_sql


def r6(column: str):
    return F.round(column, 6).alias(column)


# --- A1, A2 ---------------------------------------------------------------------------------
@query("a1_manifest", with_sql(inputs.MANIFEST, "SELECT path, sha256, size_bytes FROM manifest"))
def a1_manifest(t: Tables):
    return inputs.manifest(t)


_MANIFEST_ROW = """'{"path":"' || path || '","sha256":"' || sha256 || '","size_bytes":' || CAST(size_bytes AS VARCHAR) || '}'"""


@query("a1_dataset_digest", with_sql(inputs.MANIFEST, "SELECT item_count AS file_count, digest AS dataset_sha256 FROM "
                                     + tree_digest_sql("manifest", "string_split(path, '/')", _MANIFEST_ROW)))
def a1_dataset_digest(t: Tables):
    return ma.dataset_digest(inputs.manifest(t))


@query("a1_merkle_root", with_sql(inputs.MANIFEST, """
levels AS (
  SELECT 0 AS level, list(sha256 ORDER BY sha256) AS nodes, count(*) AS leaf_count FROM manifest
  UNION ALL
  SELECT level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], nodes[2 * i + 1]))), leaf_count
  FROM levels WHERE len(nodes) > 1)""", "SELECT leaf_count, nodes[1] AS merkle_root FROM levels WHERE len(nodes) = 1").replace("WITH ", "WITH RECURSIVE ", 1))
def a1_merkle_root(t: Tables):
    return ma.merkle_root(inputs.manifest(t))


@query("a1_identity_gate", with_sql(inputs.MANIFEST, """expected AS (
  SELECT path AS asset_id, CASE WHEN size_bytes > 9000 THEN repeat('0', 64) ELSE sha256 END AS expected_sha256 FROM manifest)""", """
SELECT asset_id, expected_sha256, sha256, CASE WHEN expected_sha256 = sha256 THEN 'verified' ELSE 'identity_mismatch' END AS status,
  expected_sha256 = sha256 AS downstream_enabled FROM expected JOIN manifest ON asset_id = path"""))
def a1_identity_gate(t: Tables):
    computed = inputs.manifest(t)
    expected = computed.select(F.col("path").alias("asset_id"),
                               F.when(F.col("size_bytes") > 9000, "0" * 64).otherwise(F.col("sha256")).alias("expected_sha256"))
    return ma.identity_gate(expected, computed.select(F.col("path").alias("asset_id"), "sha256"))


@query("a2_duplicate_groups", with_sql(inputs.MANIFEST, """
SELECT sha256, count(*) AS file_count, min(path) AS first_file FROM manifest GROUP BY sha256 HAVING count(*) > 1"""))
def a2_duplicate_groups(t: Tables):
    return ma.duplicate_groups(inputs.manifest(t))


@query("a2_duplicate_members", with_sql(inputs.MANIFEST, """
SELECT path, sha256, count(*) OVER (PARTITION BY sha256) AS file_count FROM manifest QUALIFY file_count > 1"""))
def a2_duplicate_members(t: Tables):
    return ma.duplicate_members(inputs.manifest(t))


@query("a2_duplicate_totals", with_sql(inputs.MANIFEST, """
SELECT count(*) AS duplicate_group_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_file_count
FROM (SELECT count(*) AS n FROM manifest GROUP BY sha256) WHERE n > 1"""))
def a2_duplicate_totals(t: Tables):
    return ma.duplicate_totals(inputs.manifest(t))


# --- A3 -------------------------------------------------------------------------------------
_GROUPS = "hash_groups AS (SELECT hash, count(*) AS n, min(path) AS f FROM hashed GROUP BY hash)"
_PAIRS = """hash_pairs AS (
  SELECT a.hash AS hash_a, b.hash AS hash_b, CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) AS hamming_distance, a.n AS files_a, b.n AS files_b,
         a.f AS file_a, b.f AS file_b, CASE WHEN a.hash = b.hash THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS file_pairs
  FROM hash_groups a JOIN hash_groups b ON bit_count(xor(a.hash, b.hash)) <= 8 AND (a.hash < b.hash OR (a.hash = b.hash AND a.n > 1)))"""


@query("a3_difference_hash", with_sql(inputs.HASHED, "SELECT path, hash FROM hashed"))
def a3_difference_hash(t: Tables):
    return inputs.hashed(t).select("path", "hash")


@query("a3_near_duplicate_pairs", with_sql(inputs.HASHED, _GROUPS, _PAIRS, "SELECT * FROM hash_pairs"))
def a3_near_duplicate_pairs(t: Tables):
    return nd.near_duplicate_pairs(inputs.hashed(t).select("path", "hash"))


@query("a3_near_duplicate_report", with_sql(inputs.HASHED, """scanned AS (
  SELECT path, CASE WHEN n_chars >= 100 THEN hash END AS hash FROM hashed)""",
       "hash_groups AS (SELECT hash, count(*) AS n, min(path) AS f FROM scanned WHERE hash IS NOT NULL GROUP BY hash)", _PAIRS, """
SELECT count(*) AS images_discovered, count(hash) AS images_hashed, count(*) - count(hash) AS images_skipped,
  (SELECT CAST(coalesce(sum(file_pairs), 0) AS BIGINT) FROM hash_pairs) AS near_duplicate_pair_count FROM scanned"""))
def a3_near_duplicate_report(t: Tables):
    files = cut_lineage(inputs.hashed(t).select("path", F.when(F.col("n_chars") >= 100, F.col("hash")).alias("hash")))
    return nd.near_duplicate_report(files, nd.near_duplicate_pairs(files))


@query("a3_near_duplicate_groups", with_sql(inputs.HASHED, _GROUPS, _PAIRS, """walk AS (
  SELECT hash AS node, hash AS seen FROM hash_groups
  UNION
  SELECT node, CASE WHEN p.hash_a = seen THEN p.hash_b ELSE p.hash_a END FROM walk JOIN hash_pairs p ON seen IN (p.hash_a, p.hash_b)),
grouped AS (SELECT node, min(seen) AS group_hash FROM walk GROUP BY node)""", """
SELECT group_hash, count(*) AS hash_count, CAST(sum(n) AS BIGINT) AS file_count, min(f) AS first_path FROM grouped JOIN hash_groups ON hash = node GROUP BY group_hash HAVING sum(n) > 1""").replace("WITH ", "WITH RECURSIVE ", 1))
def a3_near_duplicate_groups(t: Tables):
    return nd.near_duplicate_groups(inputs.hashed(t).select("path", "hash"))


# --- A4 -------------------------------------------------------------------------------------
_COSINE = "round(1 - greatest(-1, least(1, list_cosine_similarity(CAST({a}.embedding AS DOUBLE[]), CAST({b}.embedding AS DOUBLE[])))), 12)"
_FIT = f"""trusted AS (SELECT * FROM embeddings WHERE label < 3),
loo AS (SELECT a.vec_id, min({_COSINE.format(a='a', b='b')}) AS d FROM trusted a JOIN trusted b ON a.vec_id <> b.vec_id GROUP BY a.vec_id),
fitted AS (SELECT count(*) AS reference_count, CAST(max(CAST(d AS FLOAT)) AS DOUBLE) AS threshold FROM loo)"""
_ASSESS = f"""ranked AS (
  SELECT c.vec_id AS id, r.vec_id AS nearest_reference_index, {_COSINE.format(a='c', b='r')} AS distance,
    row_number() OVER (PARTITION BY c.vec_id ORDER BY {_COSINE.format(a='c', b='r')}, r.vec_id) AS k
  FROM embeddings c JOIN trusted r ON c.label >= 3),
assessed AS (SELECT id, nearest_reference_index, distance, threshold, distance > threshold AS potential_ood FROM ranked, fitted WHERE k = 1)"""


def _reference(t: Tables):
    return t.embeddings.where("label < 3").select(F.col("vec_id").alias("ref_index"), F.col("embedding").alias("features"))


def _candidates(t: Tables):
    return t.embeddings.where("label >= 3").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))


@query("a4_reference_fit", with_sql(_FIT, "SELECT reference_count, round(threshold, 6) AS threshold FROM fitted"))
def a4_reference_fit(t: Tables):
    return ne.fit_reference(_reference(t)).select("reference_count", r6("threshold"))


@query("a4_assess_candidates", with_sql(_FIT, _ASSESS, """
SELECT id, nearest_reference_index, round(distance, 6) AS distance, round(threshold, 6) AS threshold, potential_ood FROM assessed"""))
def a4_assess_candidates(t: Tables):
    return ne.assess_candidates(_candidates(t), _reference(t)).select("id", "nearest_reference_index", r6("distance"), r6("threshold"), "potential_ood")


@query("a4_totals", with_sql(_FIT, _ASSESS, """
SELECT count(*) AS candidate_count, count(*) FILTER (potential_ood) AS potential_ood_count FROM assessed"""))
def a4_totals(t: Tables):
    return ne.assessment_totals(ne.assess_candidates(_candidates(t), _reference(t)))


# --- A5 -------------------------------------------------------------------------------------
_PARSED = """label_lines AS (
  SELECT image, text, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS raw FROM label_files),
line_rows AS (SELECT image, generate_subscripts(raw, 1) AS no, string_split(unnest(raw), ' ') AS parts FROM label_lines),
typed AS (
  SELECT *, len(parts) AS n, TRY_CAST(parts[1] AS INTEGER) AS c, TRY_CAST(parts[2] AS DOUBLE) AS x, TRY_CAST(parts[3] AS DOUBLE) AS y,
    TRY_CAST(parts[4] AS DOUBLE) AS w, TRY_CAST(parts[5] AS DOUBLE) AS h FROM line_rows),
checks AS (
  SELECT image, no, 0 AS k, 'Line ' || no || ': expected 5 values, found ' || n || '.' AS e FROM typed WHERE n <> 5
  UNION ALL SELECT image, no, 1, 'Line ' || no || ': non-numeric annotation values.' FROM typed WHERE n = 5 AND (c IS NULL OR x IS NULL OR y IS NULL OR w IS NULL OR h IS NULL)
  UNION ALL SELECT image, no, 2, 'Line ' || no || ': class ID ' || c || ' is outside configured class range 0-1.' FROM typed WHERE n = 5 AND c >= 2 AND x IS NOT NULL AND w IS NOT NULL
  UNION ALL SELECT image, no, 4, 'Line ' || no || ': y_center=' || y || ' is outside [0, 1].' FROM typed WHERE n = 5 AND y > 1 AND x IS NOT NULL AND w IS NOT NULL
  UNION ALL SELECT image, no, 7, 'Line ' || no || ': width must be greater than zero.' FROM typed WHERE n = 5 AND w <= 0),
parsed AS (
  SELECT l.image, text IS NOT NULL AS exists, text IS NOT NULL AND len(raw) = 0 AS empty,
    CASE WHEN text IS NULL THEN 'Missing label file.' ELSE coalesce((SELECT string_agg(e, ' | ' ORDER BY no, k) FROM checks c WHERE c.image = l.image), '') END AS errors,
    coalesce((SELECT string_agg(DISTINCT c::VARCHAR, ',' ORDER BY c::VARCHAR) FROM typed y WHERE y.image = l.image AND n = 5 AND x IS NOT NULL AND y.y IS NOT NULL AND w IS NOT NULL), '') AS classes,
    coalesce((SELECT string_agg(c || '/' || round(x, 4) || '/' || round(w, 4), ';' ORDER BY c) FROM typed y WHERE y.image = l.image AND n = 5 AND x IS NOT NULL AND y.y IS NOT NULL AND w IS NOT NULL), '') AS signature
  FROM label_lines l)"""
_STATES = """states AS (
  SELECT image, CASE WHEN NOT exists THEN 'missing' WHEN errors <> '' THEN 'malformed' WHEN empty THEN 'empty' ELSE 'ok' END AS label_state FROM parsed)"""
_CONFLICTS = """usable AS (
  SELECT p.image, h.hash, p.classes, f.features FROM parsed p JOIN hashed h ON h.path = p.image JOIN features f USING (doc_id)
  WHERE p.exists AND p.errors = '' AND NOT p.empty),
conflicts AS (
  SELECT least(a.image, b.image) AS image_a, greatest(a.image, b.image) AS image_b FROM usable a JOIN usable b
  ON a.image < b.image AND a.classes <> b.classes AND bit_count(xor(a.hash, b.hash)) <= 8
  AND coalesce(list_cosine_similarity(a.features, b.features), 0) >= 0.9)"""


@query("a5_parsed_labels", with_sql(inputs.LABEL_FILES, _PARSED, "SELECT * FROM parsed"))
def a5_parsed_labels(t: Tables):
    parsed = la.parse_labels(inputs.label_files(t), num_classes=2)
    signature = F.transform("signature", lambda a: F.concat_ws("/", a["class_id"].cast("string"), a["x_center"].cast("string"), a["width"].cast("string")))
    return parsed.select("image", "exists", "empty", F.array_join("errors", " | ").alias("errors"),
                         F.array_join(F.transform("class_set", lambda c: c.cast("string")), ",").alias("classes"),
                         F.array_join(signature, ";").alias("signature"))


def _parsed(t: Tables):
    return la.parse_labels(inputs.label_files(t), num_classes=2)


@query("a5_label_states", with_sql(inputs.LABEL_FILES, _PARSED, _STATES, "SELECT image, label_state FROM states"))
def a5_label_states(t: Tables):
    return la.label_states(inputs.label_files(t), _parsed(t)).select("image", "label_state")


def _usable(t: Tables):
    good = la.parse_labels(inputs.label_files(t)).where("valid and not empty").select("image", "class_set")
    hashes = inputs.hashed(t).select(F.col("path").alias("image"), "hash")
    return cut_lineage(good.join(hashes, "image").join(inputs.features(t), "image"))


_USABLE_ANY_CLASS = _PARSED.replace("UNION ALL SELECT image, no, 2, 'Line ' || no || ': class ID ' || c || ' is outside configured class range 0-1.' FROM typed WHERE n = 5 AND c >= 2 AND x IS NOT NULL AND w IS NOT NULL\n", "")


@query("a5_conflicts", with_sql(inputs.LABEL_FILES, _USABLE_ANY_CLASS, inputs.HASHED, inputs.FEATURES, _CONFLICTS, """
SELECT CAST(count(*) AS BIGINT) AS conflicting_pairs FROM conflicts"""))
def a5_conflicts(t: Tables):
    found = la.conflicting_profiles(cut_lineage(la.label_profiles(_usable(t))))
    return found.agg(F.coalesce(F.sum("conflict_pairs"), F.lit(0)).cast("long").alias("conflicting_pairs"))


@query("a5_label_totals", with_sql(inputs.LABEL_FILES, _USABLE_ANY_CLASS, _STATES, inputs.HASHED, inputs.FEATURES, _CONFLICTS, """
SELECT *, missing_label_count + malformed_label_count + empty_label_count + conflicting_pair_count AS finding_count FROM (
  SELECT count(*) FILTER (label_state = 'missing') AS missing_label_count, count(*) FILTER (label_state = 'malformed') AS malformed_label_count,
    count(*) FILTER (label_state = 'empty') AS empty_label_count, (SELECT count(*) FROM conflicts) AS conflicting_pair_count FROM states)"""))
def a5_label_totals(t: Tables):
    files = inputs.label_files(t)
    states = la.label_states(files, la.parse_labels(files))
    return la.label_totals(states, la.conflicting_profiles(cut_lineage(la.label_profiles(_usable(t)))))


# --- A6 -------------------------------------------------------------------------------------
_DISTRIBUTION = "class_counts AS (SELECT contributor, class, count(*) AS n FROM contributors GROUP BY ALL)"
_PROFILES = """profiles AS (
  SELECT contributor, CAST(sum(n) AS BIGINT) AS image_count, count(*) AS class_count, greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0) AS class_entropy,
    max(n) / sum(n) AS dominant_class_ratio FROM class_counts GROUP BY contributor)"""
_COPIES = """copies AS (
  SELECT *, sum(n) OVER (PARTITION BY sha256) AS g, count(*) OVER (PARTITION BY sha256) AS gc FROM (SELECT contributor, sha256, count(*) AS n FROM contributors GROUP BY ALL)),
duplicates AS (
  SELECT contributor, CAST(sum(n) AS BIGINT) AS images_hashed, CAST(coalesce(sum(n) FILTER (g > 1), 0) AS BIGINT) AS duplicate_images,
    count(*) FILTER (g > 1) AS duplicate_groups, count(*) FILTER (g > 1 AND gc > 1) AS cross_contributor_groups FROM copies GROUP BY contributor)"""
_CONFLICT_EVIDENCE = """owners AS (
  SELECT DISTINCT k.image_a, k.image_b, c.contributor FROM conflicts k JOIN contributors c ON c.file IN (k.image_a, k.image_b)),
conflict_evidence AS (
  SELECT p.contributor, count(o.image_a) AS conflict_pairs, count(o.image_a) / any_value(image_count) AS label_conflict_rate
  FROM profiles p LEFT JOIN owners o USING (contributor) GROUP BY p.contributor)"""
_OOD = """ood_results AS (SELECT path AS file, n_chars > 4000 AS potential_ood FROM hashed WHERE doc_id IN (SELECT doc_id FROM labels)),
ood AS (SELECT contributor, count(*) AS ood_assessed, count(*) FILTER (potential_ood) AS ood_images, count(*) FILTER (potential_ood) / count(*) AS ood_rate
  FROM contributors JOIN ood_results USING (file) GROUP BY contributor)"""


def _rows(t: Tables):
    raw = inputs.contributors(t)
    return contributor_rows(raw).join(raw.select("file", "sha256"), "file")


@query("a6_class_distribution", with_sql(inputs.CONTRIBUTORS, "SELECT contributor, class, count(*) AS image_count FROM contributors GROUP BY ALL"))
def a6_class_distribution(t: Tables):
    return co.class_distribution(contributor_rows(inputs.contributors(t)))


@query("a6_profiles", with_sql(inputs.CONTRIBUTORS, _DISTRIBUTION, _PROFILES, """
SELECT p.contributor, image_count, class_count, round(class_entropy, 6) AS class_entropy, round(dominant_class_ratio, 6) AS dominant_class_ratio,
  (SELECT count(*) FROM contributors c WHERE c.contributor = p.contributor AND timestamp <> '') AS timestamp_count FROM profiles p"""))
def a6_profiles(t: Tables):
    return co.contributor_profiles(contributor_rows(inputs.contributors(t))).withColumns(
        {c: F.round(c, 6) for c in ("class_entropy", "dominant_class_ratio")})


@query("a6_duplicate_evidence", with_sql(inputs.CONTRIBUTORS, _COPIES, """
SELECT *, round(duplicate_images / images_hashed, 6) AS duplicate_rate FROM duplicates"""))
def a6_duplicate_evidence(t: Tables):
    return co.duplicate_evidence(_rows(t)).withColumn("duplicate_rate", F.round("duplicate_rate", 6))


def _ood(t: Tables):
    results = t.documents.join(t.labels, "doc_id", "left_semi").select(inputs.doc_path().alias("file"), (F.col("n_chars") > 4000).alias("potential_ood"))
    return co.ood_evidence(contributor_rows(inputs.contributors(t)), results)


@query("a6_ood_evidence", with_sql(inputs.HASHED, inputs.CONTRIBUTORS, _OOD, "SELECT contributor, ood_assessed, ood_images, round(ood_rate, 6) AS ood_rate FROM ood"))
def a6_ood_evidence(t: Tables):
    return _ood(t).withColumn("ood_rate", F.round("ood_rate", 6))


def _conflict_evidence(t: Tables):
    usable = _usable(t)
    profiles = cut_lineage(la.label_profiles(usable))
    rows = contributor_rows(inputs.contributors(t))
    owners = la.images_of_profiles(usable, profiles).join(rows.select(F.col("file").alias("image"), F.col("contributor").alias("owner")), "image")
    return co.label_conflict_evidence(rows, la.conflicting_profiles(profiles), owners.select("profile", "owner"))


_CONFLICT_PARTS = (inputs.LABEL_FILES, _USABLE_ANY_CLASS, inputs.HASHED, inputs.FEATURES, _CONFLICTS, inputs.CONTRIBUTORS, _DISTRIBUTION, _PROFILES,
                   _CONFLICT_EVIDENCE)


@query("a6_label_conflict_evidence", with_sql(*_CONFLICT_PARTS, """
SELECT contributor, conflict_pairs, round(label_conflict_rate, 6) AS label_conflict_rate FROM conflict_evidence"""))
def a6_label_conflict_evidence(t: Tables):
    return _conflict_evidence(t).withColumn("label_conflict_rate", F.round("label_conflict_rate", 6))


_RISK = """facts AS (
  SELECT p.*, duplicate_groups, duplicate_images / images_hashed AS duplicate_rate, coalesce(ood_rate, 0) AS ood_rate, label_conflict_rate,
    (SELECT avg(image_count) FROM profiles) AS mi, (SELECT avg(round(class_entropy, 6)) FROM profiles) AS me, (SELECT count(*) FROM profiles) AS nc
  FROM profiles p JOIN duplicates USING (contributor) LEFT JOIN ood USING (contributor) JOIN conflict_evidence USING (contributor)),
scored AS (
  SELECT contributor, image_count, least(100.0, CASE WHEN image_count > 3 * mi THEN 25 ELSE 0 END + CASE WHEN image_count >= 5 AND dominant_class_ratio >= 0.9 THEN 20 ELSE 0 END
    + CASE WHEN class_count = 1 AND nc > 1 THEN 10 ELSE 0 END + CASE WHEN duplicate_rate >= 0.25 THEN 10 ELSE 0 END + CASE WHEN duplicate_rate >= 0.5 THEN 10 ELSE 0 END
    + CASE WHEN duplicate_groups > 0 THEN 5 ELSE 0 END + CASE WHEN ood_rate >= 0.25 THEN 10 ELSE 0 END + CASE WHEN ood_rate >= 0.5 THEN 10 ELSE 0 END
    + CASE WHEN label_conflict_rate >= 0.25 THEN 10 ELSE 0 END + CASE WHEN label_conflict_rate >= 0.5 THEN 10 ELSE 0 END
    + CASE WHEN nc >= 3 AND me > 0 AND round(class_entropy, 6) < 0.25 * me THEN 15 ELSE 0 END) AS risk_score,
    concat_ws(',', CASE WHEN image_count > 3 * mi THEN 'unusually_high_contribution_volume' END, CASE WHEN image_count >= 5 AND dominant_class_ratio >= 0.9 THEN 'high_class_concentration' END,
    CASE WHEN class_count = 1 AND nc > 1 THEN 'single_class_contribution' END, CASE WHEN duplicate_rate >= 0.25 THEN 'elevated_duplicate_rate' END,
    CASE WHEN duplicate_rate >= 0.5 THEN 'high_duplicate_rate' END, CASE WHEN duplicate_groups > 0 THEN 'cross_contributor_duplicate_detected' END,
    CASE WHEN ood_rate >= 0.25 THEN 'elevated_ood_rate' END, CASE WHEN ood_rate >= 0.5 THEN 'high_ood_rate' END,
    CASE WHEN label_conflict_rate >= 0.25 THEN 'elevated_label_conflict_rate' END, CASE WHEN label_conflict_rate >= 0.5 THEN 'high_label_conflict_rate' END,
    CASE WHEN nc >= 3 AND me > 0 AND round(class_entropy, 6) < 0.25 * me THEN 'unusually_low_class_entropy' END) AS findings FROM facts),
graded AS (SELECT *, CASE WHEN risk_score >= 50 THEN 'HIGH' WHEN risk_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM scored)"""
_RISK_PARTS = (*_CONFLICT_PARTS, _COPIES, _OOD, _RISK)


def scored_contributors(t: Tables):
    rows = _rows(t)
    return co.contributor_risk(co.contributor_profiles(rows), co.duplicate_evidence(rows), _ood(t), _conflict_evidence(t))


@query("a6_contributor_risk", with_sql(*_RISK_PARTS, "SELECT contributor, CAST(risk_score AS DOUBLE) AS risk_score, risk_level, findings FROM graded"))
def a6_contributor_risk(t: Tables):
    return scored_contributors(t).select("contributor", "risk_score", "risk_level", F.array_join("findings", ",").alias("findings"))


@query("a6_risk_totals", with_sql(*_RISK_PARTS, """
SELECT CAST(sum(image_count) AS BIGINT) AS row_count, count(*) AS contributor_count, count(*) FILTER (findings <> '') AS finding_count,
  count(*) FILTER (risk_level = 'HIGH') AS high_risk_contributors, count(*) FILTER (risk_level = 'MEDIUM') AS medium_risk_contributors FROM graded"""))
def a6_risk_totals(t: Tables):
    return co.risk_totals(scored_contributors(t))


# --- A7 -------------------------------------------------------------------------------------
_ATTRIBUTES = ("format", "resolution", "mode", "camera", "software", "quant_hash", "has_exif")
_COUNTS = "counts AS (" + " UNION ALL ".join(
    f"SELECT contributor, '{a}' AS attribute, CAST({a} AS VARCHAR) AS value, count(*) AS n FROM metadata GROUP BY ALL" for a in _ATTRIBUTES) + ")"
_DIVERGENCE = """keys AS (SELECT DISTINCT attribute, value FROM counts),
people AS (SELECT contributor, count(*) AS own, (SELECT count(*) FROM metadata) AS total FROM metadata GROUP BY contributor),
aligned AS (
  SELECT p.contributor, k.attribute, coalesce(c.n, 0) AS n, own, total - own AS rest, (SELECT sum(n) FROM counts x WHERE x.attribute = k.attribute AND x.value = k.value) AS all_n
  FROM people p JOIN keys k ON own >= 3 AND total - own >= 3 LEFT JOIN counts c ON c.contributor = p.contributor AND c.attribute = k.attribute AND c.value = k.value),
divergence AS (SELECT contributor, attribute, 0.5 * sum(abs(n / own - (all_n - n) / rest)) AS tv_distance FROM aligned GROUP BY ALL)"""
_IMAGE_FINDINGS = """facts7 AS (
  SELECT *, lower(regexp_extract(file, '(\\.[^.]*)$', 1)) AS ext, count(*) OVER (PARTITION BY resolution) AS rc, count(*) OVER () AS total,
    (SELECT median(capture_epoch) FROM metadata) AS mid FROM metadata),
image_findings AS (
  SELECT file, contributor, 'format_extension_mismatch' AS code, 'low' AS severity FROM facts7 WHERE (format = 'JPEG' AND ext NOT IN ('.jpg', '.jpeg', '.jpe')) OR (format = 'PNG' AND ext <> '.png')
  UNION ALL SELECT file, contributor, 'editing_software_tag', 'info' FROM facts7 WHERE contains(lower(software), 'photoshop') OR contains(lower(software), 'gimp')
  UNION ALL SELECT file, contributor, 'rare_resolution', 'info' FROM facts7 WHERE total >= 20 AND rc / total < 0.05
  UNION ALL SELECT file, contributor, 'future_capture_time', 'medium' FROM facts7 WHERE capture_epoch > 1750000000
  UNION ALL SELECT file, contributor, 'capture_time_outlier', 'low' FROM facts7 WHERE abs(capture_epoch - mid) > 365 * 86400)"""


def _image_findings(t: Tables):
    rows = cut_lineage(inputs.metadata(t))
    return rows, me.image_findings(rows, median_epoch=me.median_capture(rows), reference_time=1_750_000_000.0)


@query("a7_value_distributions", with_sql(inputs.METADATA, _COUNTS, """
SELECT 'contributor' AS scope, contributor, attribute, value, n, round(n / sum(n) OVER (PARTITION BY contributor, attribute), 6) AS share FROM counts
UNION ALL SELECT 'dataset', NULL, attribute, value, CAST(sum(n) AS BIGINT), round(sum(n) / (SELECT count(*) FROM metadata), 6) FROM counts GROUP BY attribute, value"""))
def a7_value_distributions(t: Tables):
    return me.distributions(cut_lineage(me.value_counts(inputs.metadata(t)))).withColumn("share", F.round("share", 6))


@query("a7_contributor_divergence", with_sql(inputs.METADATA, _COUNTS, _DIVERGENCE, """
SELECT contributor, attribute, round(tv_distance, 6) AS tv_distance,
  CASE WHEN tv_distance >= 0.8 THEN 'high_metadata_divergence' WHEN tv_distance >= 0.5 THEN 'elevated_metadata_divergence' END AS code FROM divergence"""))
def a7_contributor_divergence(t: Tables):
    return me.contributor_divergence(cut_lineage(me.value_counts(inputs.metadata(t)))).withColumn("tv_distance", F.round("tv_distance", 6))


@query("a7_median_capture", with_sql(inputs.METADATA, "SELECT median(capture_epoch) AS median_epoch FROM metadata"))
def a7_median_capture(t: Tables):
    rows = cut_lineage(inputs.metadata(t).select("capture_epoch"))
    return rows.agg(F.max(F.lit(0)).alias("one")).select(me.median_capture(rows).alias("median_epoch"))


@query("a7_supplier_spread", """
SELECT l_suppkey, round(median, 6) AS median, round(mad, 6) AS mad, outliers FROM (
  SELECT l_suppkey, any_value(m) AS median, any_value(d) AS mad, count(*) FILTER (abs(0.6745 * (v - m) / nullif(d, 0)) >= 3.5) AS outliers FROM (
    SELECT l_suppkey, v, median(v) OVER (PARTITION BY l_suppkey) AS m, mad(v) OVER (PARTITION BY l_suppkey) AS d
    FROM (SELECT l_suppkey, CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE) + CASE WHEN l_linenumber = 7 THEN 9000 ELSE 0 END AS v FROM lineitem)) GROUP BY l_suppkey)""")
def a7_supplier_spread(t: Tables):
    """Medians, median absolute deviations and robust outliers of unit prices by supplier, the contributor of a line; every seventh line is overpriced."""
    price = F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double") + F.when(F.col("l_linenumber") == 7, 9000).otherwise(0)
    found = os_.group_spread(t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", price.alias("v")), ["l_suppkey"], "v")
    return found.select("l_suppkey", r6("median"), r6("mad"), "outliers")


@query("a7_image_findings", with_sql(inputs.METADATA, _IMAGE_FINDINGS, "SELECT * FROM image_findings"))
def a7_image_findings(t: Tables):
    return _image_findings(t)[1].select("file", "contributor", "code", "severity")


@query("a7_contributor_evidence", with_sql(inputs.METADATA, _COUNTS, _DIVERGENCE, _IMAGE_FINDINGS, """
SELECT p.contributor, own AS images_assessed, coalesce(odd, 0) AS metadata_anomaly_images, round(coalesce(odd, 0) / own, 6) AS metadata_anomaly_rate,
  coalesce(md, 0) AS max_divergence, coalesce(da, '') AS divergent_attributes FROM people p
LEFT JOIN (SELECT contributor, count(DISTINCT file) AS odd FROM image_findings WHERE severity <> 'info' GROUP BY ALL) USING (contributor)
LEFT JOIN (SELECT contributor, max(round(tv_distance, 4)) AS md, string_agg(attribute, ',' ORDER BY attribute) FILTER (tv_distance >= 0.5) AS da FROM divergence GROUP BY ALL) USING (contributor)"""))
def a7_contributor_evidence(t: Tables):
    rows, findings = _image_findings(t)
    evidence = me.contributor_evidence(rows, findings, me.contributor_divergence(cut_lineage(me.value_counts(rows))))
    return evidence.withColumns({"metadata_anomaly_rate": F.round("metadata_anomaly_rate", 6),
                                 "divergent_attributes": F.array_join("divergent_attributes", ",")})


@query("a7_findings_by_severity", with_sql(inputs.METADATA, _IMAGE_FINDINGS, "SELECT severity, count(*) AS finding_count FROM image_findings GROUP BY severity"))
def a7_findings_by_severity(t: Tables):
    return me.findings_by_severity(_image_findings(t)[1])


@query("a7_assigned_contributors", """
SELECT url AS file, CASE WHEN contains(url, 'example.org') THEN 'known' WHEN contains(url, '/') THEN split_part(url, '/', 1) ELSE 'unassigned' END AS contributor, count(*) AS rows_with_url
FROM pages GROUP BY ALL""")
def a7_assigned_contributors(t: Tables):
    pages = t.pages.select(F.col("url").alias("file"), "page_id")
    mapping = pages.where(F.contains("url", F.lit("example.org"))).select("file", F.lit("known").alias("contributor")).distinct()
    return me.assign_contributor(pages, mapping, from_path=True).groupBy("file", "contributor").agg(F.count(F.lit(1)).alias("rows_with_url"))


# --- A8 -------------------------------------------------------------------------------------
# first fit in processing order: the recursion walks the candidates one by one and keeps the leaders so far
_LEADERS = """described AS (
  SELECT *, row_number() OVER (ORDER BY file, -peak_hf, y0, x0, region_no) AS k FROM regions WHERE descriptor IS NOT NULL),
walk AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS leaders, CAST(NULL AS BIGINT) AS leader
  UNION ALL
  SELECT d.k, CASE WHEN hit IS NULL THEN list_append(leaders, descriptor) ELSE leaders END, coalesce(hit, descriptor) FROM (
    SELECT d.k, d.descriptor, w.leaders, list_filter(w.leaders, lambda r: bit_count(xor(r, d.descriptor)) <= 6)[1] AS hit FROM walk w JOIN described d ON d.k = w.k + 1) d),
assigned AS (SELECT r.*, w.leader FROM regions r LEFT JOIN described d USING (file, region_no) LEFT JOIN walk w ON w.k = d.k)"""
_PATTERNS = """members AS (SELECT leader, file, cx, cy, peak_hf, label FROM assigned WHERE leader IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY leader, file ORDER BY -peak_hf, y0, x0, region_no) = 1),
grouped AS (SELECT leader, count(*) AS image_count, min(file) AS first_file, avg(peak_hf) AS mean_peak_hf, median(cx) AS median_x, median(cy) AS median_y
  FROM members GROUP BY leader HAVING count(*) >= 3),
spread AS (SELECT leader, avg(CAST(greatest(abs(cx - median_x), abs(cy - median_y)) <= 0.08 AS INTEGER)) AS concentrated_fraction,
  max(greatest(abs(cx - median_x), abs(cy - median_y))) AS max_offset FROM members JOIN grouped USING (leader) GROUP BY leader),
pattern_rows AS (
  SELECT *, image_count / (SELECT count(*) FROM regions) AS support, concentrated_fraction >= 0.75 AS concentrated,
    printf('%016x', CASE WHEN leader < 0 THEN CAST(leader AS HUGEINT) + CAST(18446744073709551616 AS HUGEINT) ELSE leader END::UBIGINT) AS descriptor_hex
  FROM grouped JOIN spread USING (leader)),
patterns AS (
  SELECT *, 'P' || lpad(CAST(row_number() OVER (ORDER BY image_count DESC, first_file, descriptor_hex) AS VARCHAR), 3, '0') AS pattern_id,
    CASE WHEN NOT concentrated THEN 'low' WHEN image_count >= 5 AND support <= 0.5 THEN 'high' ELSE 'medium' END AS severity FROM pattern_rows)"""
_PATTERN_PARTS = (inputs.REGIONS, _LEADERS, _PATTERNS)


def _recursive(*parts: str) -> str:
    return with_sql(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


def _assigned(t: Tables):
    candidates = cut_lineage(inputs.regions(t))
    return candidates, cut_lineage(pa.assign_leaders(candidates, pa.first_fit_leaders(candidates)))


def _assessed(candidates):
    return candidates.agg(F.count(F.lit(1)).alias("images_assessed"))


@query("a8_pattern_leaders", _recursive(inputs.REGIONS, _LEADERS, "SELECT file, region_no, leader FROM assigned"))
def a8_pattern_leaders(t: Tables):
    return _assigned(t)[1].select("file", "region_no", "leader")


@query("a8_patterns", _recursive(*_PATTERN_PARTS, """
SELECT pattern_id, leader, image_count, first_file, round(support, 6) AS support_fraction, round(mean_peak_hf, 4) AS mean_peak_hf, median_x, median_y,
  round(concentrated_fraction, 6) AS concentrated_fraction, round(max_offset, 6) AS max_offset, concentrated, severity,
  CASE WHEN median_y < 1/3 THEN 'top-' WHEN median_y < 2/3 THEN 'middle-' ELSE 'bottom-' END || CASE WHEN median_x < 1/3 THEN 'left' WHEN median_x < 2/3 THEN 'center' ELSE 'right' END AS zone_name
FROM patterns""").replace("AS zone_name", "AS zone_parts"))
def a8_patterns(t: Tables):
    candidates, assigned = _assigned(t)
    ranked = pa.patterns(pa.pattern_members(assigned), _assessed(candidates))
    zone = F.when(F.col("zone") == "center", "middle-center").otherwise(F.col("zone"))
    return ranked.select("pattern_id", "leader", "image_count", "first_file", r6("support_fraction"), F.round("mean_peak_hf", 4).alias("mean_peak_hf"),
                         "median_x", "median_y", r6("concentrated_fraction"), r6("max_offset"), "concentrated", "severity", zone.alias("zone_parts"))


@query("a8_class_evidence", _recursive(*_PATTERN_PARTS, """
totals AS (SELECT label, count(*) AS class_total FROM regions GROUP BY label),
counted AS (SELECT leader, label, count(*) AS n FROM members GROUP BY ALL),
top AS (SELECT leader, label, n, sum(n) OVER (PARTITION BY leader) AS m FROM counted QUALIFY row_number() OVER (PARTITION BY leader ORDER BY n DESC, label DESC) = 1),
joined AS (SELECT pattern_id, top.label AS top_class, CAST(m AS BIGINT) AS labelled_member_count, n AS top_class_member_count, class_total AS top_class_total,
  (SELECT count(*) FROM regions) AS labelled_total FROM patterns JOIN top USING (leader) JOIN totals ON totals.label = top.label WHERE m >= 3)""", """
SELECT *, round(top_class_member_count / labelled_member_count, 6) AS member_share,
  round(list_sum(list_transform(range(top_class_member_count, least(labelled_member_count, top_class_total) + 1), lambda i: CASE WHEN labelled_member_count - i <= labelled_total - top_class_total THEN exp(
    lgamma(top_class_total + 1) - lgamma(i + 1) - lgamma(top_class_total - i + 1) + lgamma(labelled_total - top_class_total + 1) - lgamma(labelled_member_count - i + 1)
    - lgamma(labelled_total - top_class_total - labelled_member_count + i + 1) - lgamma(labelled_total + 1) + lgamma(labelled_member_count + 1) + lgamma(labelled_total - labelled_member_count + 1)) ELSE 0 END)), 5) AS p_value
FROM joined"""))
def a8_class_evidence(t: Tables):
    candidates, assigned = _assigned(t)
    members = pa.pattern_members(assigned)
    labels = candidates.select("file", "label")
    found = pa.class_evidence(members, pa.patterns(members, _assessed(candidates)), labels)
    return found.select("pattern_id", "top_class", "labelled_member_count", "top_class_member_count", "top_class_total", "labelled_total",
                        r6("member_share"), F.round("p_value", 5).alias("p_value"))


_FINDINGS8 = """findings8 AS (
  SELECT a.file, a.region_no, CASE WHEN pattern_id IS NULL THEN 'LOCALIZED_HIGH_FREQUENCY_ANOMALY' WHEN concentrated THEN 'REPEATED_PATTERN_SPATIAL_CONCENTRATION'
    ELSE 'REPEATED_LOCALIZED_PATTERN' END AS code, CASE WHEN concentrated THEN severity ELSE 'low' END AS severity, pattern_id
  FROM assigned a LEFT JOIN patterns p ON p.leader = a.leader)"""


@query("a8_candidate_findings", _recursive(*_PATTERN_PARTS, _FINDINGS8, "SELECT file, region_no, code, severity, pattern_id FROM findings8"))
def a8_candidate_findings(t: Tables):
    candidates, assigned = _assigned(t)
    ranked = pa.patterns(pa.pattern_members(assigned), _assessed(candidates))
    return pa.candidate_findings(assigned, ranked).select("file", "region_no", "code", "severity", "pattern_id")


@query("a8_image_totals", _recursive(*_PATTERN_PARTS, _FINDINGS8, """
SELECT count(DISTINCT file) AS images_with_localized_anomaly, count(DISTINCT file) FILTER (code = 'REPEATED_PATTERN_SPATIAL_CONCENTRATION') AS candidate_trigger_count,
  (SELECT count(*) FROM regions) AS images_assessed, (SELECT count(*) FROM patterns) AS repeated_pattern_count FROM findings8"""))
def a8_image_totals(t: Tables):
    candidates, assigned = _assigned(t)
    assessed = _assessed(candidates)
    ranked = cut_lineage(pa.patterns(pa.pattern_members(assigned), assessed))
    return pa.image_totals(pa.candidate_findings(assigned, ranked), ranked, assessed)
