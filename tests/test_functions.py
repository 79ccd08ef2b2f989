"""Small functions and operators against values worked out by hand."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from assaylake.functions import hashing, numeric, text
from assaylake.operators import chain, findings, fingerprint, labels, manifest, report, tensor_stats
from assaylake.sources import stores, tables


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_vectors(spark):
    assert one(spark, numeric.cosine_distance(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[0.0, 2.0]) == 1.0
    assert one(spark, numeric.cosine_distance(F.col("a"), F.col("b")), a=[3.0, 4.0], b=[6.0, 8.0]) == pytest.approx(0.0)
    assert one(spark, numeric.cosine_distance(F.col("a"), F.col("b")), a=[0.0], b=[1.0]) == 1.0
    assert one(spark, numeric.total_variation(F.col("a"), F.col("b")), a=[0.5, 0.5], b=[1.0, 0.0]) == 0.5
    assert [one(spark, numeric.half_even(F.lit(v).cast("decimal(4,1)"), 0)) for v in (0.5, 1.5, 2.5)] == [0, 2, 2]


def test_text(spark):
    assert one(spark, text.iso_time(F.lit(1704164645))) == "2024-01-02T03:04:05+00:00"
    assert [one(spark, text.file_stem(F.lit(p))) for p in ("a/b.tar.gz", "a/.hidden", "x")] == ["b.tar", ".hidden", "x"]
    digest = "0123456789abcdef" * 4
    assert one(spark, hashing.short_digest(F.lit(digest))) == digest[:17] + "…" + digest[-10:]
    assert one(spark, hashing.short_digest(F.lit("short"))) == "short" and one(spark, hashing.short_digest(F.lit(None))) == ""
    assert [one(spark, tables.blank_as_unknown(F.lit(v))) for v in (" ", None, " a ")] == ["UNKNOWN", "UNKNOWN", "a"]


def test_manifest_of_files(spark):
    files = spark.createDataFrame([("file:/r/root/a/x.bin", bytearray(b"abc")), ("file:/r/root/y", bytearray(b""))], "path string, content binary")
    got = {tuple(r) for r in manifest.manifest_from_files(files, "root").collect()}
    assert got == {("a/x.bin", hashlib.sha256(b"abc").hexdigest(), 3), ("y", hashlib.sha256(b"").hexdigest(), 0)}


def test_labels_and_predictions(spark):
    images = spark.createDataFrame([("a/x.png",), ("b/x.jpg",), ("y.png",)], "image string")
    assert [tuple(r) for r in labels.ambiguous_stems(images, text.file_stem(F.col("image"))).collect()] == [("x", 2)]
    rows = spark.createDataFrame([("m", "clean", 0, 1, [0.1, 0.9])], "model_id string, probe string, image_idx int, predicted_class int, probs array<double>")
    assert fingerprint.label_only(rows).first()["probs"] is None


def test_tensor_headers_and_module_types(spark):
    headers = spark.createDataFrame([("m", "a"), ("m", "empty")], "model_id string, tensor_name string")
    chunks = spark.createDataFrame([("m", "a", 0, [1.0, 2.0, float("nan")])], "model_id string, tensor_name string, chunk_no long, values array<double>")
    got = {r["tensor_name"]: r for r in tensor_stats.with_headers(headers, tensor_stats.tensor_statistics(chunks)).collect()}
    assert (got["a"]["finite_count"], got["a"]["mean"], got["empty"]["element_count"], got["empty"]["mean"]) == (2, 1.5, 0, None)
    kinds = lambda *rows: spark.createDataFrame(list(rows), "module_type string, n long")
    changed = tensor_stats.module_type_changes(kinds(("Conv", 2), ("Norm", 1)), kinds(("Conv", 3), ("Norm", 1), ("Drop", 1)))
    assert {tuple(r) for r in changed.collect()} == {("Conv", 2, 3), ("Drop", 0, 1)}
    p = tensor_stats.exact_percentiles(chunks, (0, 50, 75, 100)).first()
    assert (p["p0"], p["p50"], p["p75"], p["p100"]) == (1.0, 1.5, 1.75, 2.0)


def test_findings_report_and_export(spark, tmp_path):
    rows = spark.createDataFrame([("C3-1", "high", "One", "x"), ("C3-2", "low", "Two", "y")], "finding_id string, severity string, title string, affected_asset string")
    assert {(r["finding_count"], r["overall_severity"]) for r in findings.with_totals(rows).collect()} == {(2, "high")}
    whole = spark.createDataFrame([("A", "d", "{}", "[]", "[]", "[]")],
                                  "assessment_id string, report_digest string, executive_summary string, asset_coverage string, recommended_actions string, limitations string")
    stores.export_lines(report.text_report(whole, rows), str(tmp_path / "out"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 8 and "[HIGH] C3-1 One — x" in lines and "Report digest: d" in lines


def test_records_in_results_and_assets(spark):
    body = {f: "v" for f in chain.PROVENANCE.fields} | {"sequence": 1, "record_hash": "h", "previous_record_hash": "p"}
    payload = json.dumps({"records": [body, body | {"sequence": 2}]})
    got = tables.records_from_arrays(spark.createDataFrame([("A", payload)], "assessment_id string, payload string"), chain.PROVENANCE, "records").collect()
    assert [(r["chain_id"], r["pos"], r["sequence"]) for r in got] == [("A", 0, 1), ("A", 1, 2)]
    assets = spark.createDataFrame([("a", "t1"), ("b", "t2"), ("c", "t2")], "asset_id string, registered_at string")
    assert [r["asset_id"] for r in stores.list_assets(assets).collect()] == ["b", "c", "a"]


def test_lookup_spreads_null_and_unknown_keys(spark):
    from assaylake.operators.keyed import lookup_by_key
    rows = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, F.lit("unknown")).when(F.col("id") % 5 == 0, F.lit("k")).alias("key"))
    stats = spark.createDataFrame([("k", 100, "v")], "key string, n long, value string")
    found = lookup_by_key(rows, stats, ["key"], size="n", spread=[F.col("id")])
    assert found.where("value = 'v'").count() == rows.where("key = 'k'").count() and found.count() == 1000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["n"] for r in lookup_by_key(rows, stats, ["key"], size="n", spread=[F.col("id")]).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(sizes) < 700
