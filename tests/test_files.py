import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.operators import metadata, model_identity
from assaylake.plans.runner import Stage, run_stages
from assaylake.sources import files, stores, tables


def png(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def scene(seed: int, patch: bool) -> np.ndarray:
    ramp = np.linspace(40, 120, 128)
    base = np.repeat((ramp[:, None] + np.roll(ramp, seed * 5)[None, :])[:, :, None] / 2, 3, axis=2)
    if patch:
        board = (np.add.outer(np.arange(16) // 2, np.arange(16) // 2) % 2) * 255
        base[104:120, 104:120] = board[:, :, None]
    return base.astype(np.uint8)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    for i in range(5):
        (root / "a").mkdir(exist_ok=True)
        (root / "a" / f"p{i}.png").write_bytes(png(scene(i, True)))
        (root / f"q{i}.png").write_bytes(png(scene(i, False)))
    (root / "copy.png").write_bytes(png(scene(0, False)))
    (root / "broken.jpg").write_bytes(b"no image")
    (root / "small.png").write_bytes(png(np.zeros((20, 20, 3))))
    (root / "note.txt").write_text("0 0.5 0.5 0.5 0.5")
    return str(root)


def test_files_and_images(spark, folder):
    assert files.hash_files(spark, folder).count() == 14
    digests = lambda limit: sorted(tuple(r) for r in files.hash_files(spark, folder, row_bytes=limit).collect())
    assert digests(files.ROW_BYTES) == digests(0) == digests(200) and all(r[1] for r in digests(0))
    assert files.discover_images(spark, folder).count() == 13
    good, skipped = files.read_images(spark, folder)
    assert good.count() == 12 and [r["path"] for r in skipped.collect()] == ["broken.jpg"]
    labels = files.attach_label_texts(good.select(F.col("path").alias("image")), files.read_label_texts(spark, folder))
    assert labels.where("text is not null").count() == 0


def test_model_signatures(spark):
    rows = [("m.pt", b"PK\x03\x04rest"), ("m.pkl", b"\x80\x04x"), ("m.safetensors", struct.pack("<Q", 2) + b"{}"), ("m", b"\x80\x01"), ("n.bin", b"\x80\x02" + bytes(6) + b"{" + bytes(700))]
    got = {r["path"]: r for r in model_identity.model_identity(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert [got[p]["content_signature"] for p, _ in rows] == ["zip_container", "pickle_stream", "safetensors_like_header", None, "safetensors_like_header"]
    assert got["m"]["format"] == "unknown" and got["n.bin"]["format_confidence"] == "extension_inferred_low"


def test_contributor_manifest(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("file,contributor,class,timestamp\n a ,, ,t\n,B,x,\nb,B,x,\n")
    rows = [tuple(r) for r in tables.read_contributor_manifest(spark, str(path)).collect()]
    assert rows == [("a", "UNKNOWN", "UNKNOWN", "t"), ("b", "B", "x", "")]
    path.write_text("file,class\na,b\n")
    with pytest.raises(ValueError):
        tables.read_contributor_manifest(spark, str(path))


def test_metadata_divergence_of_one_odd_contributor(spark):
    rows = [("alice", "64x64")] * 8 + [("carol", "64x64")] * 8 + [("bob", "128x96")] * 4 + [("dan", "1x1")] * 2
    df = spark.createDataFrame(rows, "contributor string, resolution string")
    got = {r["contributor"]: (round(r["tv_distance"], 6), r["code"]) for r in metadata.contributor_divergence(metadata.value_counts(df, ["resolution"])).collect()}
    assert got["bob"] == (1.0, "high_metadata_divergence") and "dan" not in got
    assert got["alice"] == (round(0.5 * (6 / 14 + 4 / 14 + 2 / 14), 6), None)


def test_stores(spark, tmp_path):
    payloads = spark.createDataFrame([("{}",), ("{}",), ('{"a":1}',)], "payload string")
    root = str(tmp_path / "evidence")
    stores.append_evidence(spark, payloads, root)
    stores.append_evidence(spark, payloads, root)
    assert spark.read.parquet(root).count() == 2
    asset = spark.createDataFrame([("/x/a", "file", "s", 1, "t1"), ("/x/a", "file", "s", 1, "t2")], "local_path string, kind string, sha256 string, size_bytes long, registered_at string")
    assets = str(tmp_path / "assets")
    stores.register_assets(spark, asset, assets)
    assert [r["registered_at"] for r in stores.register_assets(spark, asset, assets).collect()] == ["t1"]
    versions = spark.createDataFrame([("A", "n", "draft", "c1", "u1", "{}"), ("A", "n", "done", "c2", "u2", "{}")],
                                     "assessment_id string, name string, status string, created_at string, updated_at string, payload string")
    stores.save_assessments(versions, str(tmp_path / "runs"))
    row = stores.list_assessments(spark.read.parquet(str(tmp_path / "runs"))).first()
    assert (row["status"], row["created_at"]) == ("done", "c1")
    results = tmp_path / "results" / "A"
    results.mkdir(parents=True)
    (results / "A2_x.json").write_text('{"status":"completed"}')
    (results / "A3_x.json").write_text("{broken")
    got = {r["engine"]: r["storage_status"] for r in tables.read_engine_results(spark, str(tmp_path / "results")).collect()}
    assert got == {"A2_x": "result_file", "A3_x": "stored result could not be interpreted"}


def test_stages_gate_on_their_inputs(spark, tmp_path):
    def broken(paths):
        raise ValueError("no input")
    stages = [Stage("A1", lambda p: spark.range(3)), Stage("A2", lambda p: spark.read.parquet(p["A1"]), ("A1",)), Stage("B1", broken),
              Stage("B2", lambda p: spark.range(1), ("B1",)), Stage("C2", lambda p: spark.range(1), enabled=False)]
    got = {r["engine"]: r["status"] for r in run_stages(spark, "run", stages, str(tmp_path)).collect()}
    assert got == {"A1": "completed", "A2": "completed", "B1": "error", "B2": "unavailable", "C2": "not_assessed"}
    assert spark.read.parquet(str(tmp_path / "run" / "A2")).count() == 3
