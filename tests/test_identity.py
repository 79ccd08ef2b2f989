import hashlib
import json
import random

from pyspark.sql import functions as F

from assaylake.operators import keyed, manifest, ordering


def _merkle(leaves):
    nodes = sorted(leaves)
    while len(nodes) > 1:
        nodes += nodes[-1:] * (len(nodes) % 2)
        nodes = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(nodes[::2], nodes[1::2])]
    return nodes[0] if nodes else hashlib.sha256(b"").hexdigest()


def _hashes(n, distinct):
    rng = random.Random(n)
    return [hashlib.sha256(str(rng.randrange(distinct)).encode()).hexdigest() for _ in range(n)]


def test_merkle_root_equals_pairwise_reduction(spark):
    for n, distinct, levels in ((0, 1, 2), (1, 1, 2), (5, 5, 1), (33, 1, 2), (67, 20, 3), (100, 100, 2)):
        leaves = _hashes(n, distinct)
        df = spark.createDataFrame([(h,) for h in leaves], "sha256 string")
        assert manifest.merkle_root(df, block_levels=levels).first()["merkle_root"] == _merkle(leaves)


def _tree(items, fan_out):
    """Three levels of hashed JSON lists."""
    def level(rows):
        return [f'"{hashlib.sha256(("[" + ",".join(rows[i:i + fan_out]) + "]").encode()).hexdigest()}"' for i in range(0, len(rows), fan_out)]
    return hashlib.sha256(("[" + ",".join(level(level(items))) + "]").encode()).hexdigest()


def test_dataset_digest_is_over_canonical_rows_in_path_part_order(spark):
    rows = [("a-b", "x", 1), ("a/b", "y", 2), ("a", "z\"é", 3)]
    df = spark.createDataFrame(rows, "path string, sha256 string, size_bytes long")
    ordered = sorted(rows, key=lambda r: r[0].split("/"))
    text = [json.dumps(dict(zip(("path", "sha256", "size_bytes"), r)), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for r in ordered]
    for fan_out in (2, 4_096):
        assert manifest.dataset_digest(df, fan_out=fan_out).first()["dataset_sha256"] == _tree(text, fan_out)


def test_digest_is_one_scheme_across_segment_edges_and_partitions(spark):
    for n in (0, 1, 6, 7, 8, 48, 49, 50, 500):
        df = spark.range(n).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v"))
        for d in (df, df.repartition(5)):
            got = ordering.ordered_digest(d, [F.col("k")], F.col("v"), fan_out=7).first()
            assert (got["item_count"], got["digest"]) == (n, _tree([str(i) for i in range(n)], 7))


def test_tensor_digest_tells_dtype_and_shape_of_late_chunks(spark):
    from assaylake.operators.tensor_stats import tensor_digests
    chunks = spark.createDataFrame([("m", "a", 5_000_000, [1.0, 2.0]), ("m", "b", 5_000_000, [1.0, 2.0])], "model_id string, tensor_name string, chunk_no long, values array<double>")
    headers = spark.createDataFrame([("m", "a", "float64", [2]), ("m", "b", "float64", [1, 2])], "model_id string, tensor_name string, dtype string, shape array<int>")
    assert len({r["digest_sha256"] for r in tensor_digests(chunks, headers).collect()}) == 2


def test_tensor_digest_keeps_every_bit(spark):
    from assaylake.operators.tensor_stats import tensor_digests
    values = [0.0, -0.0, 1e-14, 1.0000001e-14, 5e-324, 1e-323, 1e300, 1.0, 1.0 + 2**-52, float("inf"), float("-inf"), float("nan")]
    chunks = spark.createDataFrame([("m", str(i), 0, [v, 1.0]) for i, v in enumerate(values)], "model_id string, tensor_name string, chunk_no long, values array<double>")
    headers = chunks.selectExpr("model_id", "tensor_name", "'float64' AS dtype", "array(2) AS shape")
    assert len({r["digest_sha256"] for r in tensor_digests(chunks, headers).collect()}) == len(values)


def test_positions_are_equal_with_and_without_window(spark):
    df = spark.range(300).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.hash("id").alias("o"), "id")
    a = ordering.position_in_group(df, ["k"], [F.col("o"), F.col("id")])
    b = ordering.position_in_group(df, ["k"], [F.col("o"), F.col("id")], window_rows=20)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_duplicates_and_hot_group(spark):
    rows = [(f"f{i}", "hot" if i < 40 else f"h{i // 2}") for i in range(60)]
    df = spark.createDataFrame(rows, "path string, sha256 string")
    plain = sorted(map(tuple, manifest.duplicate_members(df).collect()))
    assert plain == sorted(map(tuple, manifest.duplicate_members(df, hot_rows=5).collect()))
    assert len(plain) == 60
    totals = manifest.duplicate_totals(df).first()
    assert (totals["duplicate_group_count"], totals["duplicate_file_count"]) == (11, 60)


def test_lookup_keeps_rows_without_statistics(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, k string")
    stats = spark.createDataFrame([("a", 5, "x")], "k string, n int, v string")
    got = {r["id"]: r["v"] for r in keyed.lookup_by_key(rows, stats, ["k"], size="n", hot_rows=1).collect()}
    assert got == {1: "x", 2: None}
