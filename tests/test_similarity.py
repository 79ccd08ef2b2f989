import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.config import PatternConfig
from assaylake.functions.statistics import exact_median, hypergeometric_tail
from assaylake.operators import components, hamming, labels, metric_balls, near_duplicates, nearest, patterns


def _signed(v):
    return v - (1 << 64) if v >> 63 else v


def _distance(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


def _hashes(seed=1):
    rng = random.Random(seed)
    found = {0} | {_signed(1 << i) for i in range(40)}
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(6):
            value = base
            for _ in range(rng.randrange(10)):
                value ^= 1 << rng.randrange(64)
            found.add(_signed(value))
    return sorted(found)


@pytest.mark.parametrize("threshold,bucket_rows", [(8, 2000), (8, 12), (6, 2000), (6, 5)])
def test_hamming_pairs_equal_brute_force(spark, threshold, bucket_rows):
    hashes = _hashes()
    expected = {(a, b) for i, a in enumerate(hashes) for b in hashes[i + 1:] if _distance(a, b) <= threshold}
    df = spark.createDataFrame([(h,) for h in hashes], "hash long")
    rows = [(r["hash_a"], r["hash_b"]) for r in hamming.hamming_pairs(df, threshold, bucket_rows=bucket_rows).collect()]
    assert set(rows) == expected and len(rows) == len(expected)


@pytest.mark.parametrize("bucket_rows,join_rows", [(2000, 64), (7, 3), (2000, 1)])
def test_hamming_links_join_what_all_pairs_join(spark, bucket_rows, join_rows):
    hashes = _hashes(5)
    label = {h: h for h in hashes}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(hashes):
        for b in hashes[i + 1:]:
            if _distance(a, b) <= 8:
                low, high = sorted((top(a), top(b)))
                label[high] = low
    links = hamming.hamming_links(spark.createDataFrame([(h,) for h in hashes], "hash long"), 8, bucket_rows=bucket_rows, join_rows=join_rows).collect()
    assert all(_distance(r["hash_a"], r["hash_b"]) <= 8 and r["hash_a"] < r["hash_b"] for r in links)
    found = components.connected_components(spark.createDataFrame([tuple(r) for r in links], "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["component"] for r in found} == {h: top(h) for h in hashes if any(top(o) == top(h) for o in hashes if o != h)}


def test_a_dense_bucket_gives_few_links(spark):
    """20,000 hashes within 12 bits of each other: far fewer links than the 200 million pairs."""
    rng = random.Random(9)
    close = {sum(1 << b for b in rng.sample(range(40), 6)) for _ in range(20_000)}
    files = spark.createDataFrame([(f"f{i}", h) for i, h in enumerate(sorted(close))] + [("lone", -1), ("copy", -1), ("none", None)], "path string, hash long")
    links = hamming.hamming_links(files, 8)
    assert links.count() < 40 * len(close) * 9
    groups = {r["group_hash"]: (r["hash_count"], r["file_count"]) for r in near_duplicates.near_duplicate_groups(files).collect()}
    assert groups == {min(close): (len(close), len(close)), -1: (1, 2)}


def test_near_duplicate_pairs_stand_for_all_file_pairs(spark):
    files = [("a", 0), ("b", 0), ("c", 1), ("d", None), ("e", -1)]
    df = spark.createDataFrame(files, "path string, hash long")
    pairs = near_duplicates.near_duplicate_pairs(df)
    report = near_duplicates.near_duplicate_report(df, pairs).first()
    assert (report["images_hashed"], report["images_skipped"], report["near_duplicate_pair_count"]) == (4, 1, 3)


@pytest.mark.parametrize("task_edges", [1_000_000, 3])
def test_first_fit_equals_sequential_loop(spark, task_edges):
    rng, hashes = random.Random(3), _hashes(3)
    rows = [(f"f{rng.randrange(60):02d}", i, float(rng.randrange(20, 60)), rng.randrange(10), rng.randrange(10), 0.5, 0.5,
             rng.choice(hashes) if rng.random() < 0.9 else None) for i in range(150)]
    leaders, expected = [], {}
    for r in sorted(rows, key=lambda r: (r[0], -r[2], r[3], r[4], r[1])):
        if r[7] is not None:
            hit = next((x for x in leaders if _distance(x, r[7]) <= 6), None)
            if hit is None:
                leaders.append(r[7])
            expected[(r[0], r[1])] = r[7] if hit is None else hit
    df = spark.createDataFrame(rows, "file string, region_no int, peak_hf double, y0 int, x0 int, cx double, cy double, descriptor long")
    assigned = patterns.assign_leaders(df, patterns.first_fit_leaders(df, PatternConfig(), task_edges=task_edges))
    assert {(r["file"], r["region_no"]): r["leader"] for r in assigned.collect() if r["leader"] is not None} == expected


def test_nearest_reference_equals_full_matrix(spark):
    x = np.random.default_rng(0).normal(size=(120, 6))
    to_rows = lambda lo, hi: [(i, [float(v) for v in x[i]]) for i in range(lo, hi)]
    reference = spark.createDataFrame(to_rows(0, 50), "ref_index long, features array<double>")
    candidates = spark.createDataFrame(to_rows(50, 120), "id long, features array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    full = 1 - unit @ unit.T
    for block in (7, 10_000):
        got = nearest.assess_candidates(candidates, reference, block_rows=block).toPandas().sort_values("id")
        assert np.allclose(full[50:, :50].min(axis=1), got["distance"])
        assert (full[50:, :50].argmin(axis=1) == got["nearest_reference_index"]).all()
        own = full[:50, :50] + np.eye(50) * 9
        assert np.isclose(got["threshold"].iloc[0], np.float32(own.min(axis=1).max()))
    with pytest.raises(ValueError):
        nearest.fit_reference(reference.limit(1))


def test_zero_vector_has_distance_one(spark):
    reference = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "ref_index long, features array<double>")
    zero = spark.createDataFrame([(5, [0.0, 0.0])], "id long, features array<double>")
    row = nearest.nearest_reference(zero, reference).first()
    assert (row["distance"], row["ref_index"]) == (1.0, 0)


def test_hypergeometric_tail_matches_exact_sum_beyond_the_exact_range():
    from math import comb
    for k, n, marked, population in ((30, 60, 200, 6000), (2, 60, 200, 6000), (0, 10, 5, 6000), (200, 400, 3000, 9000)):
        exact = sum(comb(marked, i) * comb(population - marked, n - i) for i in range(k, min(n, marked) + 1)) / comb(population, n)
        assert hypergeometric_tail(k, n, marked, population) == pytest.approx(exact, rel=1e-7, abs=1e-12)


def test_exact_median_narrows_to_the_value(spark):
    for values in ([5.0], [1.0, 9.0], [7.0] * 60 + [float(i) for i in range(41)], [float(i * i) for i in range(301)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        assert exact_median(df, "v", buckets=8, small=3) == float(np.median(values))
    assert exact_median(spark.createDataFrame([], "v double"), "v") is None


def test_label_rules(spark):
    texts = [("ok", "1 0.5 0.5 0.2 0.2\n\n0 0.1 0.1 0.1 0.1"), ("short", "1 2 3"), ("words", "a 0.5 0.5 0.2 0.2"),
             ("range", "-1 0.5 1.5 0 0.2"), ("blank", " \n "), ("none", None), ("edge", "0 0 1 1 1")]
    parsed = {r["image"]: r for r in labels.parse_labels(spark.createDataFrame(texts, "image string, text string"), 2).collect()}
    assert parsed["ok"]["valid"] and parsed["ok"]["class_set"] == [0, 1]
    assert parsed["short"]["errors"] == ["Line 1: expected 5 values, found 3."] and parsed["short"]["annotations"] == []
    assert parsed["words"]["errors"] == ["Line 1: non-numeric annotation values."]
    assert parsed["range"]["errors"] == ["Line 1: negative class ID -1.", "Line 1: y_center=1.5 is outside [0, 1].",
                                         "Line 1: width must be greater than zero."]
    assert len(parsed["range"]["annotations"]) == 1
    assert parsed["blank"]["empty"] and parsed["blank"]["valid"]
    assert not parsed["none"]["exists"] and not parsed["none"]["valid"]
    assert parsed["edge"]["valid"]


def test_conflicts_count_copies_once_per_profile_pair(spark):
    rows = [(f"a{i}", 0, [0], [1.0, 2.0]) for i in range(4)] + [(f"b{i}", 0, [1], [1.0, 2.0]) for i in range(3)] + [("c", -1, [1], [1.0, 2.0])]
    df = spark.createDataFrame(rows, "image string, hash long, class_set array<int>, features array<double>")
    found = labels.conflicting_profiles(labels.label_profiles(df)).agg(F.sum("conflict_pairs")).first()[0]
    assert found == 12


@pytest.mark.parametrize("similarity", [0.9, 0.5, 0.0])
def test_conflicts_equal_all_pairs(spark, similarity):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 3))
    rows = []
    for i in range(140):
        features = [0.0] * 3 if i % 35 == 0 else [float(v) for v in centres[rng.integers(6)] + rng.normal(size=3) * 0.3]
        rows.append((f"i{i:03d}", [0, 3, 1 << 40][int(rng.integers(3))], [int(rng.integers(2))], features))
    df = spark.createDataFrame(rows, "image string, hash long, class_set array<int>, features array<double>")

    def alike(a, b):
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return min(1.0, max(0.0, float(np.dot(a, b)) / size)) if size else 0.0

    want = {tuple(sorted((a[0], b[0]))) for i, a in enumerate(rows) for b in rows[i + 1:] if _distance(a[1], b[1]) <= 8 and a[2] != b[2] and alike(a[3], b[3]) >= similarity}
    found = labels.conflicting_profiles(labels.label_profiles(df), similarity=similarity).collect()
    named = [tuple(sorted((r["image_a"], r["image_b"]))) for r in found]
    assert len(named) == len(set(named)) and set(named) <= want and sum(r["conflict_pairs"] for r in found) == len(want) > 0  # equal zero vectors are one profile


def test_first_fit_on_a_long_path_takes_few_jobs(spark, monkeypatch):
    """Each descriptor is close to the next one only: 10,000 of them, every second leads."""
    path = spark.range(10_000).select(F.format_string("f%05d", "id").alias("file"), F.col("id").alias("descriptor"))
    pairs = spark.range(9_999).select(F.col("id").alias("hash_a"), (F.col("id") + 1).alias("hash_b"))
    monkeypatch.setattr(patterns, "hamming_pairs", lambda *a, **k: pairs)
    rows = path.selectExpr("file", "0 as region_no", "1.0 as peak_hf", "0 as y0", "0 as x0", "descriptor")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    found = {r["descriptor"]: r["leader"] for r in patterns.first_fit_leaders(rows).collect()}
    jobs = len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(before))
    assert found == {i: i - i % 2 for i in range(10_000)} and jobs < 400


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(300)]
    label = {}

    def top(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((top(a), top(b)))
            label[high] = low
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {x: top(x) for x in list(label)}


@pytest.mark.parametrize("dims,ball_rows,block_rows", [(3, 20, 15), (6, 7, 10_000), (2, 50, 8)])
def test_ball_search_equals_full_search(spark, dims, ball_rows, block_rows):
    """Clusters, copies, opposite and equal directions; every row's nearest other one and every candidate's."""
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(9, dims))
    x = np.concatenate([centres[rng.integers(9, size=700)] + rng.normal(size=(700, dims)) * 0.05, -centres, np.repeat(centres[:2], 200, 0), 3 * centres[:3]])
    v = x / np.linalg.norm(x, axis=1)[:, None]
    points = spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(v[:900])], "point long, v array<double>")
    queries = spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(v[900:])], "id long, v array<double>")
    balls = metric_balls.build_balls(points, ball_rows=ball_rows, block_rows=block_rows)
    full = metric_balls.cosine_distances(v[900:], v[:900])
    for r in metric_balls.nearest(queries, balls, block_rows=block_rows).collect():
        assert (r["distance"], r["point"]) == (full[r["id"]].min(), full[r["id"]].argmin()) and 0 < r["compared"] <= 900
    own = metric_balls.cosine_distances(v[:900], v[:900])
    np.fill_diagonal(own, np.inf)
    found = metric_balls.nearest(points.withColumnRenamed("point", "id"), balls, own=True, block_rows=block_rows).collect()
    assert len(found) == 900 and all((r["distance"], r["point"]) == (own[r["id"]].min(), own[r["id"]].argmin()) for r in found)
    assert sum(r["compared"] for r in found) < 0.6 * 900 * 900


def test_nearest_with_zero_vectors_copies_and_an_empty_reference(spark):
    schema = "id long, features array<double>"
    reference = spark.createDataFrame([(4, [0.0, 0.0]), (7, [1.0, 0.0]), (9, [1.0, 0.0]), (2, [0.0, 1.0])], "ref_index long, features array<double>")
    candidates = spark.createDataFrame([(1, [-1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0])], schema)
    found = {r["id"]: (r["distance"], r["ref_index"]) for r in nearest.nearest_reference(candidates, reference).collect()}
    assert found == {1: (1.0, 2), 2: (0.0, 7), 3: (1.0, 2)}
    assert nearest.fit_reference(reference).first().asDict() == {"reference_count": 4, "threshold": 1.0}
    assert nearest.nearest_reference(candidates, reference.limit(0)).count() == 0
    totals = nearest.assessment_totals(nearest.assess_candidates(candidates.limit(0), reference)).first()
    assert (totals["candidate_count"], totals["potential_ood_count"]) == (0, 0)
    zeros = nearest.nearest_reference(candidates, reference.where("ref_index = 4")).collect()
    assert {(r["id"], r["distance"], r["ref_index"]) for r in zeros} == {(1, 1.0, 4), (2, 1.0, 4), (3, 1.0, 4)}
