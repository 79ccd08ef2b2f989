"""Probe registry, grouped order statistics and the search index against plain Python."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.operators import order_statistics as ranks
from assaylake.operators import probes, search_index


def test_battery_equals_numpy(spark):
    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(size=7) for i in range(20)}
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()] + [(99, None)], "id long, v array<float>")
    found = {(r["probe"], r["id"]): r["v"] for r in probes.probe_inputs(rows, probes.battery(spark), row_id="id", vector="v").collect()}
    assert len(found) == 21 * 10 and all(found[p, 99] is None for p, i in found if i == 99)
    blur = lambda v: [np.mean(v[max(0, i - 1):i + 2]) for i in range(len(v))]
    want = {"clean": lambda v: v, "flip": lambda v: v[::-1], "scale_down": lambda v: v * 0.7, "scale_up": lambda v: v * 1.3, "offset": lambda v: v + 0.1,
            "contrast_down": lambda v: v.mean() + (v - v.mean()) * 0.6, "contrast_up": lambda v: v.mean() + (v - v.mean()) * 1.5,
            "blur": blur, "shift": lambda v: np.roll(v, 2)}
    for name, fn in want.items():
        assert all(np.allclose(found[name, i], fn(np.float32(v).astype(float))) for i, v in vectors.items()), name


def test_noise_is_normal_and_repeats(spark):
    rows = spark.range(400).select("id", F.array_repeat(F.lit(0.0), 50).alias("v"))
    spec = spark.createDataFrame([("a", "noise", {"sigma": 2.0, "seed": 5.0}), ("b", "noise", {"sigma": 2.0, "seed": 6.0})], probes.SPEC)
    one, two = ({(r["probe"], r["id"]): r["v"] for r in probes.probe_inputs(rows.repartition(n), spec, row_id="id", vector="v").collect()} for n in (1, 5))
    assert one == two and one["a", 3] != one["b", 3] != one["b", 4]
    values = np.concatenate([v for (p, _), v in one.items() if p == "a"])
    assert abs(values.mean()) < 0.06 and abs(values.std() - 2) < 0.06


@pytest.mark.parametrize("rows", [[("a", "vignette", {})], [("a", "scale", {"sigma": 1.0})], [("a", "identity", {}), ("a", "flip", {})], [("", "flip", {})],
                                  [("a", "scale", {"factor": float("nan")})], []])
def test_wrong_specifications(spark, rows):
    with pytest.raises(ValueError):
        probes.checked_spec(spark.createDataFrame(rows, probes.SPEC))


def test_own_transform(spark, monkeypatch):
    monkeypatch.setattr(probes, "REGISTRY", dict(probes.REGISTRY))
    probes.transform("power", exponent=2.0)(lambda x, row_id, exponent: F.transform(x, lambda v: F.pow(v, exponent)))
    with pytest.raises(ValueError):
        probes.transform("power")(probes.identity)
    spec = spark.createDataFrame([("cube", "power", {"exponent": 3.0})], probes.SPEC)
    rows = spark.createDataFrame([(1, [2.0, 3.0])], "id long, v array<double>")
    assert probes.probe_inputs(rows, spec, row_id="id", vector="v").first()["v"] == [8.0, 27.0]


@pytest.mark.parametrize("rounds,bins", [(2, 1024), (1, 4), (3, 3), (0, 8)])
def test_medians_and_scores(spark, rounds, bins):
    rng = random.Random(bins)
    groups = {"hot": [rng.choice([1.0, 2.0, 2.5, 1e9]) for _ in range(900)], "one": [4.0], "two": [1.0, 2.0], "same": [3.0] * 8,
              "wide": [1.7e308, -1.7e308, 0.0], "mixed": [rng.gauss(0, 1) for _ in range(301)], "skew": [10.0 ** rng.uniform(-12, 12) for _ in range(200)]}
    rows = spark.createDataFrame([(g, v) for g, own in groups.items() for v in own] + [("one", None), ("two", float("nan")), ("none", None)], "g string, v double")
    found = {r["g"]: (r["count"], r["median"]) for r in ranks.grouped_medians(rows, ["g"], "v", rounds=rounds, bins=bins).collect()}
    assert set(found) == set(groups)
    assert all(found[g] == (len(own), pytest.approx(statistics.median(own), rel=1e-12)) for g, own in groups.items())
    scores = ranks.robust_scores(rows.where("g in ('mixed', 'same')"), ["g"], "v", rounds=rounds, bins=bins).collect()
    middle = statistics.median(groups["mixed"])
    mad = statistics.median(abs(v - middle) for v in groups["mixed"])
    assert all(r["robust_z"] == pytest.approx(0.6745 * (r["v"] - middle) / mad) for r in scores if r["g"] == "mixed")
    assert all(r["mad"] == 0 and r["robust_z"] is None for r in scores if r["g"] == "same")


def test_search_index_equals_full_scan(spark):
    rng = random.Random(4)
    labels = ["".join(rng.choice("abÄc 1/.") for _ in range(rng.randint(0, 30))) for _ in range(400)] + ["Common part"] * 300 + ["common rare-x part", None]
    rows = spark.createDataFrame([("K", str(i), t) for i, t in enumerate(labels)], "kind string, key string, label string")
    index = search_index.build_index(rows)
    for needle in ("ab", "ÄC", "abc", "common part", "RARE-X", "common rare-x", "zzz", "", "a 1/"):
        want = sorted(i for i, t in enumerate(labels) if t is not None and needle.lower() in t.lower())
        assert sorted(int(r["key"]) for r in search_index.search(index, needle).collect()) == want, needle
    cost = search_index.search_cost(index, "common rare-x").first()
    assert (cost["labels"], cost["checked"], cost["hits"]) == (len(labels) - 1, 1, 1)


def test_search_index_holds_a_repeated_label_once(spark):
    rows = spark.range(500).select(F.lit("A").alias("kind"), F.col("id").cast("string").alias("key"),
                                   F.when(F.col("id") % 5 < 4, "open urgent").otherwise(F.concat(F.lit("src1/"), F.col("id") % 50)).alias("label"))
    index = search_index.build_index(rows)
    assert index.texts.count() == 11 and index.postings.count() < 11 * 12
    for needle, part in (("URGENT", "urgent"), ("src1/4", "src1/4"), ("1/", "1/")):
        want = sorted(tuple(r) for r in rows.where(F.contains("label", F.lit(part))).collect())
        assert sorted(tuple(r) for r in search_index.search(index, needle).collect()) == want
    assert tuple(search_index.search_cost(index, "Urgent").first()) == ("Urgent", 500, 1, 400)
