"""Joins of the pattern queries whose sides both grow with the input put nothing on the driver."""

import random

from pyspark.sql import functions as F

from assaylake.operators import components, near_duplicates, patterns


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _kept_plans(monkeypatch, module) -> list[str]:
    """The plans of what the module writes from now on."""
    plans, cut = [], module.cut_lineage

    def cut_and_keep(df):
        plans.append(_plan(df))
        return cut(df)

    monkeypatch.setattr(module, "cut_lineage", cut_and_keep)
    return plans


def test_components_are_not_broadcast(spark, monkeypatch):
    plans = _kept_plans(monkeypatch, components)
    edges = spark.range(1, 400).where("id % 40 <> 0").select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    found = {r["node"]: r["component"] for r in components.connected_components(edges, "a", "b").collect()}
    assert found == {i: i // 40 * 40 for i in range(400)}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def _first_fit(descriptors: list[int]) -> dict[int, int]:
    leaders, follows = [], {}
    for d in descriptors:
        follows[d] = next((x for x in leaders if ((x ^ d) & (1 << 64) - 1).bit_count() <= 6), d)
        if follows[d] == d:
            leaders.append(d)
    return follows


def _regions(spark, descriptors: list[int]):
    rows = [(f"{i:04d}", 0, 30.0, 0, 0, 0.5, 0.5, d) for i, d in enumerate(descriptors)]
    return spark.createDataFrame(rows, "file string, region_no int, peak_hf double, y0 int, x0 int, cx double, cy double, descriptor long")


def _descriptors() -> list[int]:
    rng = random.Random(4)
    bases = [rng.getrandbits(63) for _ in range(6)]
    near = [b ^ sum(1 << rng.randrange(63) for _ in range(2)) ^ (1 << rng.randrange(63)) for b in bases for _ in range(25)]
    return list(dict.fromkeys([*near, *(rng.getrandbits(63) for _ in range(40))]))


def test_leaders_are_not_broadcast(spark, monkeypatch):
    descriptors = _descriptors()
    for task_edges in (patterns.TASK_EDGES, 1):
        plans = _kept_plans(monkeypatch, patterns)
        candidates = _regions(spark, descriptors)
        leaders = patterns.first_fit_leaders(candidates, task_edges=task_edges)
        assert {r["descriptor"]: r["leader"] for r in leaders.collect()} == _first_fit(descriptors)
        assert "SortMergeJoin" in _plan(leaders) and "Broadcast" not in _plan(leaders)
        # the only broadcasts left are the few hot keys of a lookup and the starts of numbered partitions
        joins = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line]
        assert not any(f"[{key}#" in line for line in joins for key in ("later", "earlier", "descriptor", "hash_a", "hash_b")), joins


def test_labels_of_files_are_not_broadcast(spark):
    members = spark.createDataFrame([(7, f"{i:03d}", 0.5, 0.5, 30.0) for i in range(6)], "leader long, file string, cx double, cy double, peak_hf double")
    labels = spark.createDataFrame([(f"{i:03d}", "en" if i < 4 else "es") for i in range(20)], "file string, label string")
    ranked = spark.createDataFrame([("P001", 7)], "pattern_id string, leader long")
    found = patterns.class_evidence(*[patterns.cut_lineage(df) for df in (members, ranked, labels)])  # of files Spark knows that they are small
    joins = [line for line in _plan(found).splitlines() if "Join" in line]
    assert any("SortMergeJoin [file#" in line for line in joins) and any("SortMergeJoin [leader#" in line for line in joins)
    row = found.first()
    assert (row["top_class"], row["labelled_member_count"], row["top_class_member_count"], row["top_class_total"], row["labelled_total"]) == ("en", 6, 4, 4, 20)


def test_groups_of_near_duplicates_are_not_broadcast(spark):
    files = spark.range(60).select(F.col("id").cast("string").alias("path"), (F.xxhash64(F.floor(F.col("id") / 2)).bitwiseXOR(F.col("id") % 2)).alias("hash"))
    groups = near_duplicates.near_duplicate_groups(files)
    assert "Broadcast" not in _plan(groups)
    assert [(r["hash_count"], r["file_count"]) for r in groups.collect()] == [(2, 2)] * 30
