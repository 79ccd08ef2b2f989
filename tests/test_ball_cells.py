"""The nearest-neighbour search over balls of many members: what a query meets does not grow with a ball."""

import numpy as np
from pyspark.sql import functions as F

from assaylake.operators import metric_balls


def _on_arcs(rng, n):
    """Unit vectors on the twenty arcs that a free, a four-valued and a five-valued feature make."""
    x = np.stack([rng.uniform(0, 1, n) - 0.3, rng.integers(1, 5, n) / 4 - 0.45, rng.integers(1, 6, n) / 5 - 0.5], 1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _frame(spark, v, name):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], f"{name} long, v array<double>").repartition(4).cache()


def test_a_query_meets_cells_of_one_ring(spark, monkeypatch):
    monkeypatch.setattr(metric_balls, "MAX_PIVOTS", 4)
    visited = []
    whole = metric_balls._visits
    monkeypatch.setattr(metric_balls, "_visits", lambda *a: visited.append(whole(*a)) or visited[-1])
    rng = np.random.default_rng(11)
    v = _on_arcs(rng, 8_000)
    v[4_000:4_040] = v[:40]  # one direction twice: the lower point wins
    q = np.concatenate([_on_arcs(rng, 360), v[3_980:4_020]])
    balls = metric_balls.build_balls(_frame(spark, v, "point"))
    found = metric_balls.nearest(_frame(spark, q, "id"), balls).collect()
    full = metric_balls.cosine_distances(q, v)
    assert len(balls.ball) == 4 and len(found) == 400
    for r in found:
        assert abs(r["distance"] - full[r["id"]].min()) < 2e-12 and full[r["id"], r["point"]] < full[r["id"]].min() + 2e-12
    assert {r["point"] for r in found if r["id"] >= 380} == set(range(20))
    assert sum(r["compared"] for r in found) < 400 * 1_000
    assert sum(df.select(F.count(F.lit(1))).first()[0] for df in visited) < 1.2 * 400


def test_cells_of_clusters_and_copies_lose_no_tie(spark):
    """Clusters narrower than the slack, copies, rings of several cells and blocks; every row's nearest other one."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(5, 4))
    x = np.concatenate([centres[rng.integers(5, size=2_400)] + rng.normal(size=(2_400, 4)) * rng.choice([1e-8, 1e-4, 0.3], size=(2_400, 1)), np.repeat(centres, 30, 0)])
    v = x / np.linalg.norm(x, axis=1)[:, None]
    points = _frame(spark, v, "point")
    own = metric_balls.cosine_distances(v, v)
    np.fill_diagonal(own, np.inf)
    for ball_rows, block_rows in ((1_300, 16_384), (900, 600)):
        balls = metric_balls.build_balls(points, ball_rows=ball_rows, block_rows=block_rows)
        found = metric_balls.nearest(points.withColumnRenamed("point", "id"), balls, own=True, block_rows=block_rows).collect()
        assert len(found) == len(v)
        for r in found:
            assert abs(r["distance"] - own[r["id"]].min()) < 2e-12 and own[r["id"], r["point"]] < own[r["id"]].min() + 2e-12
            assert r["point"] != r["id"] and 0 < r["compared"] < len(v)
