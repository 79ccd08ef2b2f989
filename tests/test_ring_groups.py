"""The last round of the nearest-neighbour search: a query is copied for groups of rings, not for rings."""

import numpy as np
from pyspark.sql import functions as F

from assaylake.operators import metric_balls


def test_vectors_without_structure_are_copied_for_groups_of_rings(spark, monkeypatch):
    monkeypatch.setattr(metric_balls, "LEAST_GROUP", 128)
    copied = []
    whole = metric_balls._visits
    monkeypatch.setattr(metric_balls, "_visits", lambda *a: copied.append(whole(*a)) or copied[-1])
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 24))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[10:14] = v[20:24]
    points = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "point long, v array<double>")
    balls = metric_balls.build_balls(points, ball_rows=8, block_rows=128)
    found = metric_balls.nearest(points.withColumnRenamed("point", "id"), balls, own=True, block_rows=128).collect()
    own = metric_balls.cosine_distances(v, v)
    np.fill_diagonal(own, np.inf)
    assert len(found) == 400
    for r in found:
        assert abs(r["distance"] - own[r["id"]].min()) < 2e-12 and own[r["id"], r["point"]] < own[r["id"]].min() + 2e-12 and r["compared"] <= 400
    assert len(balls.ball) == 50 and sum(df.select(F.count(F.lit(1))).first()[0] for df in copied) <= 5 * 400
