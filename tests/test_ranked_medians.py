"""Medians of small groups are ranked without rounds of narrowing, with the same values."""

import random
import statistics

from assaylake.operators import order_statistics


def test_small_groups_take_no_rounds(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(g, rng.choice([rng.gauss(0, 5), 1.0, -2.5])) for g in range(7) for _ in range(rng.randrange(1, 60))]
    df = spark.createDataFrame(rows, "g int, v double")
    expected = {g: statistics.median(v for h, v in rows if h == g) for g in range(7)}
    written = []
    cut = order_statistics.cut_lineage
    monkeypatch.setattr(order_statistics, "cut_lineage", lambda x: written.append(1) or cut(x))
    for limit, tables in ((0, 4), (100, 2)):
        written.clear()
        found = {r["g"]: r["median"] for r in order_statistics.grouped_medians(df, ["g"], "v", ranked_values=limit).collect()}
        assert len(found) == 7 and all(abs(found[g] - expected[g]) < 1e-12 for g in found) and len(written) == tables
