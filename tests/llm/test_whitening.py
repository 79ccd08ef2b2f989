"""Whitening against a plain NumPy version over the fit list."""

import math

import numpy as np
import pytest

from assaylake.llm import whitening as H

SCHEMA = "vec_id long, embedding array<float>, label int, x string, index int, uid string, n int"


def table(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, 1, "x", 2, "u", 3) for i, v in vectors], SCHEMA).repartition(parts)


def brute(vectors, components=4):
    rows = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    longest = max((len(x) for _, x in rows), default=0)
    rows = [(i, x) for i, x in rows if len(x) == longest and x]
    fit = sorted({tuple(x) for _, x in rows})
    if not fit:
        return {}, None
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    out = {}
    for place, (i, x) in enumerate(rows):
        d = [n * a - s for a, s in zip(x, sums)]
        out.setdefault(i, []).append((n, sum(a * a for a in d), (np.array(d) / n) @ vectors_[:, :components] / np.sqrt(values[:components])))
    return out, values / values.sum()


def compare(found, vectors, components=4):
    want, explained = brute(vectors)
    rows = {}
    for r in found.collect():
        rows.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert {k for k, _ in rows} == set(want)
    for k in range(1, components + 1):
        got = [(sorted(r["whitened"] for r in rows[i, k]), sorted(w[2][k - 1] for w in want[i])) for i in want]
        flip = [(a, sorted(-x for x in b)) for a, b in got]
        error = min(max(abs(x - y) for a, b in side for x, y in zip(a, b, strict=True)) for side in (got, flip))
        assert error < 1e-8
    for (i, k), own in rows.items():
        assert sorted((r["n"], r["deviation"]) for r in own) == sorted((n, d) for n, d, _ in want[i])
        assert all(abs(r["explained"] / explained[k - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9 for r in own)


@pytest.mark.parametrize("parts", [1, 5])
def test_against_numpy(spark, parts, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_BYTES", 8 * 12 * 16)  # blocks of 16 rows, so that there are many
    draw = np.random.default_rng(3)
    base = draw.normal(size=(300, 12)) * np.linspace(3, .2, 12) + np.linspace(-40, 40, 12)
    vectors = [(i, v.tolist()) for i, v in enumerate(base.astype(np.float32))]
    vectors += [(1000 + i, vectors[7][1]) for i in range(150)] + [(5, vectors[5][1])]  # a hot vector, a repeated row
    vectors += [(2000, None), (2001, []), (2002, [1.0] * 11), (2003, [1.0] * 11 + [None]), (2004, [float("nan")] * 12), (2005, [float("inf")] + [0.0] * 11),
                (None, vectors[9][1])]
    compare(H.whitening_report(table(spark, vectors, parts)), vectors)


def test_given_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    compare(H.whitening_report(rows), [(r["vec_id"], r["embedding"]) for r in rows.collect()])


def test_nothing_varies(spark):
    same = [(i, [1.0, 2.0]) for i in range(5)]
    for vectors in ([], same, [(1, []), (2, None)]):
        report = H.whitening_report(table(spark, vectors))
        assert report.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and report.count() == 0


def test_fewer_components_than_asked(spark):
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(20)]
    report = H.whitening_report(table(spark, line)).collect()
    assert {r["component"] for r in report} == {1} and abs(report[0]["explained"] - 1) < 1e-12


def test_deviation_beyond_64_bits(spark):
    wide = [(1, [1e14, 0.0]), (2, [-1e14, 1.0]), (3, [0.0, 2.0])]
    found = {r["vec_id"]: r["deviation"] for r in H.whitening_report(table(spark, wide)).where("component = 1").collect()}
    assert found[1] is None and found[2] is None and found[3] is not None
