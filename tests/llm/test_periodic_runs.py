"""Periodic runs against all stretches of every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

import cases
from assaylake.llm import periodic_runs as P
from assaylake.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=6, repeats=4):
    """Every period, every maximal stretch; its smallest period by trying all smaller ones."""
    n, out = len(words), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, repeats * q):
                if not any(all(words[t] == words[t + d] for t in range(i, i + length - d)) for d in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1) if j == i else j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def contract(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    dropped = {t for s, length, q in runs for t in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for t, w in enumerate(words) if t not in dropped)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def wordy(seed, texts=400):
    draw, out = random.Random(seed), []
    for i in range(texts):
        words = []
        while len(words) < draw.randint(0, 90):
            letters = "ab" if draw.random() < .5 else "abcdefghi"
            period = [draw.choice(letters) for _ in range(draw.randint(1, 9))]
            words += (period * draw.randint(1, 7))[:draw.randint(1, 60)]
        out.append((i, draw.choice(["  ", " ", "\n", "\t\x0b "]).join(words)))
    return out


@pytest.mark.parametrize("least,repeats", [(6, 4), (2, 3), (40, 4), (9, 7)])
def test_runs_of_slices(least, repeats):
    texts = wordy(least)
    part = pa.array([t for _, t in texts], pa.large_string())
    table = W.split(part)
    start, length, period = P.runs_in(table.first, table.row, P.word_ranks(table)[0], least, repeats)
    row = table.row[start]
    found = sorted(zip(row.tolist(), (start - table.first[row]).tolist(), length.tolist(), period.tolist()))
    want = sorted((k, *r) for k, (_, t) in enumerate(texts) for r in brute(WORD.findall(t), least, repeats))
    assert found == want and len(want) > 50


def test_one_long_run_and_many_short_ones():
    text = " ".join(["a"] * 60_000 + ["x", "y"] + ["b", "b", "b", "b", "b", "b", "c"] * 20_000)
    table = W.split(pa.array([text], pa.large_string()))
    start, length, period = P.runs_in(table.first, table.row, P.word_ranks(table)[0])
    assert np.count_nonzero(period == 1) == 20_001 and (60_002, 140_000, 7) in zip(start.tolist(), length.tolist(), period.tolist())


def test_report(spark):
    long = [(900 + k, " ".join(f"w{random.Random(k).randrange(9)}{i % 3}" for i in range(300))) for k in range(3)]
    texts = [x for x in cases.TEXTS if x[0] not in (5, 6, 7)] + wordy(8) + long
    found = cases.rows(P.runs_report(cases.documents(spark, texts)), *COLUMNS)
    assert found == sorted((contract(i, t) for i, t in texts), key=repr)
    assert P.runs_report(cases.empty(spark)).count() == 0


def test_long_text_and_given_documents(spark):
    found = cases.by_id(P.runs_report(cases.documents(spark, [(5, cases.LONG), (6, (cases.LONG + " ") * 20)])))
    assert found[5]["n_runs"] == 0 and found[6]["n_words"] == 60_000 * 20
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 4000")
    want = sorted((contract(r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    assert cases.rows(P.runs_report(docs), *COLUMNS) == want
    assert any(r[1] for r in want)
