"""Containment of benchmark items against exact shingle sets."""

import random
import re

import cases
from assaylake.llm import decontamination as D


def shingles(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def made(seed=2):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randint(3, 60)))) for i in range(60)] + [(60, None), (61, ""), (None, "an item without an id of its own words"), (0, "w1 w2")]
    docs = []
    for i in range(300):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(0, 400))]
        if i % 3 == 0:  # an item, sometimes damaged, in other case and marks
            own = items[draw.randrange(60)][1].upper().split()
            for _ in range(draw.choice([0, 0, 1, 3])):
                own[draw.randrange(len(own))] = "other"
            words[len(words) // 2:len(words) // 2] = [w + draw.choice(["", ",", "%%"]) for w in own]
        docs.append((1000 + i, " ".join(words)))
    return docs + cases.TEXTS, items


def check(spark, search):
    texts, items = made()
    table = spark.createDataFrame(items, "item_id long, text string")
    found = D.leaking_pairs(cases.documents(spark, texts), table, search).collect()
    want = set()
    for i, t in texts:
        own = shingles(t)
        for k, item in items:
            s = shingles(item)
            if s and len(s & own) >= 0.8 * len(s):
                want.add((i, k, len(s), len(s & own)))
    assert {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in found} == want and len(want) > 40


def test_all_pairs_are_found(spark):
    check(spark, D.Search())


def test_several_passes_give_the_same(spark):
    check(spark, D.Search(index_values=1500))


def test_columns_and_empty_tables(spark):
    docs = cases.documents(spark)
    items = spark.createDataFrame([(1, cases.TEXTS[8][1])], "item_id long, text string")
    out = D.without_leaks(docs, items)
    assert out.schema == docs.schema and out.count() == docs.count() - 2
    none = items.limit(0)
    assert D.without_leaks(docs, none).count() == docs.count() and D.leaking_pairs(cases.empty(spark), items).count() == 0


def test_copies_of_an_item_are_indexed_once(spark):
    """A third of the benchmark is one text: the index holds it once, and every copy is a row of the result."""
    texts = [(i, f"start {i} " + " ".join(f"q{k}" for k in range(40)) + " end") for i in range(5)]
    items = spark.createDataFrame([(k, " ".join(f"q{j}" for j in range(30))) for k in range(400)] + [(1000 + k, " ".join(f"z{k}x{j}" for j in range(9))) for k in range(800)],
                                  "item_id long, text string")
    search = D.Search(index_values=10_000)
    tables = list(D._index_passes(D.numbered_items(items, "item_id", "text", search), search))
    assert sum(t.num_rows for t in tables) == 801 and max(sum(t["n"].to_pylist()) + 64 * t.num_rows for t in tables) < 2 * search.index_values
    found = D.leaking_pairs(cases.documents(spark, texts), items, search).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, k) for i in range(5) for k in range(400)} and len(found) == 2000
