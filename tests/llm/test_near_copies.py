"""Near copies: signatures, verification, and classes against all pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

import cases
from assaylake.llm import near_copies as N
from assaylake.llm import words as W


def bag(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def similarity(a, b):
    shared, total = sum((a & b).values()), sum(a.values()) + sum(b.values())
    return 1.0 if total == 0 else shared / (total - shared)


def brute(texts):
    bags = [bag(t) for _, t in texts]
    label = list(range(len(texts)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if similarity(bags[i], bags[j]) >= 0.8:
                label[top(i)] = top(j)
    groups = defaultdict(list)
    for i in range(len(texts)):
        groups[top(i)].append(texts[i][0])
    return sorted(sorted(map(repr, g)) for g in groups.values())


def corpus(seed=4):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = []
    for _ in range(40):
        base = [draw.choice(vocabulary) for _ in range(draw.randint(30, 300))]
        for _ in range(draw.choice([1, 2, 5])):
            own = list(base)
            for _ in range(int(len(own) * draw.choice([0, 0.01, 0.03, 0.2]))):
                own[draw.randrange(len(own))] = draw.choice(vocabulary)
            texts.append(" ".join(own))
    base = [draw.choice(vocabulary) for _ in range(200)]
    for _ in range(150):  # a large group around one text
        own = list(base)
        for _ in range(2):
            own[draw.randrange(200)] = draw.choice(vocabulary)
        texts.append(" ".join(own))
    shared = " ".join(draw.choice(vocabulary) for _ in range(60))
    texts += [shared + " " + " ".join(draw.choice(vocabulary) for _ in range(60)) for _ in range(150)]  # alike, but no near copies
    texts += ["go on " * n for n in (40, 41, 60, 100)]  # the same shingles in other numbers
    return [(1000 + i, t) for i, t in enumerate(texts)] + cases.TEXTS


def test_classes_against_all_pairs(spark):
    texts = corpus()
    found = N.near_copy_classes(cases.documents(spark, texts).repartition(3)).collect()
    assert len(found) == len(texts)
    groups, kept = defaultdict(list), Counter()
    for r in found:
        groups[r["class_id"]].append(repr(r["doc_id"]))
        kept[r["class_id"]] += r["kept"]
    want = brute(texts)
    assert sorted(sorted(g) for g in groups.values()) == want
    assert set(kept.values()) == {1} and all(len(groups[r["class_id"]]) == r["class_size"] for r in found)


def test_small_blocks_give_the_same(spark):
    texts = corpus(6)[-260:]
    rows = N.signed(cases.documents(spark, texts).select("doc_id", "text"), "text", N.Bands())
    copies = N.staged(rows.dropDuplicates(["key"]), "test")
    wide = cases.rows(N.near_classes(copies, "text", N.Bands()))
    assert wide and wide == cases.rows(N.near_classes(copies, "text", N.Bands(), block=8, block_bytes=20_000))


def test_stage_keeps_one_of_each_class(spark):
    docs = cases.documents(spark)
    out = N.without_near_copies(docs)
    assert out.schema == docs.schema
    assert cases.rows(out, "text") == cases.rows(N.without_near_copies(out), "text")
    assert out.count() == len(brute(cases.TEXTS))
    assert N.without_near_copies(cases.empty(spark)).count() == 0 and N.near_copy_classes(cases.empty(spark)).count() == 0


def test_signatures_estimate_weighted_similarity():
    draw = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        weight = draw.integers(0, 9, (2, 80))
        bags = [[(h, w) for h, w in zip(range(80), row) if w] for row in weight]
        found = np.array([h for b in bags for h, _ in b], np.uint64)
        row = np.array([k for k, b in enumerate(bags) for _ in b])
        times = N.bag_minhash(W.mix(found + np.uint64(1)), row, np.array([w for b in bags for _, w in b]), 2, 500)
        errors.append((times[0] == times[1]).mean() - np.minimum(*weight).sum() / np.maximum(*weight).sum())
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_multiset_similarity_is_exact():
    texts = [t for _, t in corpus(8)][:120]
    left, right = texts, texts[1:] + texts[:1]
    found = N.multiset_similarity(pa.array(left, pa.string()), pa.array(right, pa.string()))
    assert np.allclose(found, [similarity(bag(a), bag(b)) for a, b in zip(left, right)])
