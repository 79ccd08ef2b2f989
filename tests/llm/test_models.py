"""Language and toxicity: held-out accuracy on invented texts, and the awkward cases."""

import random
import zlib

import cases
import pytest
from assaylake.llm import languages, toxicity

STEMS = {"aa": ["ka", "to", "mi", "ru", "sen"], "bb": ["sch", "ung", "keit", "ver", "ein"], "cc": ["tion", "eau", "ment", "que", "oir"]}


def text_of(draw, lang, n=60):
    return " ".join("".join(draw.choice(STEMS[lang]) for _ in range(draw.randint(1, 4))) for _ in range(n))


def out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(1)
    texts = [(100 + i, text_of(draw, lang), lang) for i, lang in enumerate(random.Random(2).choices(list(STEMS), k=600))]
    return spark.createDataFrame(texts, "doc_id long, text string, lang string")


def test_languages(spark, corpus):
    found = {r["doc_id"]: r for r in languages.languages_of(corpus).collect()}
    truth = {r["doc_id"]: r["lang"] for r in corpus.collect()}
    assert all(found[i]["held_out"] == out(i) for i in truth)
    held = [i for i in truth if out(i)]
    assert sum(found[i]["lang_pred"] == truth[i] for i in held) >= 0.98 * len(held)


def test_language_labels_of_held_out_rows_are_not_used(spark, corpus):
    from pyspark.sql import functions as F
    from assaylake.llm.folds import held_out
    lied = corpus.withColumn("lang", F.when(held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    assert cases.rows(languages.languages_of(lied)) == cases.rows(languages.languages_of(corpus))


def test_language_awkward_rows(spark):
    found = languages.languages_of(cases.documents(spark)).collect()
    assert len(found) == len(cases.TEXTS)
    plain = {r["doc_id"]: r["lang_pred"] for r in found}
    assert plain[0] == plain[1] == plain[2] == "und" and plain[3] == "en"
    unlabelled = languages.languages_of(cases.documents(spark, lang=None)).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}
    assert languages.languages_of(cases.empty(spark)).count() == 0


def test_codewords_are_apart():
    for n in (2, 3, 6, 7, 30):
        code = languages.codewords(n)
        apart = code @ code.T
        assert (apart[~__import__("numpy").eye(n, dtype=bool)] < code.shape[1]).all()


def test_toxicity(spark):
    draw = random.Random(7)
    texts, labels = [], []
    for i in range(500):
        words, toxic = text_of(draw, draw.choice(list(STEMS)), draw.randint(5, 200)).split(), i % 4 == 0
        for _ in range(3 if toxic else 0):
            words.insert(draw.randrange(len(words)), "vex" + draw.choice(["or", "ung", "eau", "mi", "a", "ter"]))
        texts.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (3, None), (10_000, 1)]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity.toxicity(cases.documents(spark, texts), table).collect()}
    held = [i for i in range(500) if out(i)]
    assert all(found[i]["held_out"] == out(i) and 0 <= found[i]["score"] <= 1 for i in range(500))
    right = sum(found[i]["predicted"] == int(i % 4 == 0) for i in held)
    assert right >= 0.95 * len(held)


def test_toxicity_awkward_rows(spark):
    docs = cases.documents(spark)
    for labels in ([], [(8, 1)], [(8, 1), (9, 0), (8, 0), (5, 0), (3, 1)]):
        found = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert len(found) == len(cases.TEXTS) and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.toxicity(cases.empty(spark), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


def test_network_gradients():
    import numpy as np
    import pyarrow as pa
    from assaylake.llm import words as W
    table = W.split(pa.array(["one two three two", "four five one"], pa.large_string()), W.NOT_ALPHANUMERIC)
    x = toxicity.word_inputs(table)
    net = toxicity.Network.new(np.zeros(toxicity.GRAMS))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    text, start = toxicity.windows(x.first)
    index, target, weight = toxicity.window_index(x, text, start), np.array([1.0, 0.0]), np.array([0.7, 0.3])

    def loss():
        logit = net.run(net.gates(net.embed(x)[0]).astype(np.float64), index)
        return float((weight * (np.logaddexp(0, logit) - target * logit)).sum())

    vectors, number = net.embed(x)
    g = net.gradients(x, vectors, number, net.gates(vectors), index, target, weight)
    for name, at in (("out", 3), ("attend", 2), ("look", (1, 2)), ("state", (0, 3, 5)), ("state", (1, 2, 30)), ("in", (1, 4, 20)), ("in_bias", (0, 0, 2)),
                     ("word", (int(x.word[0]), 1)), ("gram", (int(x.gram[0]), 2))):
        base, step = net.p[name][at], 1e-2
        net.p[name][at] = base + step
        up = loss()
        net.p[name][at] = base - step
        down = loss()
        net.p[name][at] = base
        assert abs((up - down) / (2 * step) - g[name][at]) < 2e-3 * max(1, abs(g[name][at])), name
