"""Quality statistics against a plain count, and the verdicts on planted bad text."""

import random
import re
from collections import Counter

import cases
from assaylake.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def noisy(n):
    draw = random.Random(3)
    bits = ["a", "b", "é", "日本", "#", "*x", "\n", "\n", "\n\n", "\t", " ", "\x0b", " ", "word", "Word!", "| |", "\r\n", " b"]
    return [(100 + i, "".join(draw.choice(bits) + draw.choice(["", " "]) for _ in range(draw.randint(0, 60)))) for i in range(300)]


def test_statistics(spark):
    texts = cases.TEXTS + noisy(300)
    found = cases.rows(quality.quality_report(cases.documents(spark, texts)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for i, t in texts:
        b = brute(t)
        want.append((i, *b, b[0] < 50 or 100 * b[4] > 50 * b[0]))
    assert found == sorted(want, key=repr)


def sentence(draw, n=120):
    return " ".join(draw.choice(["river", "stone", "window", "garden", "letter", "music", "winter", "answer"]) + draw.choice("abcdefghij") * draw.randint(0, 3)
                    + str(draw.randint(0, 9) if draw.random() < .02 else "") for _ in range(n)) + "."


def test_verdicts(spark):
    draw = random.Random(5)
    good = [(i, sentence(draw)) for i in range(400)]
    bad = [(1000 + i, re.sub(" ", "%%% ", sentence(draw))) for i in range(30)] + [(2000 + i, sentence(draw).upper().replace(" ", "!! ")) for i in range(30)]
    found = {r["doc_id"]: r["kept"] for r in quality.quality_report(cases.documents(spark, good + bad)).collect()}
    assert all(found[i] for i, _ in good) and not any(found[i] for i, _ in bad)


def test_verdict_does_not_depend_on_length(spark):
    draw = random.Random(6)
    text = lambda n, size: " ".join(f"{draw.choice(['river', 'stone', 'window', 'garden'])}{'abcdefghij'[w % 10]}{'klmnopqrst'[w // 10 % 10]}{'uvwxyz'[w // 100 % 6]}" for w in (draw.randrange(size) for _ in range(n)))
    good, short = [(i, text(300, 600)) for i in range(200)], [(1000 + i, text(20, 600)) for i in range(100)]
    long = [(2000 + i, text(n, 600)) for i, n in enumerate((5_000, 30_000, 60_000, 120_000))]
    dull = [(3000, " ".join(["river stone window"] * 40_000)), (3001, " ".join(draw.choice(["river", "stone"]) for _ in range(120_000)))]
    found = cases.by_id(quality.quality_report(cases.documents(spark, good + short + long + dull)))
    assert [found[i]["kept"] for i, _ in good + long] == [True] * 204
    assert not any(found[i]["kept"] for i, _ in short + dull)


def test_accepted_keeps_columns(spark):
    docs = cases.documents(spark)
    out = quality.accepted(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    assert quality.accepted(cases.empty(spark)).count() == 0
    assert quality.quality_report(cases.empty(spark)).count() == 0
