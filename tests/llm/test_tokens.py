"""Token counts and packing against the tokenizer itself."""

import struct
import zlib

import pytest
from tokenizers import Tokenizer

import cases
from assaylake.llm import packing, token_counts, tokens

STRANGE = [(50, "a<|endoftext|>b <|STARTOFTEXT|>.x"), (51, "it's  I'LL.don't 3.14%é́, ﬁ İstanbul ΑΣ\n\tΣ"), (52, "é.́x ́a \x0b b\x0cc\x85d　e"),
           (53, "x" * 5000 + " 日本語。テスト！ '.'s a'.s (a)b\"c:'re"), (54, "<|endoftext|>" * 3 + "|>end<|")]


@pytest.fixture(scope="module")
def ids():
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    return [(i, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in cases.TEXTS + STRANGE]


def test_token_counts(spark, ids):
    found = cases.rows(token_counts.token_counts(cases.documents(spark, cases.TEXTS + STRANGE)), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = [(i, len((t or "").encode()), len(x), len(x) > 2048) for (i, t), (_, x) in zip(cases.TEXTS + STRANGE, ids)]
    assert found == sorted(want, key=repr)
    assert token_counts.token_counts(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_packing(spark, ids, parts):
    docs = cases.documents(spark, cases.TEXTS + STRANGE).repartition(parts)
    pieces = packing.packed(docs).collect()
    at = (0, 0)
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert (p["sequence_id"], p["offset"]) == at and p["length"] == len(p["ids"]) // 4
        at = (at[0], at[1] + p["length"]) if at[1] + p["length"] < 2048 else (at[0] + 1, 0)
    # each document once and whole: put the pieces together again along the stream
    whole, current = [], []
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        if p["start"] == 0:
            current = []
        assert len(current) == p["start"]
        current = current + list(struct.unpack(f"<{p['length']}I", bytes(p["ids"])))
        if len(current) == p["doc_tokens"]:
            whole.append((p["doc_id"], current))
    assert sorted(whole, key=repr) == sorted([(i, x + [1]) for i, x in ids], key=repr)


def test_packing_report(spark, ids):
    docs = cases.documents(spark)
    found = packing.packing_report(docs).where("doc_id = 9").collect()
    own = dict(ids)[9] + [1]
    assert [(r["start"], r["length"], r["ids_crc32"]) for r in found] == [(0, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own)))]
    assert packing.packing_report(cases.empty(spark)).count() == 0
