"""Token files: exact round trips, order, splits at checkpoints, and damage."""

import json
import os
import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import cases
from assaylake.llm import token_files as X
from assaylake.llm import tokens
from assaylake.llm.token_coding import Coder, CorruptTokens, Shape, shared_frequencies

SMALL = Shape(precision=16, lanes=4, steps=24, checkpoint=8)


@pytest.mark.parametrize("shape", [Shape(), Shape(12, 3, 7, 3), Shape(20, 1, 5, 5), Shape(9, 16, 4, 1)])
@pytest.mark.parametrize("n", [0, 1, 5, 333, 40_000])
def test_coder_round_trip(shape, n):
    draw = np.random.default_rng(n)
    ids = np.minimum(draw.zipf(1.2, n) - 1, 300).astype(np.uint32)
    coder = Coder(shared_frequencies(np.bincount(ids, minlength=400), shape.precision), shape)
    blocks = coder.encode(ids)
    assert np.array_equal(coder.decode(blocks), ids)
    for k in range(0, len(blocks), 7):  # any block alone
        assert np.array_equal(coder.decode(blocks[k:k + 1]), ids[k * shape.block:(k + 1) * shape.block])


def test_size_is_near_the_entropy():
    ids = np.minimum(np.random.default_rng(2).zipf(1.3, 500_000) - 1, 49_000).astype(np.uint32)
    share = np.bincount(ids)[np.bincount(ids) > 0] / len(ids)
    coder = Coder(shared_frequencies(np.bincount(ids), 20))
    size = sum(len(b.words) + b.states.nbytes + b.places.nbytes for b in coder.encode(ids))
    assert size * 8 / len(ids) < 1.06 * -(share * np.log2(share)).sum()


def test_frequencies():
    counts = np.array([0, 1, 10**17, 3, 0, 10**16])
    found = shared_frequencies(counts, 10)
    assert found.sum() == 1024 and (found[counts > 0] > 0).all() and (found[counts == 0] == 0).all()
    assert shared_frequencies(np.zeros(4, int), 10).sum() == 0
    with pytest.raises(ValueError):
        shared_frequencies(np.ones(9, int), 3)


def wanted(texts):
    """Rows with the number of ids before them, for ids that differ."""
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    out, at = [], 0
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0])):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, at, len(ids), struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    return out


@pytest.mark.parametrize("parts,file_ids,shape", [(1, 1 << 25, Shape()), (4, 2000, SMALL), (3, 9000, SMALL)])
def test_files(spark, tmp_path, monkeypatch, parts, file_ids, shape):
    monkeypatch.setattr(X, "READ_BLOCKS", 3)
    seen = set()
    texts = [x for x in cases.TEXTS if not (x[0] in seen or seen.add(x[0]))] + [(100 + k, f"text {k} " * (k % 12)) for k in range(100)]
    if shape == SMALL:
        texts = [(i, t and t[:9000]) for i, t in texts]
    path = f"{tmp_path}/out"
    X.write_token_files(cases.documents(spark, texts).repartition(parts), path, shape=shape, file_ids=file_ids)
    found = sorted(((r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in X.read_token_files(spark, path).collect()), key=lambda r: r[1])
    assert found == wanted(texts)
    manifest = json.load(open(f"{path}/manifest.json"))
    assert manifest["ids"] == sum(r[2] for r in found) and len(manifest["files"]) > (1 if shape == SMALL else 0)
    with pytest.raises(ValueError):
        X.write_token_files(cases.documents(spark, texts), path)


def test_repeated_ids_and_rows(spark, tmp_path):
    texts = [(i, t and t[:5000]) for i, t in cases.TEXTS] + [(8, "another text of the same id")] * 3 + [(8, None)] * 200
    X.write_token_files(cases.documents(spark, texts), f"{tmp_path}/out", shape=SMALL, file_ids=5000)
    found = sorted(X.read_token_files(spark, f"{tmp_path}/out").collect(), key=lambda r: r["start"])
    want = wanted(texts)
    assert [(r["doc_id"] is not None, r["doc_id"]) for r in found] == [(i is not None, i) for i, *_ in want]
    assert sorted((repr(r["doc_id"]), bytes(r["ids"])) for r in found) == sorted((repr(i), b) for i, _, _, b in want)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(found, found[1:]))


def test_report_and_empty_table(spark, tmp_path):
    texts = [(i, t) for i, t in cases.TEXTS if i in (1, 3, 9, 10)]
    found = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in X.token_files_report(cases.documents(spark, texts)).collect()}
    assert found == {i: (at, n, zlib.crc32(b)) for i, at, n, b in wanted(texts)}
    empty = X.token_files_report(cases.empty(spark))
    assert empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and empty.count() == 0


def test_damage_is_found(spark, tmp_path):
    X.write_token_files(cases.documents(spark, [(k, f"some words of text {k}") for k in range(400)]).coalesce(1), f"{tmp_path}/out", shape=SMALL)
    file = next(f"{tmp_path}/out/{x}" for x in os.listdir(f"{tmp_path}/out") if x.endswith(".ids"))
    content = open(file, "rb").read()
    for at in (10, len(content) - 60):
        with open(file, "wb") as out:
            out.write(content[:at] + bytes([content[at] ^ 4]) + content[at + 1:])
        with pytest.raises(Exception, match="does not give its checksum|footer is damaged|rans|decode|Corrupt"):
            X.read_token_files(spark, f"{tmp_path}/out").collect()
    assert CorruptTokens.__mro__[1] is ValueError
