"""Hashes and pieces of words on inputs that break a polynomial modulo 2^64."""

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import cases
from assaylake.llm import near_copies, packing, quality, token_counts, tokens
from assaylake.llm import words as W


def mirrored(power):
    """A Thue-Morse word and its mirror: they agree in every polynomial modulo 2^64."""
    word = "a"
    for _ in range(power):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_hashes_differ_and_do_not_depend_on_place():
    pair = mirrored(10) + mirrored(11) + mirrored(12)
    table = W.split(pa.array([" ".join(pair), "x" * 70_000 + " " + " ".join(pair)], pa.large_string()))
    hashes = table.hashes()
    assert len(set(hashes[:6].tolist())) == 6
    assert hashes[:6].tolist() == hashes[7:].tolist()


def test_long_ranges():
    data = np.frombuffer(b"z" * (W._LONG + 10) + b"y", np.uint8)
    whole = W.range_hashes(data, np.array([0]), np.array([len(data)]))
    other = W.range_hashes(np.append(data[:-1], np.uint8(ord("x"))), np.array([0]), np.array([len(data)]))
    assert whole[0] != other[0]


@pytest.fixture(scope="module")
def texts():
    pair = mirrored(10) + mirrored(11)
    return [(k, w) for k, w in enumerate(pair)] + [(10 + k, f"one two three {w} four five six seven") for k, w in enumerate(pair)]


def test_tokens_of_mirrored_words(spark, texts):
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in texts}
    docs = cases.documents(spark, texts).coalesce(1)
    assert {i: r["n_tokens"] for i, r in cases.by_id(token_counts.token_counts(docs)).items()} == {i: len(x) for i, x in want.items()}
    pieces = [r for r in packing.packed(docs).collect()]
    for i, ids in want.items():
        own = b"".join(bytes(r["ids"]) for r in sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["start"]))
        assert np.frombuffer(own, "<u4").tolist() == [*ids, 1]


def test_copies_and_lines_of_mirrored_words(spark, texts):
    docs = cases.documents(spark, texts)
    sizes = [r["class_size"] for r in near_copies.near_copy_classes(docs).collect()]
    assert sizes == [1] * len(texts)
    lines = cases.documents(spark, [(1, "\n".join(mirrored(10) + mirrored(11)))])
    assert quality.quality_report(lines).first()["n_dup_lines"] == 0


def test_remembered_pieces_turn_over():
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    encoder = tokens.PieceEncoder(tokens.vocabulary_path(), known=20, batch=7)
    texts = [" ".join(f"word{i % 37}é{i % 5} Tail.{i}'s É{i}<|endoftext|>x <|ENDOFTEXT|>" for i in range(k, k + 30)) for k in range(0, 200, 9)]
    for t in texts + texts:
        assert encoder.encode(pa.array([t], pa.large_string()))[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tokens.PieceEncoder(tokens.vocabulary_path("byte_bpe_50k.json"))
