"""Token ids of whole texts by a public tokenizer file, inside Arrow tasks.

The vocabulary drops white space, is in lower case and takes letters, single digits and marks apart, so a text may be
cut at blanks, tabs and line ends, and next to an ASCII letter or digit where a digit or a mark begins or ends, without
changing its ids. Texts are cut at all those boundaries; an Arrow dictionary of each slice gives its distinct pieces,
and each piece is encoded once while a table of bounded size remembers it.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa

from . import words as W

VOCABULARY = "word_bpe_49k.json"
SLICE_BYTES = 4 << 20
#: Pieces of up to so many bytes are told apart by one number, longer ones by an Arrow dictionary.
SHORT = 7
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(SHORT + 1)], np.uint64)


_OTHER, _BLANK, _LETTER, _DIGIT, _MARK = range(5)
#: Marks that no special token of the vocabulary and no contraction begins with or contains.
_KINDS = {_BLANK: b" \t\n\r", _DIGIT: b"0123456789", _MARK: b".,;:!?%$&*#()\"", _LETTER: b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_KIND = bytes(next((k for k, own in _KINDS.items() if b in own), _OTHER) for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _cuts(left: int, right: int) -> bool:
    """Whether a text may be cut between bytes of two kinds."""
    words = (_LETTER, _DIGIT)
    return _BLANK in (left, right) or (left in words and right in (_DIGIT, _MARK)) or (left in (_DIGIT, _MARK) and right in words)


#: For 8 * left + right: 1 where the text may be cut.
_PAIR = bytes(_cuts(x >> 3, x & 7) for x in range(64)) + bytes(192)


def _shown() -> dict[int, int]:
    """The character that stands for each byte in the vocabulary: itself where Latin-1 shows it, else the next from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in plain]
    return {b: 256 + k for k, b in enumerate(hidden)}


_SHOWN = _shown()


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    return W.slices(column, SLICE_BYTES)


@dataclass
class Pieces:
    """The pieces of a slice of a text column, in order: row r has those from first[r] to first[r + 1]."""
    first: np.ndarray
    text: np.ndarray     # bytes of the slice, ASCII letters in lower case
    start: np.ndarray    # byte range of each piece in it
    size: np.ndarray

    def short(self) -> tuple[np.ndarray, np.ndarray]:
        """Which pieces have up to SHORT bytes, and for those the bytes and their number in one 64-bit number."""
        short = self.size <= SHORT
        padded = np.zeros(len(self.text) + 8, np.uint8)
        padded[:len(self.text)] = self.text
        eight = np.ndarray(len(self.text) + 1, "<u8", padded, strides=(1,)).copy()  # the 8 bytes from each place on
        size = self.size[short]
        return short, (eight[self.start[short]] & _FIRST[size]) | (size.astype(np.uint64) << np.uint64(8 * SHORT))

    def strings(self, which: np.ndarray) -> pa.Array:
        """Some pieces, given by a mask."""
        size, start = self.size[which], self.start[which]
        places = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=places[1:])
        at = np.arange(places[-1]) + np.repeat(start - places[:-1], size)
        return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(places), pa.py_buffer(self.text[at])])


def pieces(part: pa.Array) -> Pieces:
    """Cut a slice of a text column.

    ASCII letters are put in lower case, but for those before a byte beyond ASCII (the two may compose) and in pieces
    that may hold a special token, whose case counts.
    """
    data, offsets = W.raw(part)
    text = data.tobytes()
    kind = np.frombuffer(text.translate(_KIND), np.uint8)
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = np.frombuffer((kind[:-1] * np.uint8(8) + kind[1:]).tobytes().translate(_PAIR), bool)
    cut[offsets] = True
    at = np.flatnonzero(cut)
    real = kind[at[:-1]] != _BLANK
    start, size = at[:-1][real], np.diff(at)[real]
    lower = np.frombuffer(text.translate(_LOWER), np.uint8)
    keep = np.flatnonzero(data >= 128) - 1  # letters that may compose with what follows
    keep = keep[keep >= 0]
    if b"<" in text:
        for k in np.unique(np.searchsorted(start, np.flatnonzero(data == ord("<")), "right") - 1):
            keep = np.append(keep, np.arange(start[k], start[k] + size[k]))
    if len(keep):
        lower = lower.copy()
        lower[keep] = data[keep]
    return Pieces(np.searchsorted(start, offsets), lower, start, size)


def _spelled(number: int) -> str:
    """The piece of a short piece's number."""
    return number.to_bytes(8, "little")[:number >> (8 * SHORT)].decode()


class PieceEncoder:
    """Encodes pieces. Two generations of `known` distinct pieces at most are remembered; what is met again stays."""

    def __init__(self, path: str, known: int = 400_000, batch: int = 1000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.known, self.batch = Tokenizer.from_file(path), known, batch
        self._check(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ids = max(vocabulary.values()) + 1
        self.word_end = np.zeros(self.ids, bool)
        self.word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.young: dict[str | int, bytes] = {}
        self.old: dict[str | int, bytes] = {}

    @staticmethod
    def _check(path: str) -> None:
        """The cuts hold for vocabularies of this form only."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        split = [p.get("pattern", {}).get("Regex", "") for p in steps]
        letters = [p["type"] == "ByteLevel" and not p["add_prefix_space"] for p in steps[1:]] == [True]
        if normal != ["NFC", "Replace", "Lowercase"] or not letters or not split[0].endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") or spec["model"].get("end_of_word_suffix") != "</w>":
            raise ValueError(f"{path}: not a vocabulary of words, single digits and marks in lower case")

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for k in range(0, len(texts), self.batch) for x in self.tokenizer.encode_batch_fast(texts[k:k + self.batch], add_special_tokens=False)]

    def _words(self, texts: list[str]) -> list[list[int]]:
        """Pieces of letters only: encoded as one text of many words and parted at the word ends."""
        out = []
        for k in range(0, len(texts), self.batch):
            some = texts[k:k + self.batch]
            ids = self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids
            ends = (np.flatnonzero(self.word_end[ids]) + 1).tolist()
            out += [ids[a:b] for a, b in zip([0, *ends], ends)] if len(ends) == len(some) else self._whole(some)
        return out

    def _learn(self, texts: list[str]) -> dict[str, bytes]:
        model, found = self.tokenizer.model, {}
        letters, other = [], []
        for t in texts:
            if not t.isalpha():
                other.append(t)
            elif t.isascii() and t.islower():
                found[t] = [x.id for x in model.tokenize(t)]
            elif t == t.lower() and unicodedata.is_normalized("NFC", t):  # what the normaliser would leave as it is
                found[t] = [x.id for x in model.tokenize(t.encode().decode("latin-1").translate(_SHOWN))]
            else:
                letters.append(t)
        found.update(zip(letters, self._words(letters)))
        found.update(zip(other, self._whole(other)))
        return {t: array("I", ids).tobytes() for t, ids in found.items()}

    def _table(self, names: list) -> list[bytes]:
        """The ids of each of the distinct pieces, which are texts or numbers of short ones."""
        if len(self.young) > self.known:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        found = list(map(young.get, names))
        missing = [t for t, f in zip(names, found) if f is None]
        if missing:
            young.update((t, old[t]) for t in missing if t in old)
            new = [t for t in missing if t not in old]
            texts = [_spelled(t) if isinstance(t, int) else t for t in new]
            learnt = self._learn(texts)
            young.update(zip(new, map(learnt.__getitem__, texts)))
            found = list(map(young.__getitem__, names))
        return found

    def _looked_up(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """First piece of each row, place of each piece in the table of distinct ones, and that table."""
        cut = pieces(part)
        short, numbers = cut.short()
        code, distinct = pd.factorize(numbers)
        coded = cut.strings(~short).dictionary_encode()
        place = np.empty(len(short), np.int64)
        place[short] = code
        place[~short] = coded.indices.to_numpy(zero_copy_only=False) + len(distinct)
        return cut.first, place, self._table(distinct.tolist() + coded.dictionary.to_pylist())

    def counts(self, part: pa.Array) -> np.ndarray:
        """Number of tokens of each row of a slice."""
        first, piece, table = self._looked_up(part)
        size = np.fromiter(map(len, table), np.int64, len(table)) // 4
        total = np.concatenate(([0], np.cumsum(size[piece])))
        return np.diff(total[first])

    def encode(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a slice, and the offset of each row in them."""
        first, piece, table = self._looked_up(part)
        size = np.fromiter(map(len, table), np.int64, len(table)) // 4
        begin = np.cumsum(size) - size
        length = size[piece]
        total = np.concatenate(([0], np.cumsum(length)))
        at = np.repeat(begin[piece] - total[:-1], length) + np.arange(total[-1])
        return np.frombuffer(b"".join(table), "<u4")[at], total[first]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One for each Python worker, so that what it remembers serves many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
