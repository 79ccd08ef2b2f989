"""Words of Arrow text columns as NumPy arrays, for use inside tasks.

A column is read in slices of bounded bytes; a slice gives one flat table of words (row, byte range, 64-bit hash),
so that no step loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
SLICE_ROWS = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)

#: White space of `[^\x20\x09-\x0D]+`: blank, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything in ASCII that is neither letter nor digit.
NOT_ALPHANUMERIC = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass
class Words:
    rows: int
    data: np.ndarray      # bytes of all rows
    offsets: np.ndarray   # of each row in data, rows + 1
    row: np.ndarray       # of each word
    start: np.ndarray     # byte range of each word
    end: np.ndarray
    first: np.ndarray     # first word of each row, rows + 1

    def hashes(self) -> np.ndarray:
        return range_hashes(self.data, self.start, self.end)


def text_column(column: pa.Array) -> pa.Array:
    """As large strings without nulls."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows of about `most` bytes (one row at least), with the position of the first."""
    column = text_column(column)
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        done = ends[at - 1] if at else 0
        to = max(at + 1, min(at + SLICE_ROWS, int(np.searchsorted(ends, done + most, "right"))))
        yield at, column.slice(at, to - at)
        at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large string column, the first offset 0."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def split(column: pa.Array, separators: np.ndarray = WHITE) -> Words:
    """Words are the maximal runs of bytes that are no separators."""
    data, offsets = raw(column)
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(len(column), data, offsets, row, start, end, np.searchsorted(row, np.arange(len(column) + 1)))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Two primes below 2^31 and a base drawn for each; a prime modulus has no words that agree for every base.
_PRIMES = (np.uint64(2147483647), np.uint64(2147483629))
_BASES = (1518500249, 1229782938)
_LONG = 1 << 24
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo its prime, 0 to n - 1 at least."""
    prime = _PRIMES[which]
    if which not in _TABLES or len(_TABLES[which][0]) < n:
        def up(base: int) -> np.ndarray:
            out, have = np.ones(n, np.uint64), 1
            while have < n:  # the next stretch is the first one times one power
                to = min(n, 2 * have)
                out[have:to] = out[:to - have] * np.uint64(pow(base, have, int(prime))) % prime
                have = to
            return out
        _TABLES[which] = up(_BASES[which]), up(pow(_BASES[which], -1, int(prime)))
    return _TABLES[which]


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 19) -> np.ndarray:
    """64-bit hash of each byte range; ranges are in order. Polynomials modulo two primes by prefix sums, over blocks of bounded size."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        low = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, low + block, "right")))
        high = int(end[to - 1])
        letters = data[low:high].astype(np.uint64) + np.uint64(1)
        s, e = start[at:to] - low, end[at:to] - low
        found = (end[at:to] - start[at:to]).astype(np.uint64)
        for which, prime in enumerate(_PRIMES):
            powers, inverse = _powers(which, high - low + 1)
            terms = letters * powers[:high - low]  # below 2^39, so 2^24 of them add up without overflow
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(terms if high - low <= _LONG else terms % prime, out=sums[1:])
            found = mix(found) + (sums[e] - sums[s]) % prime * inverse[s] % prime
        out[at:to] = found
        at = to
    return mix(out)


def shingles(words: Words, size: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every run of `size` words inside one row, in order."""
    hashes = words.hashes() if hashes is None else hashes
    n = max(0, len(hashes) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += mix(hashes[k:k + n] + np.uint64(k + 1))
    at = np.flatnonzero(words.row[:n] == words.row[size - 1:size - 1 + n])
    return mix(total[at]), at


def in_row(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes that are equal only for equal hashes of one row."""
    return mix(hashes + row.astype(np.uint64) * _BASE)


def distinct_per(rows: int, row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Distinct hashes of each row (48 bits of each hash count)."""
    key = np.sort((row.astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16)))
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    return count_per(rows, (key[new] >> np.uint64(48)).astype(np.int64))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = twice[np.concatenate(([True], twice[1:] != twice[:-1]))]
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def count_per(rows: int, row: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weights, rows).astype(np.int64)[:rows]
