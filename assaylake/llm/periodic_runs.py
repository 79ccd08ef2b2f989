"""Periodic runs of words by seeds on diagonals, whole texts.

A run is a stretch of words with smallest period q and a length of at least max(least_words, repeats * q) that no
neighbouring word extends. On the diagonal of lag q (word i against word i + q) it is a stretch of length - q equal
words, and that is at least k(q) = max(least_words - q, (repeats - 1) * q): the guaranteed overlap. Lags are taken in
classes (1, 2, 3-4, 5-8, ...), and each class has an index of the k-grams of its least guaranteed overlap, ranked exactly by
doubling (the rank of 2m words is that of the pair of its halves) and only where both halves occur twice in their text.

A seed is a pair of *consecutive* occurrences of one k-gram in one document whose lag lies in the class. As k is at
least the lag, the lag of a seed is the smallest period around it, and every run begins with a seed, so no other pair
of occurrences is needed: a frequent k-gram gives as many seeds as occurrences, never their square. Seeds go along
their diagonals; a table of how far each lag is covered suppresses seeds that lie inside what was already extended, and
the others are extended word by word to both sides.

Work and memory of a text of n words grow as n log n; a slice of texts is worked on at once.

Defined cases: null and empty texts have no words and no runs; repeated rows and ids are rows of their own; null ids
are carried through; an empty table gives no row; extra columns are not read, so their names cannot clash; ties between
runs cannot arise (equal start and period is the same run).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import let
from . import words as W
from .staging import arrow_rows

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
WORD = "[^\\x20\\x09-\\x0D]+"


def word_ranks(table: W.Words) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, equal for equal words only, and the bytes of the words one after another."""
    places = np.concatenate(([0], np.cumsum(table.end - table.start))).astype(np.int64)
    joined = table.data[~W.WHITE[table.data]]
    found = pa.Array.from_buffers(pa.large_binary(), len(table.start), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(joined.tobytes())])
    return found.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), found


class _Grams:
    """Ranks of grams of 1, 2, 4, ... words inside their rows, at the places where the gram occurs twice in its row."""

    def __init__(self, row: np.ndarray, rank: np.ndarray):
        n = len(rank)
        self.row, self.n = row, n
        self.levels = [self._twice(row * (int(rank.max(initial=0)) + 1) + rank, np.arange(n))]

    def _twice(self, key: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Dense ranks of the keys by place, -1 where the key occurs once or never."""
        out = np.full(self.n, -1, np.int64)
        if len(key):
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            again = count[inverse] > 1
            out[at[again]] = (np.cumsum(count > 1) - 1)[inverse[again]]
        return out

    def _pairs(self, half: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(key, place) of each pair of grams `step` apart in one row, both of which occur twice."""
        if step >= self.n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero((half[:-step] >= 0) & (half[step:] >= 0) & (self.row[:-step] == self.row[step:]))
        return half[at] * (int(half.max(initial=0)) + 1) + half[at + step], at

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(rank, place) of the grams of `size` words that may occur twice in their row, by rank and place."""
        level = size.bit_length() - 1
        while len(self.levels) <= level:
            self.levels.append(self._twice(*self._pairs(self.levels[-1], 1 << (len(self.levels) - 1))))
        half = self.levels[level]
        if size == 1 << level:
            at = np.flatnonzero(half >= 0)
            key = half[at]
        else:
            key, at = self._pairs(half, size - (1 << level))
        order = np.argsort(key, kind="stable")
        return key[order], at[order]


def _extended(rank: np.ndarray, low: np.ndarray, high: np.ndarray, left: np.ndarray, right: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches [left, right) of their diagonals, grown word by word inside [low, high) while words `lag` apart are equal."""
    left, right = left.copy(), right.copy()
    going = np.arange(len(left))
    while len(going):
        going = going[left[going] > low[going]]
        going = going[rank[left[going] - 1] == rank[left[going] - 1 + lag[going]]]
        left[going] -= 1
    going = np.arange(len(left))
    while len(going):
        going = going[right[going] + lag[going] < high[going]]
        going = going[rank[right[going]] == rank[right[going] + lag[going]]]
        right[going] += 1
    return left, right


def runs_in(first: np.ndarray, row: np.ndarray, rank: np.ndarray, least_words: int = 6, repeats: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, period) of every run, by first word and period; rows are the stretches first[r] to first[r + 1]."""
    grams, longest = _Grams(row, rank), int(np.diff(first).max(initial=0))
    found = []
    low_lag, high_lag = 1, 1
    while max(least_words, repeats * low_lag) <= longest:
        # the least guaranteed overlap of the lags low_lag to high_lag, at an end or where both bounds meet; never under high_lag
        meet = (min(high_lag, max(low_lag, q)) for q in (least_words // repeats, least_words // repeats + 1))
        size = min(max(least_words - q, (repeats - 1) * q) for q in {low_lag, high_lag, *meet})
        key, at = grams.of(size)
        if not len(key) and low_lag * repeats >= least_words:
            break  # from here on grams only get longer, and those do not repeat either
        lag = at[1:] - at[:-1]
        seed = (key[1:] == key[:-1]) & (lag >= low_lag) & (lag <= high_lag)
        start, lag = at[:-1][seed], lag[seed]
        order = np.lexsort((start, lag, row[start]))
        start, lag = start[order], lag[order]
        # how far each diagonal is covered by the seeds before: a seed inside it is suppressed
        same = np.concatenate(([False], (lag[1:] == lag[:-1]) & (row[start[1:]] == row[start[:-1]]))) if len(start) else np.zeros(0, bool)
        covered = np.concatenate(([-1], start[:-1] + size)) if len(start) else np.zeros(0, np.int64)
        head = np.flatnonzero(~same | (start > covered))
        reach = start[np.append(head[1:], len(start)) - 1] + size if len(head) else np.zeros(0, np.int64)
        own = row[start[head]]
        left, right = _extended(rank, first[own], first[own + 1], start[head], reach, lag[head])
        length = right - left + lag[head]
        good = length >= np.maximum(least_words, repeats * lag[head])
        found.append(np.column_stack((left, length, lag[head]))[good])
        low_lag, high_lag = high_lag + 1, max(2, 2 * high_lag)
    every = np.unique(np.concatenate([np.zeros((0, 3), np.int64), *found]), axis=0)
    every = every[np.lexsort((every[:, 2], every[:, 0]))]
    return every[:, 0], every[:, 1], every[:, 2]


def _collapsed(table: W.Words, joined: pa.Array, kept: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one blank."""
    at = np.flatnonzero(kept)
    size, row = (table.end - table.start)[at], table.row[at]
    blank = np.concatenate((row[1:] == row[:-1], [False])).astype(np.int64) if len(at) else np.zeros(0, np.int64)
    ends = np.cumsum(size + blank)
    _, offsets, data = joined.buffers()
    offsets, data = np.frombuffer(offsets, np.int64, len(joined) + 1), np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    begin = ends - size - blank
    out[np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)] = data[np.arange(int(size.sum())) + np.repeat(offsets[at] - (np.cumsum(size) - size), size)]
    places = np.concatenate(([0], ends))[np.searchsorted(row, np.arange(table.rows + 1))].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), table.rows, [None, pa.py_buffer(places.tobytes()), pa.py_buffer(out.tobytes())])


def _slice_runs(part: pa.Array, least_words: int, repeats: int) -> list[pa.Array]:
    """n_words, runs and collapsed text of each row of a slice."""
    table = W.split(part)
    rank, joined = word_ranks(table)
    start, length, period = runs_in(table.first, table.row, rank, least_words, repeats)
    edge = np.zeros(len(rank) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    kept = np.cumsum(edge[:-1]) == 0
    row = table.row[start]
    runs = pa.StructArray.from_arrays([pa.array(start - table.first[row]), pa.array(length), pa.array(period)], ["start", "length", "period"])
    listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(part) + 1)), pa.int32()), runs)
    return [pa.array(np.diff(table.first).astype(np.int64)), listed, _collapsed(table, joined, kept).cast(pa.string())]


def periodic_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_words: int = 6, repeats: int = 4) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and period) and collapsed (the words that no run
    holds after its first period, joined by one blank) of every row. repeats is 3 or more, so that a seed is as long as its lag."""
    if repeats < 3 or least_words < 2:
        raise ValueError("repeats is at least 3 and least_words at least 2")

    def find(batches):
        for batch in batches:
            for at, part in W.slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), *_slice_runs(part, least_words, repeats)],
                                                 ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string(f"n_words long, runs {RUNS}, collapsed string").fields])
    with arrow_rows(docs.sparkSession, 2000):
        return rows.mapInArrow(find, schema)


def with_planted_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, every tenth by the CRC-32 of its id with a periodic tail: its words from word a on repeat the p words from there.

    With h = crc32(decimal id), g = floor(h / 10) and n words: a = g mod n and p = 1 + floor((n - a) / (3 + g mod 8)). All other
    texts, and those of null ids, stay as they are.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        both = F.struct(words.alias("w"), a.alias("a"), p.alias("p"), n.alias("n"))
        tail = lambda x: F.transform(F.sequence(F.lit(0), x["n"] - x["a"] - 1), lambda k: F.get(x["w"], x["a"] + F.pmod(k, x["p"])))
        return F.when(n > 0, let(both, lambda x: F.array_join(F.concat(F.slice(x["w"], 1, x["a"]), tail(x)), " "))).otherwise(F.col(text))

    return docs.withColumn(text, F.when(h % 10 == 0, let(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)), planted)).otherwise(F.col(text)))


def longest_by_exponent(runs: Column) -> Column:
    """The run of greatest length / period, exactly; ties: least start, then least period. Null for no runs."""
    better = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]  # runs are by start and period, so the first of equals stays
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, F.lit(0)),
                       lambda best, r: F.when(better(r, best), r).otherwise(best))


def runs_report(docs: DataFrame) -> DataFrame:
    """A row for each document: counts, the run of greatest exponent, and digests of the runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = F.col("best")
    return periodic_runs(with_planted_runs(docs)).withColumn("best", longest_by_exponent(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
