"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item is far shorter than the documents that may quote it, so the Jaccard similarity of the two says nothing.
Containment does: each item keeps the MinHash signature of its five-word shingles (which shingle is the minimum under
each of `permutations` hash functions), and a document that holds a share c of the item holds each minimum with
probability c. Items are partitioned by size (powers of two of their shingle count); a document is searched only
against partitions whose smallest item it could hold. Pairs whose signature estimate is within four standard
deviations of the threshold are verified on all shingles of the item.

Words are runs of letters and digits in lower case. Defined cases: null and empty texts, and texts or items of fewer
than five words, have no shingle and match nothing; equal items all match (they are searched once, and joined to the hits); repeated documents each match; null ids are
carried through; an empty benchmark marks no document. Columns of the documents are kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .staging import staged

SHINGLE = 5


@dataclass(frozen=True)
class Search:
    containment: float = 0.8
    permutations: int = 64
    #: Most values of one broadcast index; a larger benchmark is searched in several passes over the documents.
    index_values: int = 2_000_000

    def least_estimate(self) -> float:
        c = self.containment
        return max(0.0, c - 4 * (c * (1 - c) / self.permutations) ** 0.5)


def _shingle_sets(column: pa.Array):
    """(first row, distinct shingle hashes sorted by row then hash, their rows) for each slice of a text column."""
    for at, part in W.slices(pc.utf8_lower(W.text_column(column))):
        table = W.split(part, W.NOT_ALPHANUMERIC)
        hashes, first = W.shingles(table, SHINGLE)
        yield at, part, hashes, table.row[first]


def item_sketches(items: DataFrame, id_column: str, text_column: str, search: Search) -> DataFrame:
    """item (the id), n, shingles (all, sorted) and minima (the shingle that is least under each hash function)."""
    seeds = W.mix(np.arange(1, search.permutations + 1, dtype=np.uint64))

    def sketch(batches):
        for batch in batches:
            rows = {"n": [], "shingles": [], "minima": []}
            for _, part, hashes, row in _shingle_sets(batch.column("text")):
                for r in range(len(part)):
                    own = np.unique(hashes[row == r])
                    least = own[np.array([np.argmin(W.mix(own ^ s)) for s in seeds])] if len(own) else own
                    rows["n"].append(len(own))
                    rows["shingles"].append(own.view(np.int64))
                    rows["minima"].append(least.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), pa.array(rows["n"], pa.int64()), pa.array(rows["shingles"], pa.list_(pa.int64())),
                 pa.array(rows["minima"], pa.list_(pa.int64()))], ["item", "n", "shingles", "minima"])

    narrow = items.select(items[id_column].alias("item"), items[text_column].alias("text"))
    return narrow.mapInArrow(sketch, T.StructType([
        T.StructField("item", narrow.schema["item"].dataType), T.StructField("n", T.LongType()),
        T.StructField("shingles", T.ArrayType(T.LongType())), T.StructField("minima", T.ArrayType(T.LongType()))]))


class ItemIndex:
    """Signatures and shingles of some items, of bounded size, as every task needs them."""

    BITS = 22

    def __init__(self, table: pa.Table):
        order = np.argsort(table["n"].to_numpy(), kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        self.ids = table["set"].combine_chunks() if table.num_rows else pa.array([], pa.string())
        self.n = table["n"].to_numpy()
        self.partition = np.frompyfunc(lambda n: int(n).bit_length() - 1, 1, 1)(self.n).astype(np.int64)
        self.shingles = [np.asarray(x, np.int64).view(np.uint64) for x in table["shingles"].to_pylist()]
        minima = [np.asarray(x, np.int64).view(np.uint64) for x in table["minima"].to_pylist()]
        item = np.repeat(np.arange(len(minima)), [len(x) for x in minima])
        value = np.concatenate([*minima, np.zeros(0, np.uint64)])
        # a posting for each distinct (value, item) with the number of hash functions it stands for
        order = np.lexsort((item, value))
        value, item = value[order], item[order]
        new = np.concatenate(([True], (value[1:] != value[:-1]) | (item[1:] != item[:-1]))) if len(value) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        self.times = np.diff(np.append(at, len(value)))
        self.item, posted = item[at], value[at]
        self.values, start = np.unique(posted, return_index=True)
        self.start = np.append(start, len(posted))
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[(self.values >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray, row: np.ndarray, rows: int, search: Search):
        """(row, item, shingles found) of the verified pairs. hashes, row: shingles in the order of the rows."""
        near = np.flatnonzero(self.maybe[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)])
        at = np.searchsorted(self.values, hashes[near])
        hit = (at < len(self.values)) & (self.values[np.minimum(at, len(self.values) - 1)] == hashes[near])
        at, hit_row = at[hit], row[near[hit]]
        pair = np.unique(hit_row * len(self.values) + at)
        hit_row, at = np.divmod(pair, max(1, len(self.values)))
        size = W.count_per(rows, row)  # with repeats: never below the distinct count that the bound is about
        length = self.start[at + 1] - self.start[at]
        posting = np.repeat(self.start[at] - np.cumsum(length) + length, length) + np.arange(length.sum())
        who, item = np.repeat(hit_row, length), self.item[posting]
        fits = size[who] >= search.containment * (1 << self.partition[item]).astype(float)
        key, inverse = np.unique(who[fits] * len(self.n) + item[fits], return_inverse=True)
        share = np.bincount(inverse, self.times[posting][fits], len(key)) / search.permutations
        bounds = np.searchsorted(row, np.arange(rows + 1))
        for k in key[share >= search.least_estimate()]:
            r, i = divmod(int(k), len(self.n))
            found = int(np.isin(self.shingles[i], hashes[bounds[r]:bounds[r + 1]]).sum())
            if found >= search.containment * self.n[i]:
                yield r, i, found


def numbered_items(items: DataFrame, id_column: str, text_column: str, search: Search) -> DataFrame:
    """The sketches of items that have shingles, each with the name of its shingle set; staged."""
    sketches = item_sketches(items, id_column, text_column, search).where("n > 0")
    return staged(sketches.withColumn("set", F.md5(F.to_json("shingles").cast("binary"))), "items")


def _index_passes(numbered: DataFrame, search: Search):
    """The distinct shingle sets in indexes of about `index_values` values each: copies of an item are one set, however many there are."""
    sets = staged(numbered.groupBy("set").agg(*[F.first(c).alias(c) for c in ("n", "shingles", "minima")]), "item-sets")
    total = sets.agg(F.sum(F.col("n") + search.permutations)).first()[0] or 0
    passes = max(1, -(-total // search.index_values))
    for k in range(passes):
        yield sets.where(F.pmod(F.xxhash64("set"), F.lit(passes)) == k).toArrow()


def mark_leaks(docs: DataFrame, numbered: DataFrame, search: Search = Search(), *, text: str = "text") -> DataFrame:
    """doc (struct of the whole row) and leaks: array of (set, shingles, found, containment) for each shingle set of an item that it contains."""
    leak = T.StructType([T.StructField("set", T.StringType()), T.StructField("shingles", T.LongType()), T.StructField("found", T.LongType()),
                         T.StructField("containment", T.DoubleType())])
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[text].alias("text"),
                      F.array().cast(T.ArrayType(leak)).alias("leaks"))
    spark = docs.sparkSession
    for table in _index_passes(numbered, search):
        shared = spark.sparkContext.broadcast(ItemIndex(table))  # at most index_values values

        def probe(batches, shared=shared):
            index = shared.value
            for batch in batches:
                found = [[] for _ in range(batch.num_rows)]
                for at, part, hashes, row in _shingle_sets(batch.column("text")):
                    if len(index.values):
                        for r, i, n in index.find(hashes, row, len(part), search):
                            found[at + r].append((i, n))
                flat = [x for own in found for x in own]
                which = np.array([i for i, _ in flat], np.int64)
                counts = np.array([n for _, n in flat], np.int64)
                size = index.n[which] if len(flat) else np.zeros(0, np.int64)
                new = pa.StructArray.from_arrays([index.ids.take(pa.array(which)), pa.array(size, pa.int64()), pa.array(counts),
                                                  pa.array(counts / np.maximum(1, size), pa.float64())],
                                                 ["set", "shingles", "found", "containment"])
                ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("text"), batch.column("leaks"),
                                                  pa.ListArray.from_arrays(pa.array(ends), new)], ["doc", "text", "leaks", "more"])

        schema = T.StructType([*out.schema.fields, T.StructField("more", T.ArrayType(leak))])
        out = out.mapInArrow(probe, schema).select("doc", "text", F.concat("leaks", "more").alias("leaks"))
    return out.select("doc", "leaks")


def leaking_pairs(docs: DataFrame, items: DataFrame, search: Search = Search(), doc_id: str = "doc_id", *, item_id: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """A row for each (document, item) it contains. The items of a set are joined to its hits as rows."""
    numbered = numbered_items(items, item_id, item_text, search)
    found = mark_leaks(docs.select(doc_id, "text"), numbered, search).select(F.col(f"doc.{doc_id}").alias("doc_id"), F.explode("leaks").alias("leak"))
    pairs = found.select("doc_id", "leak.*").join(numbered.select("set", F.col("item").alias("item_id")), "set")
    return pairs.select("doc_id", "item_id", F.col("shingles").alias("n_shingles"), F.col("found").alias("n_found"), "containment")


def without_leaks(docs: DataFrame, items: DataFrame, search: Search = Search(), text: str = "text", *, item_id: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """The documents that contain no item, columns as given."""
    return mark_leaks(docs, numbered_items(items, item_id, item_text, search), search, text=text).where(F.size("leaks") == 0).select("doc.*")
