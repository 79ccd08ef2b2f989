"""Near-duplicate documents by BagMinHash over multisets of five-word shingles.

Pass 1 gives every document a key of its word sequence (equal keys are exact copies and go on as one) and a
BagMinHash signature of its shingle multiset: for every shingle a Poisson process runs over each doubling range of its
discretised weight (1, 2, 3-4, 5-8, ...) with the range's length as rate; a point has a time, a weight level and a slot,
counts if the level is not above the shingle's weight, and a slot keeps its earliest point. Two multisets agree in a
slot with probability of their weighted Jaccard similarity. A document stops once its latest slot is earlier than its
next points, so a shingle costs little more than one point.

Slots are banded. Members of a bucket meet its hub, the document that meets most others. Buckets that still hold several
classes are then compared in full, in blocks of bounded size inside tasks: pairs whose sketches (a byte of each slot)
agree well enough and that no link connects yet. Every link is verified by exact multiset overlap. So a group of copies
is never paired as a whole, pairs leave no task, and no link that would join two classes is left out. Classes are
contracted by alternating star steps.

Words are `[^\\x20\\x09-\\x0D]+` in lower case. Defined cases: null and empty texts have no words and are copies of each
other; a text of fewer than five words is one shingle; repeated rows and ids are rows of one class; an empty table
gives no row; columns of any name pass through in `doc`. Ties are decided by row number.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .staging import arrow_rows, settled, staged

SHINGLE = 5
@dataclass(frozen=True)
class Bands:
    similarity: float = 0.8
    bands: int = 25
    rows: int = 5

    @property
    def slots(self) -> int:
        return self.bands * self.rows

    @property
    def least_agreement(self) -> float:
        """Sketches of similar texts agree in this share of slots or more, but for one pair in 30,000 at the threshold itself."""
        return self.similarity - 4 * (self.similarity * (1 - self.similarity) / self.slots) ** 0.5


def shingle_bag(table: W.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every shingle, repeats included; a row of one to four words has one shingle of all of them."""
    found, at = W.shingles(table, SHINGLE, hashes)
    row = table.row[at]
    size = np.diff(table.first)
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    if len(short):
        place = (np.arange(len(hashes)) - table.first[table.row]).astype(np.uint64)
        ends = np.concatenate(([np.uint64(0)], np.cumsum(W.mix(hashes + place), dtype=np.uint64)))
        summed = ends[table.first[short + 1]] - ends[table.first[short]]
        found, row = np.concatenate((found, W.mix(summed))), np.concatenate((row, short))
        order = np.argsort(row, kind="stable")
        found, row = found[order], row[order]
    return found, row


def weighted(found: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, row, weight) in order of the rows."""
    order = np.argsort((row.astype(np.uint64) << np.uint64(48)) | (found >> np.uint64(16)), kind="stable")
    found, row = found[order], row[order]
    new = np.concatenate(([True], (found[1:] != found[:-1]) | (row[1:] != row[:-1]))) if len(found) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return found[at], row[at], np.diff(np.append(at, len(found)))


def bag_minhash(found: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, slots: int) -> np.ndarray:
    """rows x slots earliest times, infinite where a row has no shingle."""
    # one process for each shingle and doubling range (0,1], (1,2], (2,4], ... of weights up to its own
    ranges = np.ceil(np.log2(np.maximum(1, weight))).astype(np.int64) + 1
    own = np.repeat(np.arange(len(found)), ranges)
    level = np.arange(len(own)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
    seed, doc, most = W.mix(found[own] + level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), row[own], weight[own]
    base = np.where(level == 0, 0, 1 << np.maximum(0, level - 1))  # the range is (base, base + rate]
    rate = np.where(level == 0, 1, 1 << np.maximum(0, level - 1)).astype(float)
    times = np.full(rows * slots, np.inf)
    now, step = np.zeros(len(own)), 0
    while len(own):
        n = int(np.clip(4096 // len(own), 1, 64))
        counter = np.arange(step + 1, step + n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bits = W.mix(seed[:, None] + counter)
        gaps = -np.log(((bits >> np.uint64(11)).astype(float) + 1) * 2.0 ** -53) / rate[:, None]
        at = np.add.accumulate(np.column_stack((now, gaps)), axis=1)[:, 1:]
        more = W.mix(bits ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        slot = (more >> np.uint64(32)) % np.uint64(slots)
        reached = base[:, None] + np.floor((more & np.uint64(0xFFFFFFFF)).astype(float) * 2.0 ** -32 * rate[:, None]) + 1
        good = reached <= most[:, None]
        np.minimum.at(times, (doc[:, None] * slots + slot.astype(np.int64))[good], at[good])
        now, step = at[:, -1], step + n
        going = now < times.reshape(rows, slots).max(1)[doc]
        seed, doc, most, base, rate, now, own = seed[going], doc[going], most[going], base[going], rate[going], now[going], own[going]
    return times.reshape(rows, slots)


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(W.text_column(column))


def signed(docs: DataFrame, text: str, bands: Bands) -> DataFrame:
    """doc, uid, bytes (of the text), key (of the word sequence), sketch (a byte of each slot) and buckets (a hash for each band); staged."""
    def sign(batches):
        for batch in batches:
            keys, sketches, buckets = [], [], []
            for _, part in W.slices(_lower(batch.column("doc").field(place))):
                table = W.split(part)
                hashes = table.hashes()
                keys += [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(table.first[:-1], table.first[1:])]
                times = bag_minhash(*weighted(*shingle_bag(table, hashes)), len(part), bands.slots).view(np.uint64)
                grouped = times.reshape(len(part), bands.bands, bands.rows)
                value = np.zeros((len(part), bands.bands), np.uint64)
                for k in range(bands.rows):
                    value = W.mix(value + grouped[:, :, k])
                sketches += [x.tobytes() for x in (W.mix(times) & np.uint64(255)).astype(np.uint8)]
                some = np.diff(table.first) > 0
                offsets = np.concatenate(([0], np.cumsum(some * bands.bands))).astype(np.int32)
                buckets.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[some].reshape(-1).view(np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()),
                                              pa.concat_arrays(buckets) if buckets else pa.array([], pa.list_(pa.int64()))],
                                             ["doc", "key", "sketch", "buckets"])

    rows, place = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc")), docs.columns.index(text)
    schema = T.StructType([rows.schema["doc"], T.StructField("key", T.BinaryType()), T.StructField("sketch", T.BinaryType()),
                           T.StructField("buckets", T.ArrayType(T.LongType()))])
    with arrow_rows(docs.sparkSession, 500):
        more = {"uid": F.monotonically_increasing_id(), "bytes": F.coalesce(F.octet_length(F.col("doc")[text]), F.lit(0)).cast("long")}
        return staged(rows.mapInArrow(sign, schema).withColumns(more), "signed", "zstd")


def _pair_slices(left: pa.Array, right: pa.Array):
    size = pc.add(pc.binary_length(left), pc.binary_length(right)).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < len(left):
        to = max(at + 1, min(at + W.SLICE_ROWS, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + W.SLICE_BYTES, "right"))))
        yield left.slice(at, to - at), right.slice(at, to - at)
        at = to


def multiset_similarity(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of each pair of texts."""
    out = []
    for a, b in _pair_slices(_lower(left), _lower(right)):
        n, sides = len(a), []
        for side in (a, b):
            table = W.split(side)
            found, row, weight = weighted(*shingle_bag(table, table.hashes()))
            key = W.in_row(found, row)
            order = np.argsort(key)
            sides.append((key[order], row[order], weight[order]))
        (key, row, weight), (other, other_row, other_weight) = sides
        at = np.minimum(np.searchsorted(other, key), max(0, len(other) - 1))
        same = other[at] == key if len(other) else np.zeros(len(key), bool)
        shared = W.count_per(n, row[same], np.minimum(weight[same], other_weight[at[same]]))
        total = W.count_per(n, row, weight) + W.count_per(n, other_row, other_weight)
        out.append(np.where(total == 0, 1.0, shared / np.maximum(1, total - shared)))
    return np.concatenate([*out, np.zeros(0)])


def verified(pairs: DataFrame, texts: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (uid, other) whose similarity reaches the threshold; staged. Texts are sent only for pairs with close sketches."""
    def pick(batch, kept):
        return pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(kept)) for c in ("uid", "other")], ["uid", "other"])

    def likely(batches):
        for batch in batches:
            yield pick(batch, _agreement(*(_sketches(batch.column(c), bands.slots) for c in ("left", "right"))) >= bands.least_agreement)

    def compare(batches):
        for batch in batches:
            yield pick(batch, multiset_similarity(batch.column("left"), batch.column("right")) >= bands.similarity)

    def both(found: DataFrame, column: str) -> DataFrame:
        return (found.join(texts.select("uid", F.col(column).alias("left")), "uid")
                .join(texts.select(F.col("uid").alias("other"), F.col(column).alias("right")), "other").select("uid", "other", "left", "right"))

    close = both(pairs, "sketch").mapInArrow(likely, "uid long, other long")
    with arrow_rows(pairs.sparkSession, 500):
        return staged(both(close, "text").mapInArrow(compare, "uid long, other long"), "links")


def _sketches(column: pa.Array, slots: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, slots)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(-1)


def _hub_pairs(shared: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's hub: the one that meets most others over all its buckets."""
    popular = shared.groupBy("uid").agg(F.sum("n").alias("met"))
    order = F.shiftleft(F.col("met"), 20).bitwiseOR(F.xxhash64("uid").bitwiseAND(F.lit((1 << 20) - 1)))
    ranked = shared.join(popular.select("uid", order.alias("rank")), "uid")
    hubs = staged(ranked.groupBy("band", "bucket").agg(F.max_by("uid", "rank").alias("hub")), "hubs")
    return _once(shared.join(hubs, ["band", "bucket"]).select("uid", F.col("hub").alias("other")))


def _once(pairs: DataFrame) -> DataFrame:
    return pairs.where("uid <> other").select(F.greatest("uid", "other").alias("uid"), F.least("uid", "other").alias("other")).distinct()


def _bag_of(texts: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and their weights, of one (lower-case) text."""
    table = W.split(texts.slice(row, 1))
    found, _, weight = weighted(*shingle_bag(table, table.hashes()))
    order = np.argsort(found)
    return found[order], weight[order]


def _bag_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    (found, weight), (other, other_weight) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    at = np.minimum(np.searchsorted(other, found), len(other) - 1)
    same = other[at] == found
    shared = np.minimum(weight[same], other_weight[at[same]]).sum()
    return shared / (weight.sum() + other_weight.sum() - shared)


class _Block:
    """Rows of one pair of blocks of a bucket, and which of them are worth comparing."""

    def __init__(self, table: pa.Table, bands: Bands):
        self.table, self.bands = table.combine_chunks(), bands
        self.uid, self.label, self.own = (self.table[c].to_numpy().copy() for c in ("uid", "label", "own"))
        self.across = self.table["i"][0].as_py() != self.table["j"][0].as_py()
        self.sketch = _sketches(self.table["sketch"].combine_chunks(), bands.slots)
        own = self.table["buckets"].combine_chunks().flatten().to_numpy().reshape(len(self.uid), bands.bands)
        self.earlier = own[:, :self.table["band"][0].as_py()]

    def partners(self, r: int) -> np.ndarray:
        """Later rows of another class whose sketch agrees with row r's, in the first band that puts the two together."""
        agree = _agreement(self.sketch[r], self.sketch[r + 1:])
        near = (agree >= self.bands.least_agreement) & (self.label[r + 1:] != self.label[r])
        if self.across:
            near &= self.own[r + 1:] != self.own[r]
        at = np.flatnonzero(near)
        at = at[~(self.earlier[at + r + 1] == self.earlier[r]).any(1)]
        return at[np.argsort(-agree[at], kind="stable")] + r + 1


def _worth(table: pa.Table, bands: Bands) -> pa.Table:
    """The rows that have a partner."""
    block = _Block(table, bands)
    has = np.zeros(len(block.uid), bool)
    for r in range(len(has) - 1):
        found = block.partners(r)
        has[found] = True
        has[r] |= len(found) > 0
    return block.table.filter(pa.array(has))


def _joining(table: pa.Table, bands: Bands) -> pa.Table:
    """Verified links that join classes; rows that a link has made one class are not compared again."""
    block, bags, found = _Block(table, bands), {}, []
    texts, label = _lower(block.table["text"].combine_chunks()), block.label
    for r in range(len(label) - 1):
        for v in block.partners(r):
            if label[v] == label[r]:
                continue
            for x in (r, v):
                if x not in bags:
                    bags[x] = _bag_of(texts, int(x))
            if _bag_similarity(bags[r], bags[v]) >= bands.similarity:
                found.append((block.uid[r], block.uid[v]))
                label[label == label[v]] = label[r]
    return pa.table({"uid": pa.array([a for a, _ in found], pa.int64()), "other": pa.array([b for _, b in found], pa.int64())})


def _rest(shared: DataFrame, texts: DataFrame, label: DataFrame, bands: Bands, block: int, block_bytes: int) -> DataFrame:
    """Links between rows of different classes in one bucket.

    A bucket is compared in blocks of bounded rows and bytes, every block with every other, inside tasks; no pairs leave
    them but links that join classes. Sketches are compared first, so that only rows with a partner send their text.
    Buckets that are one class by now are left out, and buckets of two, which their hub has seen.
    """
    mark = shared.where("n > 2").join(label, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    mixed = mark.groupBy("band", "bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band", "bucket")
    rows = mark.join(staged(mixed, "mixed"), ["band", "bucket"]).join(texts.select("uid", "sketch", "buckets"), "uid")
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / block_bytes)).cast("int")
    rows = (rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64(F.lit(3), "uid"), F.col("blocks")).cast("int"))
            .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    rows = rows.select("band", "bucket", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "uid", "label", "sketch", "buckets")
    keys = ["band", "bucket", "i", "j"]

    def worth(table: pa.Table) -> pa.Table:
        return _worth(table, bands)

    def join(table: pa.Table) -> pa.Table:
        return _joining(table, bands)

    partnered = staged(rows.groupBy(*keys).applyInArrow(worth, rows.schema), "partnered")
    with_text = partnered.join(texts.select("uid", "text"), "uid")
    return staged(with_text.groupBy(*keys).applyInArrow(join, "uid long, other long"), "links")


def near_classes(rows: DataFrame, text: str, bands: Bands, *, block: int = 2048, block_bytes: int = 4 << 20) -> DataFrame:
    """uid and label (the least uid of its class) of every linked row. rows: uid, text column in doc, sketch, buckets; distinct texts.

    First every member of a bucket meets its hub; then buckets that still hold several classes are compared in full.
    """
    return settled(rows.sparkSession, lambda: _near_classes(rows, text, bands, block, block_bytes))


def _near_classes(rows: DataFrame, text: str, bands: Bands, block: int, block_bytes: int) -> DataFrame:
    members = rows.select("uid", "bytes", F.posexplode("buckets").alias("band", "bucket"))
    sizes = staged(members.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where("n > 1"), "sizes")
    shared = staged(members.drop("bytes").join(sizes, ["band", "bucket"]), "shared")
    texts = staged(rows.select("uid", "sketch", "buckets", F.col(f"doc.{text}").alias("text"))
                   .join(shared.select("uid").distinct().hint("merge"), "uid", "left_semi"), "texts", "zstd")  # grows: never broadcast
    found = verified(staged(_hub_pairs(shared), "pairs"), texts, bands)
    return classes(found.unionByName(_rest(shared, texts, classes(found), bands, block, block_bytes)))


def classes(edges: DataFrame) -> DataFrame:
    """uid and label (the least uid of its class) of every linked row, by alternating large-star and small-star steps."""
    return settled(edges.sparkSession, lambda: _contracted(edges))


def _contracted(edges: DataFrame) -> DataFrame:
    edges = staged(edges.select(F.greatest("uid", "other").alias("u"), F.least("uid", "other").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = staged(small.select("e.*").where("u <> v").distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("uid"), F.col("v").alias("label"))
        before = state


def _labelled(rows: DataFrame, text: str, doc_id: str | None, bands: Bands) -> DataFrame:
    """key, label (uid of the document that stays), class size and least id of each distinct word sequence; staged."""
    return settled(rows.sparkSession, lambda: _labels(rows, text, doc_id, bands))


def _labels(rows: DataFrame, text: str, doc_id: str | None, bands: Bands) -> DataFrame:
    ids = [F.min(f"doc.{doc_id}").alias("id")] if doc_id else []
    copies = staged(rows.groupBy("key").agg(F.min("uid").alias("uid"), F.count("*").alias("n"), *ids), "copies")
    distinct = rows.join(copies.select("uid"), "uid", "left_semi")
    label = near_classes(distinct, text, bands)
    labelled = copies.join(label, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    groups = labelled.groupBy("label").agg(F.sum("n").alias("class_size"), *([F.min("id").alias("class_id")] if doc_id else []))
    return staged(labelled.join(groups, "label").drop("n", "id"), "labelled")


def near_copy_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """A row for each document: its id, class_id (least id of the class), class_size, and kept for the one that stays."""
    rows = signed(docs.select(*dict.fromkeys((doc_id, text))), text, bands)
    labelled = _labelled(rows, text, doc_id, bands)
    return rows.select("uid", "key", F.col(f"doc.{doc_id}").alias("doc_id")).join(labelled.drop("uid"), "key").select(
        "doc_id", "class_id", "class_size", (F.col("uid") == F.col("label")).alias("kept"))


def without_near_copies(docs: DataFrame, *, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One document of each class (the first by row), columns as given."""
    rows = signed(docs, text, bands)
    labelled = _labelled(rows, text, None, bands)
    kept = labelled.select(F.col("label").alias("uid")).distinct()  # grows with the documents: never broadcast
    return rows.join(kept.hint("merge"), "uid", "left_semi").select("doc.*")
