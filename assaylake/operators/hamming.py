"""Exact Hamming-distance self-join over 64-bit hashes.

A pair within distance t that is split into t + j bands agrees on at least j of them, so rows are keyed
by every choice of j bands (`mask`, `hash & mask`) and only equal keys are compared, many buckets of a mask
in one task. Buckets too large for that are keyed again on their remaining bits; whatever is still large
after that is compared in bounded blocks. No candidate is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, widen

BUCKET_ROWS = 2_000
JOIN_ROWS = 64
REFINE_ROUNDS = 2
#: Rows that one task compares at once, in buckets.
PART_BUCKETS = 32
#: Pairs that a task holds before it gives them away.
HELD_PAIRS = 1 << 20
_PAIR = "hash_a long, hash_b long, hamming_distance int"
_ALL = (1 << 64) - 1


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _bands(bits: list[int], count: int) -> list[int]:
    """Split bit positions into `count` masks of nearly equal size (empty ones are left out)."""
    edges = [round(i * len(bits) / count) for i in range(count + 1)]
    masks = [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(edges, edges[1:])]
    return [m for m in masks if m]


def _masks(threshold: int, rows: int) -> list[int]:
    chosen = 1 if rows <= 1 << 13 else 2 if rows <= 1 << 19 else 3 if rows <= 1 << 24 else 4
    bands = _bands(list(range(64)), threshold + chosen)
    return [sum(choice) for choice in combinations(bands, chosen)]


def _submasks(mask: int, threshold: int) -> list[int]:
    rest = [b for b in range(64) if not mask >> b & 1]
    if len(rest) <= threshold:
        return []
    return [mask | band for band in _bands(rest, threshold + 1)]


def _close(hashes: np.ndarray, value: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with one value and hashes within the threshold: after sorting by value, each row meets the next one, the one after that ..."""
    order = np.argsort(value, kind="stable")
    hashes, value = hashes[order], value[order]
    left, step = np.arange(len(hashes)), 0
    while True:
        step += 1
        left = left[left + step < len(hashes)]
        left = left[value[left] == value[left + step]]  # equal values are neighbours, so a row that has met its last one is done
        if not len(left):
            return
        near = left[np.bitwise_count((hashes[left] ^ hashes[left + step]).view(np.uint64)) <= threshold]
        if len(near):
            yield hashes[near], hashes[near + step]


def _batches(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The pairs as `hash_a, hash_b, hamming_distance` with the lesser hash first."""
    held, rows = [], 0

    def batch() -> pa.RecordBatch:
        x, y = (np.concatenate([pair[i] for pair in held]) for i in (0, 1))
        a, b, distance = np.minimum(x, y), np.maximum(x, y), np.bitwise_count((x ^ y).view(np.uint64))
        other = a < b
        return pa.RecordBatch.from_arrays([pa.array(a[other]), pa.array(b[other]), pa.array(distance[other].astype(np.int32))],
                                          names=["hash_a", "hash_b", "hamming_distance"])

    for pair in found:
        held.append(pair)
        rows += len(pair[0])
        if rows >= HELD_PAIRS:
            yield batch()
            held, rows = [], 0
    if held:
        yield batch()


def _columns(batches: Iterator[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    table = pa.Table.from_batches(list(batches))
    return [table[name].to_numpy() for name in names]


def _keyed(distinct: DataFrame, masks: list[int]) -> DataFrame:
    """Each hash under every mask: `hash, mask, value`. Few hashes are one file, but each is there once for every mask."""
    return (widen(distinct).withColumn("mask", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])))
            .withColumn("value", F.col("hash").bitwiseAND(F.col("mask"))))


def _part(rows: int, bucket_rows: int) -> Column:
    """The values of a mask dealt into parts of about PART_BUCKETS full buckets."""
    return F.pmod(F.xxhash64("value"), F.lit(max(1, ceil(rows / (PART_BUCKETS * bucket_rows))))).cast("int")


def _hot(keyed: DataFrame, bucket_rows: int) -> DataFrame | None:
    """`mask, value, n` of the values that fill a part beyond measure; None where every part is of moderate size.

    Sizes of parts are aggregated before they are shuffled, and values are counted in crowded parts only.
    """
    parts = keyed.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * PART_BUCKETS * bucket_rows)
    crowded = cut_lineage(parts.select("mask", "part"))
    if crowded.isEmpty():
        return None
    inside = keyed.join(F.broadcast(crowded), ["mask", "part"], "left_semi")
    return cut_lineage(inside.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows))


def _compare(keyed: DataFrame, threshold: int) -> DataFrame:
    """All pairs of rows of `mask, part, value, hash` that share mask and value, a part in one task."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_close(*_columns(batches, "hash", "value"), threshold))

    return keyed.groupBy("mask", "part").applyInArrow(compare, _PAIR)


def _in_blocks(hot: DataFrame, bucket_rows: int) -> DataFrame:
    """Rows of large buckets `mask, value, hash, n` in blocks of `bucket_rows`, every block with every other: `mask, value, i, j, own, hash`."""
    blocks = F.ceil(F.col("n") / bucket_rows).cast("int")
    return (hot.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("hash"), F.col("blocks")).cast("int"))
            .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("mask", "value", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "hash"))


def _across(hashes: np.ndarray, own: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Close pairs of one block, or between two."""
    first = own == own.min()
    left, right = (hashes[first], hashes[~first]) if not first.all() else (hashes, hashes)
    for x in left:
        near = right[np.bitwise_count((right ^ x).view(np.uint64)) <= threshold]
        if len(near):
            yield np.full(len(near), x), near


def _compare_blocks(hot: DataFrame, threshold: int, bucket_rows: int) -> DataFrame:
    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, own = _columns(batches, "hash", "own")
        if key[2] == key[3] or own.min() < own.max():  # the other block may be empty
            yield from _batches(_across(hashes, own, threshold))

    return _in_blocks(hot, bucket_rows).groupBy("mask", "value", "i", "j").applyInArrow(compare, _PAIR)


def hamming_pairs(hashes: DataFrame, threshold: int, *, column: str = "hash",
                  bucket_rows: int = BUCKET_ROWS, refine_rounds: int = REFINE_ROUNDS) -> DataFrame:
    """All pairs of distinct hashes within `threshold`: `hash_a < hash_b, hamming_distance`."""
    spark = hashes.sparkSession
    distinct = cut_lineage(hashes.select(F.col(column).alias("hash")).where("hash is not null").distinct())
    rows = distinct.count()
    keyed = _keyed(distinct, _masks(threshold, rows)).withColumn("part", _part(rows, bucket_rows))
    found = []
    rounds = 0
    while True:
        values = _hot(keyed, bucket_rows)
        if values is None:
            found.append(_compare(keyed, threshold))
            break
        sized = keyed.join(F.broadcast(values), ["mask", "value"], "left")  # one value for each bucket_rows rows at most
        found.append(_compare(sized.where("n is null").drop("n"), threshold))
        hot = cut_lineage(sized.where("n is not null").drop("part"))
        hot_masks = [r[0] for r in values.select("mask").distinct().collect()]
        if rounds == refine_rounds or not hot_masks:
            found.append(_compare_blocks(hot, threshold, bucket_rows))
            break
        finer = [(m, [_signed(s) for s in _submasks(m & _ALL, threshold)]) for m in hot_masks]
        table = spark.createDataFrame(finer, "mask bigint, finer array<bigint>")
        # too few free bits to split again: every pair of the bucket is within the threshold of those bits
        table = table.withColumn("finer", F.when(F.size("finer") > 0, F.col("finer")).otherwise(F.array("mask")))
        keyed = (hot.join(F.broadcast(table), "mask")
                 .select("hash", F.explode("finer").alias("mask"))
                 .withColumn("value", F.col("hash").bitwiseAND(F.col("mask"))).distinct().withColumn("part", _part(rows, bucket_rows)))
        rounds += 1
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def _forest(hashes: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links that join the same hashes as all pairs within the threshold do: each hash that is reached scans what is not reached yet.

    In a dense bucket the first scans reach nearly everything, so little is left to compare; no more links than hashes come out.
    """
    left, links = hashes, []
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            x = reached.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= threshold  # of a signed number it would count the magnitude
            if near.any():
                found = left[near]
                links += [(int(min(x, y)), int(max(x, y))) for y in found]
                reached += list(found)
                left = left[~near]
    return links


def _links(hashes: np.ndarray, value: np.ndarray, threshold: int, join_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All close pairs of buckets of up to `join_rows` hashes, a spanning forest of each larger one."""
    _, bucket, sizes = np.unique(value, return_inverse=True, return_counts=True)
    small = sizes[bucket] <= join_rows
    yield from _close(hashes[small], value[small], threshold)
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(sizes)
    for at in np.nonzero(sizes > join_rows)[0]:
        links = _forest(hashes[order[ends[at] - sizes[at]:ends[at]]], threshold)
        if links:
            yield tuple(np.array(links, dtype=np.int64).T)


def hamming_links(hashes: DataFrame, threshold: int, *, column: str = "hash", bucket_rows: int = BUCKET_ROWS,
                  join_rows: int = JOIN_ROWS) -> DataFrame:
    """`hash_a < hash_b` links whose connected components are those of all pairs within `threshold`.

    Buckets of equal bands as in `hamming_pairs`; those of up to `join_rows` hashes are compared in full, larger ones give a
    spanning forest, those that fill a part in blocks of `bucket_rows` hashes with every block against every other. So a
    bucket of n hashes gives about n links for each block it meets, never n * n pairs.
    """
    distinct = cut_lineage(hashes.select(F.col(column).alias("hash")).where("hash is not null").distinct())
    rows = distinct.count()
    keyed = _keyed(distinct, _masks(threshold, rows)).withColumn("part", _part(rows, bucket_rows))
    values = _hot(keyed, bucket_rows)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_links(*_columns(batches, "hash", "value"), threshold, join_rows))

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = _forest(np.unique(_columns(batches, "hash")[0]), threshold)
        if links:
            yield from _batches(iter([tuple(np.array(links, dtype=np.int64).T)]))

    if values is None:
        return keyed.groupBy("mask", "part").applyInArrow(link, _PAIR).drop("hamming_distance").distinct()
    sized = keyed.join(F.broadcast(values), ["mask", "value"], "left")
    linked = sized.where("n is null").drop("n").groupBy("mask", "part").applyInArrow(link, _PAIR)
    dense = _in_blocks(sized.where("n is not null"), bucket_rows).groupBy("mask", "value", "i", "j").applyInArrow(forest, _PAIR)
    return linked.unionByName(dense).drop("hamming_distance").distinct()


def block_count(rows: int, block: int) -> int:
    return max(1, ceil(rows / block))
