"""What the Hamming joins put on the driver and how they treat buckets beyond every limit."""

import random

import pytest
from pyspark.sql import functions as F

from assaylake.operators import hamming, keyed, near_duplicates


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hashes_under_every_mask_are_not_broadcast(spark):
    files = spark.range(3000).select(F.xxhash64("id").alias("hash"), F.col("id").cast("string").alias("path"))
    assert "Broadcast" not in _plan(hamming.hamming_pairs(files, 8))
    assert "Broadcast" not in _plan(near_duplicates.near_duplicate_pairs(files))


def test_a_lookup_of_many_keys_is_merged(spark, monkeypatch):
    monkeypatch.setattr(keyed, "MERGED_KEYS", 10)
    stats = spark.range(20).select(F.col("id").alias("k"), F.lit(2).alias("n"), (F.col("id") * 3).alias("v"))
    rows = spark.range(40).select((F.col("id") % 25).alias("k"), "id")
    looked = keyed.lookup_by_key(rows, stats, ["k"], size="n")
    assert "SortMergeJoin" in _plan(looked)
    assert {(r["id"], r["v"]) for r in looked.collect()} == {(i, i % 25 * 3 if i % 25 < 20 else None) for i in range(40)}


@pytest.mark.parametrize("bucket_rows,refine_rounds", [(1, 0), (2, 1), (3, 2)])
def test_hot_buckets_lose_no_pair_and_no_link(spark, bucket_rows, refine_rounds):
    rng = random.Random(bucket_rows)
    base = rng.getrandbits(64)
    hashes = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.getrandbits(6) << 20) for _ in range(220)}
    hashes = sorted(h - (1 << 64) if h >> 63 else h for h in hashes)
    near = {(a, b, (a ^ b).bit_count() if a ^ b >= 0 else ((a ^ b) & (1 << 64) - 1).bit_count()) for a in hashes for b in hashes if a < b}
    near = {p for p in near if p[2] <= 4}
    df = spark.createDataFrame([(h,) for h in hashes], "hash long")
    found = hamming.hamming_pairs(df, 4, bucket_rows=bucket_rows, refine_rounds=refine_rounds).collect()
    assert len(found) == len(near) and {tuple(r) for r in found} == near
    root = {h: h for h in hashes}

    def top(h):
        while root[h] != h:
            h = root[h]
        return h

    links = {(r["hash_a"], r["hash_b"]) for r in hamming.hamming_links(df, 4, bucket_rows=bucket_rows, join_rows=2).collect()}
    assert links <= {p[:2] for p in near}
    for a, b in links:
        root[top(a)] = top(b)
    assert all(top(a) == top(b) for a, b, _ in near)
