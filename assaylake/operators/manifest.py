"""A1 manifest identity and A2 exact duplicates.

Manifest rows are `path, sha256, size_bytes`.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import canonical_json, sha256_text
from ..functions.text import path_order
from .keyed import HOT_ROWS, lookup_by_key
from .ordering import FAN_OUT, ordered_digest

MERKLE_LEVELS = 7


def manifest_from_files(files: DataFrame, root: str = "") -> DataFrame:
    """A1.1 one row per file from `path, content`, path relative to the root."""
    relative = F.regexp_replace("path", f"^.*?{root.rstrip('/')}/", "") if root else F.col("path")
    return files.select(relative.alias("path"), F.sha2("content", 256).alias("sha256"),
                        F.length("content").cast("long").alias("size_bytes"))


def dataset_digest(manifest: DataFrame, *, fan_out: int = FAN_OUT) -> DataFrame:
    """A1.2 digest of the canonical rows in path order (see tree_digest)."""
    row = canonical_json(path="path", sha256="sha256", size_bytes="size_bytes")
    return (ordered_digest(manifest, [path_order(F.col("path"))], row, fan_out=fan_out)
            .select(F.col("item_count").alias("file_count"), F.col("digest").alias("dataset_sha256")))


def _reduce_block(leaves: Column, levels: int) -> Column:
    """`levels` Merkle levels over one block; an odd level repeats its last node."""
    def level(nodes: Column, _: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / 2).cast("int") - 1)
        return F.transform(pairs, lambda i: sha256_text(
            F.concat(F.get(nodes, i * 2), F.coalesce(F.get(nodes, i * 2 + 1), F.get(nodes, i * 2)))))

    if levels == 0:
        return F.get(leaves, F.lit(0))
    return F.get(F.aggregate(F.sequence(F.lit(1), F.lit(levels)), leaves, level), F.lit(0))


def merkle_root(manifest: DataFrame, leaf: str = "sha256", *, block_levels: int = MERKLE_LEVELS) -> DataFrame:
    """A1.3 Merkle root over the sorted leaf hashes: one row (leaf_count, merkle_root).

    Equal leaves stay one (hash, count) run until blocks are cut, so a hash that fills a third of the
    leaves never gathers in one task. Blocks of 2^k aligned leaves are reduced in parallel; after
    five rounds that covers 2^35 leaves.
    """
    spark = manifest.sparkSession
    block = 1 << block_levels
    runs = manifest.groupBy(F.col(leaf).alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    total = manifest.count()
    if total == 0:
        empty = hashlib.sha256(b"").hexdigest()
        return spark.range(1).select(F.lit(0).cast("long").alias("leaf_count"), F.lit(empty).alias("merkle_root"))

    bucketed = runs.withColumn("bucket", F.substring("hash", 1, 4))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # 65,536 rows at most
    starts = (bucketed.groupBy("bucket").agg(F.sum("n").alias("bn"))
              .select("bucket", F.coalesce(F.sum("bn").over(earlier), F.lit(0)).alias("base")))
    inside = Window.partitionBy("bucket").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = (bucketed.withColumn("offset", F.coalesce(F.sum("n").over(inside), F.lit(0)))
              .join(F.broadcast(starts), "bucket")
              .select("hash", "n", (F.col("base") + F.col("offset")).alias("start")))
    last = F.col("start") + F.col("n") - 1
    pieces = (placed.withColumn("end", last)
              .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("end") / block))))
              .withColumn("first", F.greatest("start", F.col("block") * block))
              .withColumn("cnt", F.least(F.col("end"), F.col("block") * block + (block - 1)) - F.col("first") + 1))
    size = total
    nodes = pieces.select("block", F.col("first").alias("idx"), "hash", F.col("cnt").cast("int").alias("cnt"))
    while True:
        levels = block_levels if size > block else math.ceil(math.log2(size)) if size > 1 else 0
        ordered = F.array_sort(F.collect_list(F.struct("idx", "hash", "cnt")))
        leaves = F.flatten(F.transform(ordered, lambda p: F.array_repeat(p["hash"], p["cnt"])))
        reduced = nodes.groupBy("block").agg(leaves.alias("leaves")).select(
            F.col("block").alias("idx"), _reduce_block(F.col("leaves"), levels).alias("hash"))
        if size <= block:
            return reduced.select(F.lit(total).cast("long").alias("leaf_count"), F.col("hash").alias("merkle_root"))
        size = -(-size // block)
        nodes = reduced.select(F.floor(F.col("idx") / block).alias("block"), "idx", "hash", F.lit(1).alias("cnt"))


def identity_gate(expected: DataFrame, computed: DataFrame) -> DataFrame:
    """A1.4 compare assessed and selected digests by asset: `asset_id, expected_sha256 | sha256`."""
    same = F.col("expected_sha256").eqNullSafe(F.col("sha256"))
    return (expected.join(computed, "asset_id", "left")
            .select("asset_id", "expected_sha256", "sha256",
                    F.when(same, "verified").otherwise("identity_mismatch").alias("status"),
                    same.alias("downstream_enabled")))


def duplicate_groups(manifest: DataFrame) -> DataFrame:
    """A2.1 one row per content hash held by more than one file, with its first path."""
    return (manifest.groupBy("sha256").agg(F.count(F.lit(1)).alias("file_count"), F.min("path").alias("first_file"))
            .where("file_count > 1"))


def duplicate_members(manifest: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """A2.1 membership, one row per duplicated file: a group is never gathered into one value."""
    groups = manifest.groupBy("sha256").agg(F.count(F.lit(1)).alias("file_count")).where("file_count > 1")
    looked = lookup_by_key(manifest.select("path", "sha256"), groups, ["sha256"], size="file_count",
                           spread=[F.col("path")], hot_rows=hot_rows)
    return looked.where(F.col("file_count").isNotNull())


def duplicate_totals(manifest: DataFrame) -> DataFrame:
    """A2.2 group count and the number of files in any group, first copies included."""
    return duplicate_groups(manifest).agg(
        F.count(F.lit(1)).alias("duplicate_group_count"),
        F.coalesce(F.sum("file_count"), F.lit(0)).cast("long").alias("duplicate_file_count"))
