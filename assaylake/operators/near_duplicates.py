"""A3 near duplicates from 64-bit perceptual hashes (`path, hash`; a null hash is a skipped file).

Files with one hash form a group. Pairs are reported between groups with their file counts, and every
file points at its group, so a group of copies stays linear in its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import connected_components
from .hamming import BUCKET_ROWS, hamming_links, hamming_pairs

THRESHOLD = 8


def hash_groups(files: DataFrame) -> DataFrame:
    return (files.where("hash is not null").groupBy("hash")
            .agg(F.count(F.lit(1)).alias("file_count"), F.min("path").alias("representative")))


def near_duplicate_pairs(files: DataFrame, threshold: int = THRESHOLD, *,
                         bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A3.3 group pairs within the threshold, equal-hash groups included at distance 0.

    `file_pairs` is the number of file pairs the row stands for.
    """
    groups = cut_lineage(hash_groups(files))  # read four times
    pairs = hamming_pairs(groups, threshold, bucket_rows=bucket_rows)
    a = groups.select(F.col("hash").alias("hash_a"), F.col("file_count").alias("files_a"), F.col("representative").alias("file_a"))
    b = groups.select(F.col("hash").alias("hash_b"), F.col("file_count").alias("files_b"), F.col("representative").alias("file_b"))
    # merged: packed paths in a file look small enough for a broadcast, which the driver would have to hold
    across = (pairs.join(a.hint("merge"), "hash_a").join(b.hint("merge"), "hash_b")
              .withColumn("file_pairs", F.col("files_a") * F.col("files_b")))
    within = groups.where("file_count > 1").select(
        F.col("hash").alias("hash_a"), F.col("hash").alias("hash_b"), F.lit(0).alias("hamming_distance"),
        F.col("file_count").alias("files_a"), F.col("file_count").alias("files_b"),
        F.col("representative").alias("file_a"), F.col("representative").alias("file_b"),
        F.expr("file_count * (file_count - 1) div 2").alias("file_pairs"))
    return across.unionByName(within)


def near_duplicate_members(files: DataFrame) -> DataFrame:
    """Each hashed file with its group key; `hash` joins to either side of the pairs."""
    return files.where("hash is not null").select("path", "hash")


def near_duplicate_report(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """A3.4 files discovered, hashed and skipped, and the file-pair count."""
    counts = files.agg(F.count(F.lit(1)).alias("images_discovered"), F.count("hash").alias("images_hashed"),
                       F.count_if(F.col("hash").isNull()).alias("images_skipped"))
    total = pairs.agg(F.coalesce(F.sum("file_pairs"), F.lit(0)).cast("long").alias("near_duplicate_pair_count"))
    return counts.withColumn("near_duplicate_pair_count", total.scalar())


def near_duplicate_groups(files: DataFrame, *, threshold: int = THRESHOLD, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Groups of files linked by equal or close hashes: `group_hash` (the least of the group), `hash_count, file_count, first_path`.

    A file is in one group at most, and a group of any density costs as many links as hashes; pairs come from
    `near_duplicate_pairs` on request. `files` is `path, hash`, null where there is no hash.
    """
    counts = cut_lineage(files.where("hash is not null").groupBy("hash").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("path")))
    linked = connected_components(hamming_links(counts, threshold, bucket_rows=bucket_rows), "hash_a", "hash_b")
    grouped = counts.join(linked.withColumnRenamed("node", "hash").hint("merge"), "hash", "left").withColumn("group_hash", F.coalesce("component", "hash"))
    return grouped.groupBy("group_hash").agg(
        F.count(F.lit(1)).alias("hash_count"), F.sum("files").alias("file_count"), F.min("path").alias("first_path")).where("file_count > 1")
