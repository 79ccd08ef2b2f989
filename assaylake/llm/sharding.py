"""Two-pass external shuffle into shards, in DataFrame functions only.

Pass 1 scatters: every record gets 64 seeded random bits from its row number, never from its content, so equal records
spread like different ones, and is written. Their range is cut into as many equal buckets as the written bytes fill at
`bucket_bytes` each. Pass 2 shuffles each bucket in memory (`shuffle` is a Fisher-Yates shuffle) and numbers it; buckets
follow each other, so a record's place in the permutation is its bucket's offset (a prefix sum of one count for each
bucket) plus its place there. Shard = place mod shards, slot = place div shards: the `rows` law, shard counts differ by
one at most.

A bucket is one task, and its order and places are made together in that task, so a task run again after a lost
executor gives its bucket a whole order again; write the result before using it twice.

Defined cases: null texts count as no bytes; repeated rows are separate records; null ids are carried through; an empty
table gives no row; a single record larger than a bucket is a bucket of its own size.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged, with_uid

#: A record takes this many bytes beside its text.
OVERHEAD = 64


def _bucket(buckets: int) -> Column:
    """Equal ranges of the scattered bits (non-negative longs)."""
    return F.floor(F.col("bits") / F.lit(2.0 ** 63) * buckets).cast("int")


def permuted(docs: DataFrame, size: Column, seed: int = 7, bucket_bytes: int = 8 << 20) -> DataFrame:
    """doc (struct of the whole row), size and place: the position of the row in one random permutation of all rows."""
    spark = docs.sparkSession
    rows = staged(with_uid(docs, size=size).withColumn("bits", F.xxhash64(F.lit(seed), "uid").bitwiseAND(F.lit((1 << 63) - 1))), "scattered")
    total = rows.agg(F.sum(F.col("size") + OVERHEAD)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    rows = rows.withColumn("bucket", F.least(_bucket(buckets), F.lit(buckets - 1)))
    counts = sorted(tuple(r) for r in rows.groupBy("bucket").agg(F.count("*")).collect())  # one count for each bucket
    base = spark.createDataFrame([(b, s) for (b, _), s in zip(counts, itertools.accumulate([0, *(n for _, n in counts)]))], "bucket int, base long")
    records = F.array_sort(F.collect_list(F.struct("uid", "size", "doc")))  # one order, whatever the order of arrival
    shuffled = rows.groupBy("bucket").agg(F.shuffle(records, F.lit(seed)).alias("records"))
    return (shuffled.join(F.broadcast(base), "bucket").select("base", F.posexplode("records").alias("pos", "record"))
            .select("record.doc", "record.size", (F.col("base") + F.col("pos")).alias("place")))


def sharded(docs: DataFrame, *, text: str = "text", shards: int = 16, seed: int = 7, bucket_bytes: int = 8 << 20) -> DataFrame:
    """doc, size (UTF-8 bytes of the text plus 1), shard and slot (gapless from 0 in each shard)."""
    size = F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long") + 1
    return permuted(docs, size, seed, bucket_bytes).select(
        "doc", "size", (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """The documents as Parquet, a folder for each shard; inside a shard `slot` gives the order."""
    rows = sharded(docs, **options)
    rows.select("shard", "slot", "doc.*").write.partitionBy("shard").parquet(path)


def sharding_report(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    rows = sharded(docs.select(doc_id, "text"))
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    return rows.select(F.col(f"doc.{doc_id}").alias("doc_id"), "size", F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
                       "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
