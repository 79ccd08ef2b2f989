"""The rows law: even counts, gapless slots, every record once."""

import zlib
from collections import Counter

import cases
from assaylake.llm import sharding


def test_rows_law(spark):
    texts = cases.TEXTS + [(500, "same text in a third of all rows")] * 300 + [(1000 + i, f"text {i}") for i in range(600)]
    found = sharding.sharding_report(cases.documents(spark, texts)).collect()
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in found) == sorted(
        (repr(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    slots = {s: sorted(r["slot"] for r in found if r["shard"] == s) for s in range(16)}
    counts = [len(x) for x in slots.values()]
    assert max(counts) - min(counts) <= 1 and all(x == list(range(len(x))) for x in slots.values())
    assert {r["law"] for r in found} == {"rows"} and {r["grown_shard"] for r in found} == {None}


def test_order_is_shuffled_over_many_buckets(spark):
    texts = [(i, "x" * 100) for i in range(2000)]
    placed = sharding.permuted(cases.documents(spark, texts), size=sharding.F.lit(100), bucket_bytes=20_000)
    order = [r["i"] for r in placed.select("place", sharding.F.col("doc.doc_id").alias("i")).orderBy("place").collect()]
    assert sorted(order) == list(range(2000))
    assert sum(a + 1 == b for a, b in zip(order, order[1:])) < 20
    assert max(Counter(i // 200 for i in order[:200]).values()) < 60  # the first tenth comes from everywhere


def test_written_shards(spark, tmp_path):
    docs = cases.documents(spark)
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert cases.rows(back, "doc_id", "text") == cases.rows(docs, "doc_id", "text")
    assert sharding.sharding_report(cases.empty(spark)).count() == 0
