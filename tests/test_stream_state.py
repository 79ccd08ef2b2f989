"""Streams with keyed state against the batch operators."""

import time

import pytest
from pyspark.sql import functions as F

from assaylake.operators import chain as ch
from assaylake.operators import shift as sh
from assaylake.streaming import chain_state, drain, replays, shift_windows
from test_records import _rows


def _bad_chain(spark, chains=3, length=30):
    rows = ch.build_chain(_rows(spark, chains, length), ch.PROVENANCE)
    at = lambda *places: F.col("pos").isin(*places)
    return rows.withColumns({
        "model_id": F.when(at(3, 20), "other").otherwise(F.col("model_id")), "sequence": F.when(at(7), 5).otherwise(F.col("sequence")),
        "previous_record_hash": F.when(at(11), "f" * 64).otherwise(F.col("previous_record_hash")), "nonce": F.when(at(2, 15, 25), "reused").otherwise(F.col("nonce"))})


def _files(rows, folder, parts, order):
    for k in range(parts):
        rows.where(F.pmod(order, F.lit(parts)) == k).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)  # files are taken in order of their time


def _stream(spark, rows, folder):
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _start(df, folder):
    return (df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/_out")
            .trigger(processingTime="200 milliseconds").start())


def _wait(spark, folder, query, want, seconds=60):
    """The issues written so far, once they are the wanted ones or time is up."""
    end, found = time.time() + seconds, None
    while time.time() < end and found != want and query.isActive:
        time.sleep(0.5)
        if (folder / "out" / "_spark_metadata").exists():
            rows = spark.read.schema(chain_state.OUT).parquet(f"{folder}/out")
            found = sorted((r["pos"], r["issue_type"]) for r in rows.collect())
    return found


@pytest.mark.parametrize("order", ["xxhash64(pos)", "-pos"])
def test_shuffled_chains_equal_the_batch_check(spark, tmp_path, order):
    chain = _bad_chain(spark)
    signed = chain.withColumn("good", F.when(F.col("pos") % 9 != 4, F.col("pos") % 9 != 5))
    _files(signed, f"{tmp_path}/in", 4, F.expr(order))
    found = drain.drained(chain_state.stream_chain_issues(_stream(spark, signed, f"{tmp_path}/in"), ch.PROVENANCE, signature_valid=F.col("good")), tmp_path, "out")
    want = ch.chain_issues(signed, ch.PROVENANCE, signature_valid=F.col("good"))
    key = lambda df: sorted(tuple(r) for r in df.select("chain_id", "pos", "sequence", "issue_type", F.coalesce("expected_sequence", F.lit(-1)), "message").collect())
    assert key(found) == key(want) and len(key(want)) > 30


def test_gaps_are_released_by_the_timer(spark, tmp_path):
    chain = ch.build_chain(_rows(spark, 1, 12), ch.PROVENANCE)
    folder = f"{tmp_path}/in"
    chain.where("pos not in (4, 9)").coalesce(1).write.mode("append").parquet(folder)
    query = _start(chain_state.stream_chain_issues(_stream(spark, chain, folder), ch.PROVENANCE, wait_seconds=1), tmp_path)
    try:
        want = [(5, "missing_positions"), (10, "missing_positions")]
        assert _wait(spark, tmp_path, query, want) == want
        chain.where("pos in (4, 11)").coalesce(1).write.mode("append").parquet(folder)
        want = sorted([*want, (4, "repeated_position"), (11, "repeated_position")])
        assert _wait(spark, tmp_path, query, want) == want
    finally:
        query.stop()


def test_nonces_are_forgotten_after_their_time(spark, tmp_path):
    rows = _rows(spark, 1, 5).withColumn("nonce", F.when(F.col("pos").isin(0, 1, 3), "same").otherwise(F.col("nonce")))
    rows = rows.withColumn("sequence", F.when(F.col("pos") == 4, 77).otherwise(F.col("sequence")))
    chain, folder = ch.build_chain(rows, ch.PROVENANCE), f"{tmp_path}/in"
    chain.where("pos < 2").coalesce(1).write.mode("append").parquet(folder)
    query = _start(chain_state.stream_chain_issues(_stream(spark, chain, folder), ch.PROVENANCE, forget_after_seconds=2), tmp_path)
    try:
        assert _wait(spark, tmp_path, query, [(1, "nonce_reuse")]) == [(1, "nonce_reuse")]
        time.sleep(3)
        chain.where("pos >= 2").coalesce(1).write.mode("append").parquet(folder)
        want = [(1, "nonce_reuse"), (4, "sequence_discontinuity")]
        assert _wait(spark, tmp_path, query, want) == want
    finally:
        query.stop()


def test_replays_inside_the_stream_and_late_records(spark, tmp_path):
    schema = "record_id long, record_hash string, nonce string, sequence long, ts timestamp"
    batches = [[(1, "a", "n1", 1, 0), (2, "b", "n1", 2, 5), (3, "c", None, 3, 6)],   # 2 repeats the nonce of 1
               [(4, "a", "n4", 4, 8), (5, "e", "n5", 5, 200)],                        # 4 repeats the hash of 1
               [(7, "e", "n7", 1, 201)],                                              # 7 repeats the hash of 5
               [(6, "g", "n6", 6, 10), (8, "h", "n1", 8, 400)]]                       # 6 is late; the nonce of 1 again, long after it was forgotten
    folder = f"{tmp_path}/in"
    for rows in batches:
        frame = spark.createDataFrame([(i, h, n, s, m) for i, h, n, s, m in rows], "record_id long, record_hash string, nonce string, sequence long, m long")
        frame.withColumn("ts", F.timestamp_seconds(60 * (F.col("m") + 10_000))).drop("m").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    queries = replays.start_replay_streams(stream, f"{tmp_path}/out", "30 minutes")
    for q in queries:
        assert q.awaitTermination(120)
    arrivals = spark.read.parquet(f"{tmp_path}/out/arrivals")
    audit = {k: replays.replay_audit(arrivals, spark.read.parquet(f"{tmp_path}/out/kept_{k}"), k) for k in replays.KINDS}
    found = {k: sorted((r["record_id"], r["outcome"], r["first_record_id"]) for r in a.collect()) for k, a in audit.items()}
    assert found["record_hash"] == [(4, "replay", 1), (6, "late", None), (7, "replay", 5)]
    assert found["nonce"] == [(2, "replay", 1), (6, "late", None)]
    assert found["sequence"] == [(6, "late", None), (7, "replay", 1)]  # kept a little longer than the delay
    assert {(r["outcome"], r["records"]) for r in replays.audit_totals(audit["record_hash"]).collect()} == {("replay", 2), ("late", 1)}
    dropped = sum(s.numRowsDroppedByWatermark for p in queries[0].recentProgress for s in p.stateOperators)
    assert dropped == 1


def test_sliding_windows_equal_the_batch_shift(spark, tmp_path):
    hist = lambda c: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: (F.least(F.floor(F.col(c) * 16), F.lit(15)) == b).cast("double"))
    rows = spark.range(600).select(F.col("id").alias("file"), F.timestamp_seconds(F.col("id") * 900).alias("ts"),
                                   *[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000.0 * (0.4 + F.col("id") / 1000 * k)).alias(f) for k, f in enumerate(sh.SHIFT_FEATURES)])
    rows = rows.select("*", *[hist(f).alias(h) for f, h in zip(sh.SHIFT_FEATURES, sh.SHIFT_HISTOGRAMS)])
    reference = rows.where("file < 200").withColumn("population", F.lit("reference"))
    means, shares = shift_windows.reference_profile(reference)
    folder = f"{tmp_path}/in"
    for low, high in ((200, 400), (400, 600)):
        rows.where(f"file >= {low} and file < {high}").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    late = rows.where("file = 210").withColumn("brightness", F.lit(1e6))  # far behind the watermark by now
    late.coalesce(1).write.mode("append").parquet(folder)
    found = drain.drained(shift_windows.stream_overall_shift(_stream(spark, rows, folder), means, shares), tmp_path, "out")
    got = {r["start"]: r for r in found.collect()}
    assert len(got) >= 15
    for start in sorted(got)[:6]:  # the first windows, some of them with the late row's time
        r = got[start]
        own = rows.where((F.col("file") >= 200) & (F.col("ts") >= F.lit(r["start"])) & (F.col("ts") < F.lit(r["end"])))
        both = reference.unionByName(own.withColumn("population", F.lit("candidate")))
        want = sh.overall_shift(sh.feature_distances(sh.feature_summary(both)), sh.histogram_distances(sh.histogram_summary(both))).first()
        assert (r["rows"], r["shifted_feature_count"], r["severity"]) == (own.count(), want["shifted_feature_count"], want["severity"])
        assert r["overall_shift"] == pytest.approx(want["overall_shift"], abs=1e-9)
