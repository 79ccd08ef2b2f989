from pyspark.sql import functions as F

from assaylake.operators import chain as ch
from assaylake.streaming import monitors
from test_records import _rows


def _run(df, name, mode="append"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return df.sparkSession.sql(f"SELECT * FROM {name}")


def test_stream_links_match_the_batch_check(spark, tmp_path):
    chain = ch.build_chain(_rows(spark, 2, 8), ch.PROVENANCE).withColumn("model_id", F.when(F.col("pos") == 3, "x").otherwise(F.col("model_id")))
    for part in (chain.where("pos < 4"), chain.where("pos >= 4")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(chain.schema).option("maxFilesPerTrigger", "10").parquet(str(tmp_path / "in"))
    got = {(r["chain_id"], r["pos"], r["issue_type"]) for r in _run(monitors.stream_chain_links(source, ch.PROVENANCE), "links").collect()}
    assert got == {("c0", 3, "record_tampering"), ("c1", 3, "record_tampering")}


def test_stream_replays_and_windows(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("string").alias("record_hash"), F.lit("n").alias("nonce"), F.col("id").alias("sequence"),
                           F.timestamp_seconds(F.col("id") * 86400).alias("ts"), (F.col("id") / 10).alias("brightness")).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("3", "x", 5)], "record_hash string, nonce string, sequence long")
    assert {r["record_hash"] for r in _run(monitors.stream_replays(source, known), "replays").collect()} == {"3", "5"}
    rows = _run(monitors.stream_shift(source, "brightness", 0.5), "windows", "complete").collect()
    assert len(rows) == 10 and sum(r["shifted"] for r in rows) == 9
