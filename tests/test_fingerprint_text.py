"""b2_fingerprint_digest on embeddings with entries halfway between two six-decimal numbers."""

import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
import compare
from assaylake.operators import fingerprint
from assaylake.plans.catalog import QUERIES


def test_entries_on_exact_halves(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, i % 10, [rng.randrange(-64, 64) / 128 for _ in range(8)]) for i in range(64)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    result = compare.compare(spark, con, str(tmp_path), "b2_fingerprint_digest", QUERIES["b2_fingerprint_digest"])
    assert result["ok"], result.get("detail")


def test_text_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(0, [0.0078125, 0.0234375, -0.0]), (1, [nan, inf, -inf]), (2, None), (3, [])], "k int, v array<float>")
    texts = [r["t"] for r in df.orderBy("k").select(fingerprint.fixed_vector_text("v").alias("t")).collect()]
    assert texts == ["0.007812,0.023438,-0.000000", "nan,inf,-inf", None, None]
