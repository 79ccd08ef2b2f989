"""What building a chain and storing decisions shuffles and derives again."""

from pyspark.sql import functions as F

from assaylake.operators import chain as ch
from assaylake.operators import dispositions as di
from assaylake.operators.ordering import previous_in_group
from test_records import _rows


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hash_texts_are_made_after_the_shuffle(spark):
    plan = _plan(ch.build_chain(_rows(spark, 2, 5), ch.PROVENANCE))
    assert "_before" in plan[:plan.index("Exchange")] and "_before" not in plan[plan.index("Exchange"):]


def test_previous_value_by_window_and_by_join(spark):
    rows = spark.createDataFrame([(i % 3, i, f"v{i}" if i % 4 else None) for i in range(40)], "k long, pos long, v string")
    want = {i: (f"v{i - 3}" if i >= 3 and (i - 3) % 4 else None) for i in range(40)}
    for window_rows in (1_000_000, 5):
        found = previous_in_group(rows, ["k"], [F.col("pos")], "v", "before", window_rows=window_rows)
        assert found.columns == ["k", "pos", "v", "before"]
        assert {r["pos"]: r["before"] for r in found.collect()} == want


def test_appended_decisions_are_linked_once_and_verified_without_broadcast(spark):
    batch = spark.createDataFrame([("a", f"f{i % 2}", i, "accept", "", "d", "x", f"t{i}", f"E{i}") for i in range(6)],
                                  "assessment_id string, finding_id string, pos long, disposition string, analyst_note string, finding_digest string, "
                                  "affected_asset string, timestamp string, event_id string")
    none = batch.select("assessment_id", "finding_id", "pos", "disposition", "analyst_note", "timestamp", F.col("event_id").alias("audit_event_id")).limit(0)
    chain = batch.select(F.col("assessment_id").alias("chain_id"), "pos", F.lit("").alias("entry_hash")).limit(0)
    decisions, entries = di.append_decisions(none, chain, batch)
    assert "InPandas" not in _plan(decisions) and "InPandas" not in _plan(entries)
    verified = di.verify_decisions(decisions, entries)
    assert "BroadcastHashJoin" not in _plan(verified)
    assert {(r["audit_event_id"], r["old_disposition"], r["binding_state"]) for r in verified.collect()} == {
        (f"E{i}", "ACCEPT" if i > 1 else None, "bound") for i in range(6)}
