import hashlib
import json

import pytest
from pyspark.sql import functions as F

from assaylake.fixed_values import GENESIS_HASH
from assaylake.operators import chain as ch
from assaylake.operators import dispositions as di
from assaylake.operators import findings as fi
from assaylake.sources.tables import parse_records

# fixed record whose hash is known
KNOWN = {
    "input_digest": "da8a9e8f0072deeb1c0285337855ff16e1abb0d326f1610b6fcffbcb116da845",
    "model_id": "sha256:f00ace700c3610b5bfbd1a2ac819a472497af7e8c4117fb04a3e4420265ffa43",
    "nonce": "a73d2d17815be09e52f474db94efe8f0",
    "output_digest": "5776ff1ceb1c059bddfa36d7d46752d716117221583c453fc304d6d3709c04d8",
    "preprocessing_digest": "6a0bc450b8d652ed47996521552c4e2320ebaf5b88eac64f9b21786b9376604b",
    "previous_record_hash": GENESIS_HASH, "sequence": 1, "timestamp": "2026-10-03T04:43:17.164291+00:00",
}
KNOWN_HASH = "d4dade0fd4f65117f72d62a5e84805477fd43417f697cb78700f7dbe611db4fe"
FIELDS = "chain_id string, pos long, sequence long, nonce string, timestamp string, input_digest string, model_id string, preprocessing_digest string, output_digest string"


def _rows(spark, chains=3, length=25):
    rows = [(f"c{c}", p, p + 1, f"n{c}-{p}", f"t{p}\"é", "i", f"m\\{p}", "pp", "o") for c in range(chains) for p in range(length)]
    return spark.createDataFrame(rows, FIELDS)


def test_known_record_hash(spark):
    good, bad = parse_records(spark.createDataFrame([(json.dumps({**KNOWN, "record_hash": KNOWN_HASH}),), ('{"nonce":"x"}',)], "json string"), ch.PROVENANCE)
    row = good.select(ch.record_hash(ch.PROVENANCE).alias("h"), "record_hash").first()
    assert row["h"] == row["record_hash"] == KNOWN_HASH
    assert "record_hash" in bad.first()["missing_fields"]


@pytest.mark.parametrize("length", [25, 12_000])
def test_build_chain_equals_sequential_hashing(spark, length):
    df = _rows(spark, 3, length)
    built = {(r["chain_id"], r["pos"]): r for r in ch.build_chain(df, ch.PROVENANCE).collect()}
    assert len(built) == 3 * length
    for c in range(3):
        head = GENESIS_HASH
        for p in range(length):
            r = built[(f"c{c}", p)]
            assert r["previous_record_hash"] == head
            body = {f: r[f] for f in (*ch.PROVENANCE.fields, "previous_record_hash")}
            head = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
            assert r["record_hash"] == head


def test_valid_chain_has_no_issues_and_each_change_is_named(spark):
    chain = ch.build_chain(_rows(spark, 1, 12), ch.PROVENANCE)
    assert ch.chain_issues(chain, ch.PROVENANCE).count() == 0
    at = F.col("pos") == 5
    kinds = lambda df, **k: {(r["issue_type"], r["pos"]) for r in ch.chain_issues(df, ch.PROVENANCE, **k).collect()}
    assert kinds(chain.withColumn("model_id", F.when(at, "x").otherwise(F.col("model_id")))) == {("record_tampering", 5)}
    assert kinds(chain.withColumn("previous_record_hash", F.when(at, "x").otherwise(F.col("previous_record_hash")))) == {
        ("record_tampering", 5), ("broken_chain", 5)}
    assert ("nonce_reuse", 5) in kinds(chain.withColumn("nonce", F.when(at, "nc0-4").otherwise(F.when(F.col("pos") == 4, "nc0-4").otherwise(F.col("nonce")))))
    moved = chain.withColumn("sequence", F.when(at, 5).otherwise(F.col("sequence")))
    assert {("sequence_discontinuity", 5), ("duplicate_sequence", 5)} <= kinds(moved)
    unsigned = chain.withColumn("signature", F.lit(None).cast("string"))
    assert len(kinds(unsigned, signature_valid=F.col("signature") == "ok")) == 12


def test_issues_do_not_depend_on_segments_or_hot_handling(spark):
    chain = ch.build_chain(_rows(spark, 2, 30), ch.PROVENANCE).withColumn("nonce", F.when(F.col("pos") > 3, "same").otherwise(F.col("nonce")))
    chain = chain.withColumn("record_hash", F.when(F.col("pos") == 8, "x").otherwise(F.col("record_hash")))
    a = sorted(map(tuple, ch.chain_issues(chain, ch.PROVENANCE).collect()), key=repr)
    b = sorted(map(tuple, ch.chain_issues(chain, ch.PROVENANCE, run_rows=9, hot_rows=5).collect()), key=repr)
    assert a == b and len(a) > 50


def test_append_continues_the_chain(spark):
    whole = ch.build_chain(_rows(spark, 2, 10), ch.PROVENANCE)
    first = ch.build_chain(_rows(spark, 2, 10).where("pos < 6"), ch.PROVENANCE)
    batch = _rows(spark, 2, 10).where("pos >= 6").withColumn("pos", F.col("pos") - 6).drop("sequence")
    new = ch.append_to_chain(first, batch, ch.PROVENANCE)
    key = lambda df: {(r["chain_id"], r["pos"], r["record_hash"]) for r in df.collect()}
    assert key(first) | key(new) == key(whole)


def test_replay_by_each_key(spark):
    known = spark.createDataFrame([(0, "h0", "n0", 1), (1, "h1", "n0", 2)], "index long, record_hash string, nonce string, sequence long")
    incoming = spark.createDataFrame([(1, "h1", "x", 9), (2, "y", "n0", 8), (3, "y", "x", 2), (4, "y", "x", 7)],
                                     "record_id long, record_hash string, nonce string, sequence long")
    got = {r["record_id"]: r for r in ch.replay_matches(incoming, known).collect()}
    assert [got[i]["replay_detected"] for i in (1, 2, 3, 4)] == [True, True, True, False]
    assert (got[2]["nonce_matches"], got[2]["first_nonce_index"]) == (2, 0)


def test_dispositions_bind_to_events(spark):
    batch = spark.createDataFrame(
        [("A", "F1", p, d, "", "fd", "asset", f"t{p}", f"e{p}") for p, d in enumerate(["accept", "REVIEW", "maybe", "QUARANTINE"])],
        "assessment_id string, finding_id string, pos long, disposition string, analyst_note string, finding_digest string, affected_asset string, timestamp string, event_id string")
    empty = batch.select("assessment_id", "finding_id", "pos", "disposition", "analyst_note", "timestamp", F.col("event_id").alias("audit_event_id")).limit(0)
    chain = batch.select(F.col("assessment_id").alias("chain_id"), "pos", F.lit("").alias("entry_hash")).limit(0)
    assert di.rejected_decisions(batch).where("reject_reason is not null").count() == 1
    good = batch.where("disposition <> 'maybe'").withColumn("pos", F.least("pos", F.lit(2)))
    decisions, entries = di.append_decisions(empty, chain, good)
    olds = [r["old_disposition"] for r in decisions.orderBy("pos").collect()]
    assert olds == [None, "ACCEPT", "REVIEW"]
    assert {r["binding_state"] for r in di.verify_decisions(decisions, entries).collect()} == {"bound"}
    changed = decisions.withColumn("analyst_note", F.lit("later"))
    assert {r["binding_state"] for r in di.verify_decisions(changed, entries).collect()} == {"payload_mismatch"}
    assert ch.chain_issues(entries, ch.AUDIT).count() == 0
    assert di.store_consistency(decisions, entries).first()["consistent"]


def test_finding_id_is_the_canonical_hash(spark):
    evidence = [{"type": "x", "value": 3}]
    text = json.dumps({"category": "c", "title": 't"1', "asset": "é", "evidence": evidence}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    df = spark.createDataFrame([("c", 't"1', "é", ['{"type":"x","value":3}'])], "c string, t string, a string, e array<string>")
    got = df.select(fi.finding_id(F.col("c"), F.col("t"), F.col("a"), F.col("e")).alias("id")).first()["id"]
    assert got == "C3-" + hashlib.sha256(text.encode()).hexdigest()[:12]
