"""The pipeline's stages keep columns and take effect, and its result follows from them."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import cases
import corpus_pipeline
import test_decontamination
import test_near_copies
from assaylake.llm import near_copies, packing, personal_data, quality, tokens


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    spark.createDataFrame([(1, cases.TEXTS[8][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = cases.documents(spark, cases.TEXTS + [(200 + i, " ".join(f"{w}{i}" for w in "quiet morning light over the long river bank".split() * 9)) for i in range(40)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema == docs.schema, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_run_is_the_stages_one_after_another(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = near_copies.staged(stage(spark, kept, folder), "test")
    pieces = corpus_pipeline.run(spark, folder)
    want = {(r["doc_id"], r["start"]) for r in packing.packing_report(kept).collect()}
    assert {r["doc_id"] for r in pieces.collect()} == {i for i, _ in want} and 0 < kept.count() < docs.count()


def test_run_against_plain_python(spark, tmp_path):
    """Planted copies, leaks and personal data, all columns of the result: copies, leaks, redaction and packing are done again in plain
    Python; the verdicts and the spans that learn from the corpus come from their operators over the same documents."""
    draw = random.Random(11)
    words = [f"{a}{b}" for a in ("river", "stone", "window", "garden", "letter", "music", "winter", "answer") for b in "abcdefghijklmnop"]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    plain = [text(draw.randint(80, 500)) for _ in range(60)]
    items = [text(20) for _ in range(6)]
    texts = plain + plain[:8] + [p.replace(p.split()[40], "changed", 1) for p in plain[8:14]]            # exact and near copies
    texts += [f"{text(120)} {items[k]} {text(60)}" for k in range(4)]                                    # leaks
    texts += [f"{text(90)} please write to ann.lee{k}@mail.example.com or call +1 (212) 555-013{k} today {text(30)}" for k in range(5)]
    texts += ["short", "", None, " ".join(["again and again"] * 60)]                                     # bad
    rows = list(enumerate(texts))
    folder = str(tmp_path)
    documents = cases.documents(spark, rows)
    documents.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    good = {r["doc_id"] for r in quality.quality_report(spark.read.parquet(f"{folder}/documents.parquet")).where("kept").collect()}
    assert set(range(60)) <= good and not good & {i for i, t in rows[-4:]}
    found = corpus_pipeline.run(spark, folder).collect()
    kept = {r["doc_id"] for r in found}

    classes = [set(map(int, c)) for c in test_near_copies.brute([(i, t) for i, t in rows if i in good])]
    leak = {i for i, t in rows if any(len(test_decontamination.shingles(x) & test_decontamination.shingles(t)) >= 0.8 * len(test_decontamination.shingles(x)) for x in items)}
    assert len(leak & good) == 4 and sum(len(c) > 1 for c in classes) == 14
    assert all(len(c & kept) == (0 if c & leak else 1) for c in classes) and kept <= set().union(*classes)

    spans = {r["doc_id"]: r["spans"] for r in personal_data.personal_spans(spark.read.parquet(f"{folder}/documents.parquet").where(F.col("doc_id").isin(*kept)))
             .select("doc.doc_id", "spans").collect()}
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    want = {}
    for i in kept:
        out, at = "", 0
        for s in sorted(spans[i], key=lambda s: s["start"]):
            out, at = out + texts[i][at:s["start"]] + f"[{s['kind'].upper()}]", s["end"]
        want[i] = [*tokenizer.encode(out + texts[i][at:], add_special_tokens=False).ids, 1]
    assert sum(any(s["kind"] == "email" for s in spans[i]) for i in kept) == 5

    place = 0
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert (r["sequence_id"], r["offset"]) == divmod(place, 2048) and r["doc_tokens"] == len(want[r["doc_id"]])
        own = want[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(own) == r["length"] and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
        place += r["length"]
    assert place == sum(map(len, want.values())) and sum(r["length"] for r in found) == place
