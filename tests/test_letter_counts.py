"""Letter counts of a text are made in one pass and equal those of the SQL."""

from types import SimpleNamespace

from assaylake.plans import inputs


def test_letter_counts_in_one_pass(spark):
    texts = ["", "aaeinortsl  lll", "Ünïcode ŝ rest́ 日本 a😀a\x00 e", None, "A E I \n\t"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    found = inputs.features(SimpleNamespace(documents=docs))
    assert "replace" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["image"]: r["features"] for r in found.collect()}
    for i, text in enumerate(texts):
        assert got[f"s/{i:08d}.txt"] == [None if text is None else float(text.count(c)) for c in "aeinortsl "]
