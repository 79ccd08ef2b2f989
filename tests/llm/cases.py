"""Awkward documents every operator must take: nulls, empty and very long texts, repeated rows, clashing column names."""

from pyspark.sql import functions as F

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, uid long, doc string, key string, part int, bucket int, "
          "score double, kept boolean, spans string, quality double, `band` int")
LONG = " ".join(f"word{i % 977}x{i % 31} sentence." for i in range(30_000))
TEXTS = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "two words"), (5, LONG), (6, LONG), (7, LONG.replace("word5x", "changed5x")),
    (8, "The mail is ann.lee@mail.example.com and the phone is +1 (212) 555-0134 today, call before noon please and bring the forms."),
    (8, "The mail is ann.lee@mail.example.com and the phone is +1 (212) 555-0134 today, call before noon please and bring the forms."),
    (9, "Ünïcödé 日本語 текст — “quotes” é́ \U0001F600 token = \"0641917ea4e9feb9cda83477b57ac2654884f485\" end"),
    (None, "a row without an id but with a text of some words in it"), (None, None), (10, "\u0000control\u0001 chars \r\n and | pipes | # % &"),
]


def documents(spark, texts=TEXTS, lang="en"):
    rows = [(i, t, lang, "src", None if t is None else len(t), 1, "x", "k", 2, 3, 0.5, False, "s", 0.1, 4) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return documents(spark, [])


def rows(df, *order):
    found = [tuple(r) for r in df.select(*order).collect()] if order else [tuple(r) for r in df.collect()]
    return sorted(found, key=repr)


def by_id(df):
    return {r["doc_id"]: r for r in df.where(F.col("doc_id").isNotNull()).collect()}
