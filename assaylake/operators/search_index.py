"""Q17 search by trigrams: the different labels of a search table, and for every three characters the labels that have them.

Many rows have one label (states, users), so each text is indexed and compared once, and its rows are looked up. A needle's rarest trigrams give a few candidates, and only those are compared with the needle. Common trigrams are
never joined, so a word in a third of all labels costs nothing when the needle has a rarer part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import let
from ..session import cut_lineage, widen
from .keyed import lookup_by_key

SIZE = 3
RAREST = 3


@dataclass(frozen=True)
class SearchIndex:
    labels: DataFrame    # kind, key, label
    texts: DataFrame     # id, label, n: each label once, with its rows
    postings: DataFrame  # gram, id
    grams: DataFrame     # gram, n


def _grams(text: Column) -> Column:
    """Distinct runs of three characters."""
    def of(chars: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), F.size(chars) - SIZE), lambda i: F.concat(*[F.get(chars, i + k) for k in range(SIZE)]))
        return F.when(F.size(chars) >= SIZE, F.array_distinct(whole)).otherwise(F.array().cast("array<string>"))

    return let(F.filter(F.split(text, ""), lambda c: c != ""), of)


def build_index(rows: DataFrame) -> SearchIndex:
    """Index `kind, key, label`; null labels are never found."""
    labels = cut_lineage(rows.where("label is not null").select("kind", "key", "label"))
    counted = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    texts = cut_lineage(counted.select(F.monotonically_increasing_id().alias("id"), "label", "n"))
    postings = cut_lineage(widen(texts).select(F.explode(_grams(F.lower("label"))).alias("gram"), "id"))
    return SearchIndex(labels, texts, postings, cut_lineage(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))))


def candidates(index: SearchIndex, needle: str) -> DataFrame:
    """The texts that have the needle's rarest trigrams; all of them for a needle under three characters."""
    text = needle.lower()
    own = sorted({text[i:i + SIZE] for i in range(len(text) - SIZE + 1)})
    if not own:
        return index.texts
    found = index.grams.where(F.col("gram").isin(own)).orderBy("n", "gram").collect()  # at most as many as the needle has characters
    if len(found) < len(own):
        return index.texts.limit(0)
    ids = None
    for row in found[:RAREST]:
        having = index.postings.where(F.col("gram") == row["gram"]).select("id")
        ids = having if ids is None else ids.join(having, "id", "left_semi")
    return index.texts.join(ids, "id", "left_semi")


def search(index: SearchIndex, needle: str) -> DataFrame:
    """Case-folded substring search: `kind, key, label` of all hits."""
    hits = candidates(index, needle).where(F.contains(F.lower("label"), F.lit(needle.lower()))).select("label", "n")
    found = lookup_by_key(index.labels, hits, ["label"], size="n", spread=[F.col("kind"), F.col("key")])
    return found.where("n is not null").drop("n")


def search_cost(index: SearchIndex, needle: str) -> DataFrame:
    """One row: `needle, labels, checked, hits`; `checked` counts a text once, the others its rows."""
    hit = F.contains(F.lower("label"), F.lit(needle.lower()))
    cost = candidates(index, needle).agg(F.count(F.lit(1)).alias("checked"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("hits"))
    return cost.select(F.lit(needle).alias("needle"), index.labels.agg(F.count(F.lit(1))).scalar().alias("labels"), "checked", "hits")
