"""Connected components of an edge list by alternating star steps.

Both sides of the joins grow with the edges and their files are packed, so they are merged: Spark would take them for
small and have the driver hold them for a broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
    least = both.groupBy("high").agg(F.least(F.min("low"), F.col("high")).alias("least"))
    return (both.join(least.hint("merge"), "high").where("low > high").select(F.col("low").alias("high"), F.col("least").alias("low"))
            .where("high <> low").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of those."""
    least = edges.groupBy("high").agg(F.min("low").alias("least"))
    joined = edges.join(least.hint("merge"), "high")
    links = joined.select(F.col("low").alias("high"), F.col("least").alias("low")).unionByName(
        least.select("high", F.col("least").alias("low")))
    return links.where("high <> low").distinct()


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """`node, component` of every node of an edge; the component is named by its least node.

    The steps end after a number of rounds that grows with the logarithm of the nodes, paths included. Each round is one
    written table; whether it changed anything is one aggregate over it.
    """
    now = cut_lineage(edges.select(F.greatest(left, right).alias("high"), F.least(left, right).alias("low")).where("high <> low").distinct())
    state = None
    while True:
        now = cut_lineage(_small_star(_large_star(now)))
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if found == state:
            break
        state = found
    roots = now.select(F.col("low").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(roots)
