"""Exact medians of many groups at once, and what builds on them, by narrowing value ranges.

A group's values are counted once. Each round cuts every group's current range into bins, finds the bin of the wanted
rank by a cumulative count, and goes on with the least and greatest value in it; after a fixed number of rounds the few values
left are ranked. Small groups need no rounds. Everything stays rows: ranks, ranges and results are columns of one row for each group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .keyed import lookup_by_key

ROUNDS = 2
BINS = 1024
#: Where no group holds more distinct values than this, all of them are ranked at once.
RANKED_VALUES = 100_000
#: Median absolute deviation of a normal distribution, as a share of its standard deviation.
NORMAL_MAD = 0.6745


def _within(base: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """The counted values of each group that lie in the range of a wanted rank, with that target's columns."""
    wanted = targets.groupBy(*keys).agg(F.collect_list(F.struct("want", "rank", "low", "high")).alias("targets"), F.first("held").alias("held"))  # two at most
    rows = lookup_by_key(base, wanted, keys, size="held", spread=[F.col("v")]).drop("held")
    rows = rows.select(*keys, "v", "n", F.explode("targets").alias("t")).select(*keys, "v", "n", "t.*")
    return rows.where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))


def grouped_medians(rows: DataFrame, keys: Sequence[str], value: str, *, rounds: int = ROUNDS, bins: int = BINS,
                    ranked_values: int = RANKED_VALUES) -> DataFrame:
    """`keys, count, median` of the non-null, non-NaN values of every group, exact at every size; keys are not null."""
    keys = list(keys)
    number = F.col(value).cast("double")
    base = cut_lineage(rows.where(number.isNotNull() & ~F.isnan(number)).groupBy(*keys, number.alias("v")).agg(F.count(F.lit(1)).alias("n")))
    sizes = base.groupBy(*keys).agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("held"), F.min("v").alias("low"), F.max("v").alias("high"))
    both = F.array_distinct(F.array(F.expr("(count - 1) div 2"), F.expr("count div 2")))
    sizes = cut_lineage(sizes)
    targets = sizes.select(*keys, "held", "low", "high", F.explode(both).alias("want")).withColumn("rank", F.col("want"))
    order = Window.partitionBy(*keys, "want")
    largest = sizes.agg(F.max("held")).first()[0] or 0
    if largest <= ranked_values:
        group = Window.partitionBy(*keys)
        first = F.coalesce(F.sum("n").over(group.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = base.withColumn("count", F.sum("n").over(group)).withColumn("before", first)
        holds = lambda rank: (F.col("before") <= F.expr(rank)) & (F.expr(rank) < F.col("before") + F.col("n"))
        return ranked.where(holds("(count - 1) div 2") | holds("count div 2")).groupBy(*keys).agg(
            F.first("count").alias("count"), (F.min("v") / 2 + F.max("v") / 2).alias("median"))
    for _ in range(rounds):
        share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)  # halves: a difference may pass the largest double
        place = F.when(F.col("high") > F.col("low"), F.least(F.floor(share * bins), F.lit(bins - 1))).otherwise(0).cast("int")
        counted = _within(base, targets, keys).groupBy(*keys, "want", "rank", place.alias("bin")).agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("held"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.coalesce(F.sum("n").over(order.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = counted.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        held = sizes.select(*keys, "held")
        targets = cut_lineage(found.select(*keys, "low", "high", "want", (F.col("rank") - F.col("before")).alias("rank")).join(held, keys))
    before = F.coalesce(F.sum("n").over(order.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = _within(base, targets, keys).withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
    middle = last.groupBy(*keys).agg((F.min("v") / 2 + F.max("v") / 2).alias("median"))
    return sizes.select(*keys, "count").join(middle, keys)


def robust_scores(rows: DataFrame, keys: Sequence[str], value: str, *, rounds: int = ROUNDS, bins: int = BINS) -> DataFrame:
    """The rows with `median` and `mad` of their group and `robust_z`, null where the deviation is 0 or the value is missing."""
    keys = list(keys)
    middle = grouped_medians(rows, keys, value, rounds=rounds, bins=bins)
    placed = lookup_by_key(rows, middle, keys, size="count", spread=[F.col(c) for c in rows.columns]).drop("count")
    placed = placed.withColumn("_off", F.abs(F.col(value).cast("double") - F.col("median")))
    spread = grouped_medians(placed, keys, "_off", rounds=rounds, bins=bins).withColumnRenamed("median", "mad")
    scored = lookup_by_key(placed, spread, keys, size="count", spread=[F.col(c) for c in rows.columns]).drop("count", "_off")
    return scored.withColumn("robust_z", F.try_divide(F.lit(NORMAL_MAD) * (F.col(value).cast("double") - F.col("median")), F.col("mad")))


def group_spread(rows: DataFrame, keys: Sequence[str], value: str, *, limit: float = 3.5) -> DataFrame:
    """`keys, median, mad, outliers` of every group: outliers are values whose robust score reaches the limit."""
    scored = robust_scores(rows, keys, value)
    return scored.groupBy(*keys).agg(F.first("median").alias("median"), F.first("mad").alias("mad"),
                                     F.count_if(F.abs("robust_z") >= limit).alias("outliers"))
