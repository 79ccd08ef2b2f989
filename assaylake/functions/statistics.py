"""Statistics without a built-in: hypergeometric tail (pandas UDF) and exact median of a whole column."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def hypergeometric_tail(k: int, n: int, marked: int, population: int) -> float:
    """P(X >= k) for n draws from `population` items of which `marked` count."""
    top = min(n, marked)
    low = max(k, n - (population - marked), 0)
    if low > top:
        return 0.0
    if low == max(0, n - (population - marked)):
        return 1.0

    def log_choose(a: int, b: int) -> float:
        return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    def log_term(i: int) -> float:
        return log_choose(marked, i) + log_choose(population - marked, n - i) - log_choose(population, n)

    mode = (n + 1) * (marked + 1) // (population + 2)

    def run(start: int, step: int, stop: int) -> float:
        """Terms from `start` away from the mode until they no longer count, relative to the first."""
        total, term, i = 0.0, 1.0, start
        while True:
            total += term
            if i == stop or term < total * 1e-18:
                return total
            if step > 0:
                term *= (marked - i) * (n - i) / ((i + 1) * (population - marked - n + i + 1))
            else:
                term *= i * (population - marked - n + i) / ((marked - i + 1) * (n - i + 1))
            i += step

    if low > mode:
        return math.exp(log_term(low)) * run(low, 1, top)
    below = math.exp(log_term(low - 1)) * run(low - 1, -1, max(0, n - (population - marked)))
    return min(1.0, max(0.0, 1.0 - below))


@F.pandas_udf(DoubleType())
def hypergeometric_tail_udf(k: pd.Series, n: pd.Series, marked: pd.Series, population: pd.Series) -> pd.Series:
    rows = zip(k, n, marked, population)
    return pd.Series([hypergeometric_tail(int(a), int(b), int(c), int(d)) for a, b, c, d in rows], dtype="float64")


def _value_at_rank(df: DataFrame, column: str, rank: int, low: float, high: float,
                   inside: int, buckets: int, small: int) -> float:
    """Value at 0-based `rank` among the rows with low <= value <= high.

    Each round keeps only the bucket that holds the rank, so no task ever holds more than `small`
    distinct values; a bucket that is one repeated value ends the search at once.
    """
    value = F.col(column)
    while low < high and inside > small:
        width = (high - low) / buckets
        if width == 0 or low + width == low:
            break
        bucket = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(buckets - 1)).cast("int")
        counts = (df.where((value >= low) & (value <= high)).groupBy(bucket.alias("b"))
                  .agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
                  .orderBy("b").collect())
        for row in counts:
            if rank < row["n"]:
                low, high, inside = row["lo"], row["hi"], row["n"]
                break
            rank -= row["n"]
    if low == high:
        return low
    kept = (df.where((value >= low) & (value <= high)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(column).collect())
    for row in kept:
        if rank < row["n"]:
            return row[column]
        rank -= row["n"]
    raise ValueError("rank beyond the rows")


def exact_median(df: DataFrame, column: str, *, buckets: int = 4096, small: int = 50_000) -> float | None:
    """Exact median of a whole column by narrowing value ranges; every round is one partial aggregation."""
    head = (df.where(F.col(column).isNotNull())
            .agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).first())
    if not head["n"]:
        return None
    args = (head["lo"], head["hi"], head["n"], buckets, small)
    upper = _value_at_rank(df, column, head["n"] // 2, *args)
    if head["n"] % 2:
        return float(upper)
    return (float(_value_at_rank(df, column, head["n"] // 2 - 1, *args)) + float(upper)) / 2.0
