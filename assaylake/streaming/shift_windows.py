"""C2 over a stream: shift of every sliding window against a fixed reference population.

The state of a window is sums: count, sum and square sum of each scalar feature, and the sum of each histogram bin, so
partial states merge and a window costs the same however many rows it holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ShiftConfig
from ..fixed_values import SHIFT_FEATURES, SHIFT_HISTOGRAMS
from ..operators.shift import feature_summary, histogram_summary


def reference_profile(rows: DataFrame, *, reference: str = "reference") -> tuple[dict[str, float], dict[str, list[float]]]:
    """Means and mean histograms of the reference population: as many values as features and bins."""
    own = rows.where(F.col("population") == reference)
    means = {r["feature"]: r["mean"] for r in feature_summary(own).collect()}
    shares: dict[str, list[float]] = {}
    for r in histogram_summary(own).orderBy("histogram", "bin").collect():
        shares.setdefault(r["histogram"], []).append(r["share"])
    return means, shares


def window_state(values: DataFrame, size: str, slide: str, delay: str, *, bins: int, time: str = "ts",
                 features: Sequence[str] = SHIFT_FEATURES, histograms: Sequence[str] = SHIFT_HISTOGRAMS) -> DataFrame:
    """`window, rows`, `mean_*` and `std_*` of each feature and `hist_*` (mean bins) of each histogram, per sliding window."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for f in features:
        aggs += [F.avg(f).alias(f"mean_{f}"), F.stddev_pop(f).alias(f"std_{f}")]
    for h in histograms:
        aggs += [F.sum(F.get(F.col(h), F.lit(b))).alias(f"_{h}_{b}") for b in range(bins)]
    rows = values.withWatermark(time, delay).groupBy(F.window(time, size, slide).alias("window")).agg(*aggs)
    hists = [F.array(*[F.col(f"_{h}_{b}") for b in range(bins)]).alias(f"hist_{h}") for h in histograms]
    return rows.select("window", "rows", *[c for f in features for c in (f"mean_{f}", f"std_{f}")], *hists)


def _variation(sums: Column, reference: list[float]) -> Column:
    """Total variation of bin sums (scaled to shares) against reference shares; null where a bin is missing."""
    total = F.aggregate(sums, F.lit(0.0), lambda a, x: a + x)
    return F.lit(0.5) * F.aggregate(F.zip_with(sums, F.lit(reference), lambda s, r: F.abs(F.when(total > 0, s / total).otherwise(s) - r)), F.lit(0.0), lambda a, x: a + x)


def stream_overall_shift(values: DataFrame, means: dict[str, float], shares: dict[str, list[float]], *, size: str = "1 day", slide: str = "6 hours",
                         delay: str = "1 hour", time: str = "ts", config: ShiftConfig = ShiftConfig()) -> DataFrame:
    """C2.4 and C2.5 of every sliding window against the reference: `start, end, rows, distance_*, overall_shift, shifted_feature_count, severity`.

    Equal to `overall_shift` over the reference and the rows of the window. Rows later than the watermark are left out.
    """
    state = window_state(values, size, slide, delay, bins=config.histogram_bins, time=time, features=list(means), histograms=list(shares))
    distance = {f: F.abs(F.col(f"mean_{f}") - F.lit(m)) for f, m in means.items()}
    variation = {h: _variation(F.col(f"hist_{h}"), s) for h, s in shares.items()}
    measured = state.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "rows",
                            *[d.alias(f"distance_{n}") for n, d in (distance | variation).items()])
    mean_of = lambda names: sum((F.col(f"distance_{n}") for n in names), F.lit(0.0)) / len(names)
    shifted = sum((F.when(F.col(f"distance_{f}") >= config.threshold(f), 1).otherwise(0) for f in means), F.lit(0))
    scored = measured.withColumns({"overall_shift": F.lit(0.6) * mean_of(means) + F.lit(0.4) * mean_of(shares), "shifted_feature_count": shifted.cast("long")})
    severity = (F.when(F.col("overall_shift") >= config.overall_shift_threshold, "high").when(F.col("shifted_feature_count") >= 2, "medium")
                .when(F.col("shifted_feature_count") == 1, "low").otherwise("none"))
    return scored.withColumn("severity", F.when(F.col("overall_shift").isNotNull(), severity))
