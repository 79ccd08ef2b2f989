"""C2 distribution shift between a reference and a candidate population.

Feature rows are `population, file`, the four scalar features and histogram arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ShiftConfig
from ..fixed_values import SHIFT_FEATURES, SHIFT_HISTOGRAMS
from ..functions.hashing import canonical_json
from .keyed import attach_scalars
from .ordering import ordered_digest

_FLOOR = 1e-6


def feature_summary(rows: DataFrame, features: Sequence[str] = SHIFT_FEATURES) -> DataFrame:
    """C2.2 mean, population std and count per population and feature, in one aggregation of the rows."""
    aggs = [a for f in features for a in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"), F.count(f).alias(f"n_{f}"))]
    wide = rows.groupBy("population").agg(*aggs)
    long = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("mean"), F.col(f"s_{f}").alias("std"),
                              F.col(f"n_{f}").alias("count")) for f in features])
    return wide.select("population", F.explode(long).alias("x")).select("population", "x.*")


def histogram_summary(rows: DataFrame, histograms: Sequence[str] = SHIFT_HISTOGRAMS) -> DataFrame:
    """C2.3 mean histogram per population, renormalised to sum 1: `population, histogram, bin, share`."""
    named = F.array(*[F.struct(F.lit(h).alias("histogram"), F.col(h).alias("bins")) for h in histograms])
    bins = (rows.select("population", F.explode(named).alias("h"))
            .select("population", "h.histogram", F.posexplode("h.bins").alias("bin", "v"))
            .groupBy("population", "histogram", "bin").agg(F.avg("v").alias("v")))
    totals = bins.groupBy("population", "histogram").agg(F.sum("v").alias("t"))
    return bins.join(totals, ["population", "histogram"]).select(
        "population", "histogram", "bin", F.when(F.col("t") > 0, F.col("v") / F.col("t")).otherwise(F.col("v")).alias("share"))


def _side(df: DataFrame, population: str, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return df.where(F.col("population") == population).select(*keys, F.col(value).alias(name))


def feature_distances(summary: DataFrame, config: ShiftConfig = ShiftConfig(), *, reference: str = "reference",
                      candidate: str = "candidate") -> DataFrame:
    """C2.4 / C2.5 distance of the means per feature and its flag (>=)."""
    r = _side(summary, reference, ["feature"], "mean", "reference_mean")
    c = _side(summary, candidate, ["feature"], "mean", "candidate_mean")
    threshold = F.lit(None).cast("double")
    for feature in SHIFT_FEATURES:
        threshold = F.when(F.col("feature") == feature, F.lit(config.threshold(feature))).otherwise(threshold)
    joined = r.join(c, "feature").withColumn("distance", F.abs(F.col("reference_mean") - F.col("candidate_mean")))
    return joined.withColumn("threshold", threshold).withColumn("shifted", F.col("distance") >= F.col("threshold"))


def histogram_distances(summary: DataFrame, *, reference: str = "reference", candidate: str = "candidate") -> DataFrame:
    """C2.4 total variation of the mean histograms."""
    keys = ["histogram", "bin"]
    joined = _side(summary, reference, keys, "share", "p").join(_side(summary, candidate, keys, "share", "q"), keys)
    return joined.groupBy("histogram").agg((F.lit(0.5) * F.sum(F.abs(F.col("p") - F.col("q")))).alias("distance"))


def overall_shift(features: DataFrame, histograms: DataFrame, config: ShiftConfig = ShiftConfig()) -> DataFrame:
    """C2.5 one row: overall shift and severity; `unavailable` when a population is empty."""
    scalar = features.agg(F.avg("distance").alias("scalar_mean"), F.count_if("shifted").alias("shifted_feature_count"))
    both = scalar.withColumn("histogram_mean", histograms.agg(F.avg("distance")).scalar())
    overall = F.lit(0.6) * F.col("scalar_mean") + F.lit(0.4) * F.col("histogram_mean")
    severity = (F.when(overall.isNull(), F.lit(None)).when(overall >= config.overall_shift_threshold, "high")
                .when(F.col("shifted_feature_count") >= 2, "medium").when(F.col("shifted_feature_count") == 1, "low")
                .otherwise("none"))
    return both.select(F.when(overall.isNull(), "unavailable").otherwise("completed").alias("status"), "scalar_mean",
                       "histogram_mean", "shifted_feature_count", overall.alias("overall_shift"), severity.alias("severity"))


def image_anomalies(rows: DataFrame, summary: DataFrame, config: ShiftConfig = ShiftConfig(), *,
                    features: Sequence[str] = SHIFT_FEATURES, reference: str = "reference", candidate: str = "candidate") -> DataFrame:
    """C2.6 candidates whose largest |z| against the reference reaches the limit, with all z values."""
    own = summary.where(F.col("population") == reference)
    pick = lambda f, c: F.max(F.when(F.col("feature") == f, F.col(c)))
    stats = own.agg(*[a for f in features for a in (pick(f, "mean").alias(f"_m_{f}"), pick(f, "std").alias(f"_s_{f}"))])
    scored = attach_scalars(rows.where(F.col("population") == candidate).select("file", *features), stats)
    z = {f: F.abs((F.col(f) - F.col(f"_m_{f}")) / F.greatest(F.col(f"_s_{f}"), F.lit(_FLOOR))) for f in features}
    scored = scored.select("file", *[z[f].alias(f"z_{f}") for f in features])
    top = F.greatest(*[F.col(f"z_{f}") for f in features])
    return scored.withColumn("max_z_score", top).where(F.col("max_z_score") >= config.image_anomaly_z)


def shift_findings(overall: DataFrame, anomalies: DataFrame, config: ShiftConfig = ShiftConfig()) -> DataFrame:
    """C2.7 raw findings of the engine: `type, severity, overall_shift, count`."""
    shift = overall.where("severity <> 'none'").select(
        F.lit("distribution_shift").alias("type"), "severity", "overall_shift", F.lit(None).cast("long").alias("count"))
    odd = anomalies.agg(F.count(F.lit(1)).alias("count")).where("count > 0").select(
        F.lit("candidate_image_anomalies").alias("type"),
        F.when(F.col("count") < config.many_anomalies, "medium").otherwise("high").alias("severity"),
        F.lit(None).cast("double").alias("overall_shift"), "count")
    return shift.unionByName(odd)


def result_digest(overall: DataFrame, features: DataFrame, histograms: DataFrame, anomalies: DataFrame) -> DataFrame:
    """C2.8 digest of the result rows; numbers enter as nine-decimal text."""
    text = lambda c: F.format_string("%.9f", F.col(c))

    def lines(df: DataFrame, kind: str, key: Column, *values: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), key.alias("key"), canonical_json(key=key, values=F.concat_ws("|", *values)).alias("item"))

    rows = (lines(overall, "overall", F.lit("overall"), text("overall_shift"), F.col("severity"))
            .unionByName(lines(features, "feature", F.col("feature"), text("distance"), F.col("shifted").cast("string")))
            .unionByName(lines(histograms, "histogram", F.col("histogram"), text("distance")))
            .unionByName(lines(anomalies, "image", F.col("file").cast("string"), text("max_z_score"))))
    return ordered_digest(rows, [F.col("kind"), F.col("key")], F.col("item"))


def dominant_feature(anomalies: DataFrame, features: Sequence[str] = SHIFT_FEATURES) -> DataFrame:
    """Q8 the feature with the largest |z| of each anomaly (the first one on a tie)."""
    best = F.lit(None).cast("string")
    for feature in reversed(features):
        best = F.when(F.col(f"z_{feature}") >= F.col("max_z_score"), F.lit(feature)).otherwise(best)
    return anomalies.withColumn("dominant_feature", best)


def feature_table(summary: DataFrame, distances: DataFrame) -> DataFrame:
    """Q9 reference and candidate mean, distance, threshold and flag text per feature."""
    state = (F.when(F.col("shifted"), "SHIFTED").when(~F.col("shifted"), "NOT SHIFTED").otherwise("NOT RECORDED"))
    names = summary.select("feature").distinct()
    return names.join(distances, "feature", "left").select(
        "feature", "reference_mean", "candidate_mean", "distance", "threshold", state.alias("state"))
