"""A7 acquisition-metadata consistency.

Rows are `file, contributor` and the attributes of METADATA_ATTRIBUTES, `capture_epoch` and `resolution`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MetadataConfig
from ..fixed_values import EDITING_SOFTWARE_MARKERS, FORMAT_EXTENSIONS, METADATA_ATTRIBUTES
from ..functions.numeric import ratio
from ..functions.text import extension
from .keyed import attach_scalars, lookup_by_key
from .order_statistics import grouped_medians


def assign_contributor(rows: DataFrame, mapping: DataFrame | None = None, *, from_path: bool = False) -> DataFrame:
    """A7.2 contributor from the map, else the first folder, else `unassigned`."""
    folder = F.when(F.contains("file", F.lit("/")), F.split("file", "/")[0]) if from_path else F.lit(None).cast("string")
    if mapping is None:
        return rows.withColumn("contributor", F.coalesce(folder, F.lit("unassigned")))
    named = mapping.select("file", F.col("contributor").cast("string").alias("_mapped"))
    return (rows.join(named, "file", "left")
            .withColumn("contributor", F.coalesce("_mapped", folder, F.lit("unassigned"))).drop("_mapped"))


def value_counts(rows: DataFrame, attributes: Sequence[str] = METADATA_ATTRIBUTES) -> DataFrame:
    """Counts per contributor, attribute and value in one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])
    return (rows.select("contributor", F.explode(pairs).alias("p"))
            .groupBy("contributor", "p.attribute", "p.value").agg(F.count(F.lit(1)).alias("n")))


def distributions(counts: DataFrame) -> DataFrame:
    """A7.3 share of each value for the whole dataset and for each contributor."""
    own = counts.groupBy("contributor", "attribute").agg(F.sum("n").alias("total"))
    per_contributor = (counts.join(own, ["contributor", "attribute"])
                       .select(F.lit("contributor").alias("scope"), "contributor", "attribute", "value", "n",
                               (F.col("n") / F.col("total")).alias("share")))
    everyone = counts.groupBy("attribute", "value").agg(F.sum("n").alias("n"))
    whole = everyone.groupBy("attribute").agg(F.sum("n").alias("total"))
    dataset = (everyone.join(F.broadcast(whole), "attribute")
               .select(F.lit("dataset").alias("scope"), F.lit(None).cast("string").alias("contributor"), "attribute",
                       "value", "n", (F.col("n") / F.col("total")).alias("share")))
    return per_contributor.unionByName(dataset)


def contributor_divergence(counts: DataFrame, config: MetadataConfig = MetadataConfig()) -> DataFrame:
    """A7.3 total variation of each profiled contributor against all others, per attribute.

    A value the contributor never has adds its share among the others; summed over such values that is
    one subtraction, so no contributor x value product is built.
    """
    everyone = counts.groupBy("attribute", "value").agg(F.sum("n").alias("all_n"))
    sizes = counts.groupBy("contributor", "attribute").agg(F.sum("n").alias("own_total"))
    whole = everyone.groupBy("attribute").agg(F.sum("all_n").alias("whole"))
    rows = (counts.join(everyone, ["attribute", "value"]).join(sizes, ["contributor", "attribute"])
            .join(F.broadcast(whole), "attribute")  # one row per attribute
            .withColumn("rest", F.col("whole") - F.col("own_total"))
            .where((F.col("own_total") >= config.min_contributor_images) & (F.col("rest") >= config.min_contributor_images)))
    gap = F.abs(F.col("n") / F.col("own_total") - (F.col("all_n") - F.col("n")) / F.col("rest"))
    unseen = (F.max("whole") - F.sum("all_n")) / F.max("rest")
    tv = (F.lit(0.5) * (F.sum(gap) + unseen)).alias("tv_distance")
    graded = rows.groupBy("contributor", "attribute").agg(tv)
    level = (F.when(F.col("tv_distance") >= config.high_divergence, "high_metadata_divergence")
             .when(F.col("tv_distance") >= config.elevated_divergence, "elevated_metadata_divergence"))
    return graded.withColumn("code", level)


def median_capture(rows: DataFrame, config: MetadataConfig = MetadataConfig()) -> Column:
    """A7.5 exact median capture time as a scalar, null with too few time stamps."""
    whole = rows.select(F.lit(0).alias("all"), "capture_epoch")
    median = grouped_medians(whole, ["all"], "capture_epoch").where(F.col("count") >= config.min_timestamps_for_outlier)
    return median.select("median").scalar()


def image_findings(rows: DataFrame, config: MetadataConfig = MetadataConfig(), *,
                   median_epoch: Column | float | None = None, reference_time: float | None = None) -> DataFrame:
    """A7.4 rule checks per image, one row per hit."""
    resolutions = rows.groupBy("resolution").agg(F.count(F.lit(1)).alias("resolution_count"))
    total = rows.agg(F.count(F.lit(1)).alias("image_total"))
    looked = attach_scalars(lookup_by_key(rows, resolutions, ["resolution"], size="resolution_count",
                                          spread=[F.col("file")]), total)
    if median_epoch is not None:
        looked = looked.withColumn("_median", F.lit(median_epoch))
    ext = extension(F.col("file"))
    mismatch = F.lit(False)
    for name, allowed in FORMAT_EXTENSIONS.items():
        mismatch = mismatch | ((F.col("format") == name) & ~ext.isin(*allowed))
    software = F.lower("software")
    edited = F.lit(False)
    for marker in EDITING_SOFTWARE_MARKERS:
        edited = edited | F.contains(software, F.lit(marker))
    rare = ((F.col("image_total") >= config.rare_resolution_min_dataset)
            & (F.col("resolution_count") / F.col("image_total") < config.rare_resolution_fraction))
    taken = F.col("capture_epoch")
    late = (taken > F.lit(reference_time)) if reference_time is not None else F.lit(False)
    odd = F.coalesce(F.abs(taken - F.col("_median")) > config.time_outlier_days * 86400, F.lit(False)) if median_epoch is not None else F.lit(False)

    def rule(hit: Column, code: str, severity: str, level: str) -> Column:
        return F.when(hit, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"),
                                    F.lit(level).alias("evidence_level")))

    hits = F.array(
        rule(mismatch, "format_extension_mismatch", "low", "observation"),
        rule(edited, "editing_software_tag", "info", "observation"),
        rule(rare, "rare_resolution", "info", "heuristic"),
        rule(late, "future_capture_time", "medium", "observation"),
        rule(odd, "capture_time_outlier", "low", "heuristic"))
    return (looked.select("file", "contributor", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
            .select("file", "contributor", "h.code", "h.severity", "h.evidence_level"))


def contributor_evidence(rows: DataFrame, findings: DataFrame, divergence: DataFrame) -> DataFrame:
    """A7.6 anomaly rate and divergent attributes per contributor."""
    sizes = rows.groupBy("contributor").agg(F.count(F.lit(1)).alias("images_assessed"))
    odd = (findings.where("severity <> 'info'").select("file", "contributor").distinct()
           .groupBy("contributor").agg(F.count(F.lit(1)).alias("metadata_anomaly_images")))
    spread = divergence.groupBy("contributor").agg(
        F.max(F.bround("tv_distance", 4)).alias("max_divergence"),
        F.array_sort(F.collect_set(F.when(F.col("code").isNotNull(), F.col("attribute")))).alias("divergent_attributes"))
    return (sizes.join(odd, "contributor", "left").join(spread, "contributor", "left")
            .select("contributor", "images_assessed",
                    F.coalesce("metadata_anomaly_images", F.lit(0)).alias("metadata_anomaly_images"),
                    ratio(F.coalesce("metadata_anomaly_images", F.lit(0)), F.col("images_assessed")).alias("metadata_anomaly_rate"),
                    F.coalesce("max_divergence", F.lit(0.0)).alias("max_divergence"),
                    F.coalesce("divergent_attributes", F.array().cast("array<string>")).alias("divergent_attributes")))


def findings_by_severity(findings: DataFrame) -> DataFrame:
    """A7.7"""
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("finding_count"))
