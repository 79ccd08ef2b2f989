"""A6 contributor profiles, evidence by contributor and the rule score.

Rows are `file, contributor, class, timestamp` with blanks already set to UNKNOWN (see sources.tables).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ContributorConfig
from ..functions.numeric import ratio
from .keyed import attach_scalars
from .labels import profile_sides


def class_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("contributor", "class").agg(F.count(F.lit(1)).alias("image_count"))


def contributor_profiles(rows: DataFrame) -> DataFrame:
    """A6.1 volume, class mix (log2 entropy, dominant share) and time stamps per contributor."""
    per_class = rows.groupBy("contributor", "class").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("timestamp"), F.lit("")) != "").alias("stamped"))
    # entropy from sums over classes: log2(N) - sum(n*log2(n))/N
    total = F.sum("n")
    entropy = F.greatest(F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total, F.lit(0.0))
    return per_class.groupBy("contributor").agg(
        total.alias("image_count"), F.count(F.lit(1)).alias("class_count"), entropy.alias("class_entropy"),
        (F.max("n") / total).alias("dominant_class_ratio"), F.sum("stamped").alias("timestamp_count"))


def duplicate_evidence(rows: DataFrame) -> DataFrame:
    """A6.2 copies by contributor from `contributor, sha256`; null hashes are skipped files."""
    own = rows.where("sha256 is not null").groupBy("sha256", "contributor").agg(F.count(F.lit(1)).alias("n"))
    groups = own.groupBy("sha256").agg(F.sum("n").alias("group_files"), F.count(F.lit(1)).alias("group_contributors"))
    copied = F.col("group_files") > 1
    return own.join(groups, "sha256").groupBy("contributor").agg(
        F.sum("n").alias("images_hashed"),
        F.coalesce(F.sum(F.when(copied, F.col("n"))), F.lit(0)).cast("long").alias("duplicate_images"),
        F.count_if(copied).alias("duplicate_groups"),
        F.count_if(copied & (F.col("group_contributors") > 1)).alias("cross_contributor_groups"),
    ).withColumn("duplicate_rate", ratio(F.col("duplicate_images"), F.col("images_hashed")))


def ood_evidence(rows: DataFrame, results: DataFrame) -> DataFrame:
    """A6.3 reference-check results (`file, potential_ood`) by contributor."""
    joined = rows.select("file", "contributor").join(results.select("file", "potential_ood"), "file")
    return joined.groupBy("contributor").agg(
        F.count(F.lit(1)).alias("ood_assessed"), F.count_if("potential_ood").alias("ood_images"),
    ).withColumn("ood_rate", ratio(F.col("ood_images"), F.col("ood_assessed")))


def label_conflict_evidence(rows: DataFrame, conflicts: DataFrame, image_profiles: DataFrame) -> DataFrame:
    """A6.4 conflicting pairs per contributor; a pair counts once for each contributor on it.

    `image_profiles` is `profile, owner` with the contributor as owner; the denominator is all rows.
    """
    pairs = profile_sides(conflicts, image_profiles).groupBy(F.col("owner").alias("contributor")).agg(
        F.sum("pairs").alias("conflict_pairs"))
    sizes = rows.groupBy("contributor").agg(F.count(F.lit(1)).alias("images"))
    return (sizes.join(pairs, "contributor", "left")
            .select("contributor", F.coalesce("conflict_pairs", F.lit(0)).alias("conflict_pairs"),
                    ratio(F.coalesce("conflict_pairs", F.lit(0)), F.col("images")).alias("label_conflict_rate")))


def contributor_risk(profiles: DataFrame, duplicates: DataFrame | None = None, ood: DataFrame | None = None,
                     conflicts: DataFrame | None = None, config: ContributorConfig = ContributorConfig()) -> DataFrame:
    """A6.5 / A6.6 rule score, level and finding codes in fixed order; absent evidence counts as zero."""
    joined = profiles
    defaults = {}
    for frame, columns in ((duplicates, ("images_hashed", "duplicate_images", "duplicate_groups",
                                         "cross_contributor_groups", "duplicate_rate")),
                           (ood, ("ood_images", "ood_rate")), (conflicts, ("conflict_pairs", "label_conflict_rate"))):
        if frame is not None:
            joined = joined.join(frame.select("contributor", *columns), "contributor", "left")
        else:
            for name in columns:
                joined = joined.withColumn(name, F.lit(None).cast("double" if name.endswith("rate") else "long"))
        defaults |= {c: 0.0 if c.endswith("rate") else 0 for c in columns}
    joined = joined.fillna(defaults)
    means = profiles.agg(F.avg("image_count").alias("mean_images"), F.avg(F.bround("class_entropy", 6)).alias("mean_entropy"),
                         F.count(F.lit(1)).alias("contributors"))
    joined = attach_scalars(joined, means)
    c = config
    rules = [
        ("unusually_high_contribution_volume", 25.0,
         (F.col("mean_images") > 0) & (F.col("image_count") > F.col("mean_images") * c.volume_factor)),
        ("high_class_concentration", 20.0,
         (F.col("image_count") >= c.concentration_min_images) & (F.col("dominant_class_ratio") >= c.concentration_ratio)),
        ("single_class_contribution", 10.0, (F.col("class_count") == 1) & (F.col("contributors") > 1)),
        ("elevated_duplicate_rate", 10.0, F.col("duplicate_rate") >= c.elevated_rate),
        ("high_duplicate_rate", 10.0, F.col("duplicate_rate") >= c.high_rate),
        ("cross_contributor_duplicate_detected", 5.0, F.col("duplicate_groups") > 0),
        ("elevated_ood_rate", 10.0, F.col("ood_rate") >= c.elevated_rate),
        ("high_ood_rate", 10.0, F.col("ood_rate") >= c.high_rate),
        ("elevated_label_conflict_rate", 10.0, F.col("label_conflict_rate") >= c.elevated_rate),
        ("high_label_conflict_rate", 10.0, F.col("label_conflict_rate") >= c.high_rate),
        ("unusually_low_class_entropy", 15.0,
         (F.col("contributors") >= c.entropy_min_contributors) & (F.col("mean_entropy") > 0)
         & (F.bround("class_entropy", 6) < F.col("mean_entropy") * c.entropy_factor)),
    ]
    codes = F.filter(F.array(*[F.when(hit, F.lit(name)) for name, _, hit in rules]), lambda x: x.isNotNull())
    points = F.lit(0.0)
    for _, weight, hit in rules:
        points = points + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
    scored = joined.withColumn("findings", codes).withColumn("risk_score", F.least(points, F.lit(100.0)))
    level = (F.when(F.col("risk_score") >= c.high_score, "HIGH")
             .when(F.col("risk_score") >= c.medium_score, "MEDIUM").otherwise("LOW"))
    return scored.withColumn("risk_level", level).drop("mean_images", "mean_entropy", "contributors")


def risk_totals(scored: DataFrame) -> DataFrame:
    """A6.7 totals over all contributors."""
    return scored.agg(
        F.sum("image_count").alias("row_count"), F.count(F.lit(1)).alias("contributor_count"),
        F.count_if(F.size("findings") > 0).alias("finding_count"),
        F.count_if(F.col("risk_level") == "HIGH").alias("high_risk_contributors"),
        F.count_if(F.col("risk_level") == "MEDIUM").alias("medium_risk_contributors"))
