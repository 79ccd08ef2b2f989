"""B4 search for localized perturbations that repeatedly change predictions.

The grid and the patched predictions are tables; running the model is the caller's predict function
(patching and inference are the caller's, by predict_batch_udf).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TriggerConfig
from ..functions.hashing import sha256_text
from ..functions.numeric import argmax, array_sum, normalize_probabilities, softmax
from .keyed import attach_scalars, lookup_by_key


def trigger_grid(spark: SparkSession, config: TriggerConfig = TriggerConfig(), *, image_side: int | None = None) -> DataFrame:
    """B4.1 patch size x position x pattern, with the 16-hex candidate id; too large patches are left out."""
    sizes = [s for s in config.patch_sizes if image_side is None or s <= image_side]
    array = lambda values: F.array(*[F.lit(v) for v in values])
    grid = spark.range(1).select(F.explode(array(sizes) if sizes else F.array().cast("array<int>")).alias("patch_size"))
    for name, values in (("y_fraction", config.grid_fractions), ("x_fraction", config.grid_fractions), ("pattern", config.patterns)):
        grid = grid.select("*", F.explode(array(values)).alias(name))
    return grid.select(candidate_id().alias("candidate_id"), "patch_size", "x_fraction", "y_fraction", "pattern")


def candidate_id() -> Column:
    raw = F.format_string("%d|%.6f|%.6f|%s", "patch_size", "x_fraction", "y_fraction", "pattern")
    return F.substring(sha256_text(raw), 1, 16)


def expand_images(images: DataFrame, grid: DataFrame) -> DataFrame:
    """Every image with every grid entry; the grid is a fixed few dozen rows held as one array."""
    packed = grid.agg(F.collect_list(F.struct(*grid.columns)).alias("g")).scalar()
    return images.withColumn("candidate", F.explode(packed)).select(*images.columns, "candidate.*")


def to_probabilities(outputs: DataFrame, output_type: str = "auto", group: tuple[str, ...] = ("candidate_id",)) -> DataFrame:
    """B4.3 model outputs in `output` to `probs`.

    `auto` takes a group as probabilities only when all its rows are non-negative and sum to 1 within
    1e-4 (relative 1e-5); otherwise softmax. The group flag is one small aggregation.
    """
    if output_type == "logits":
        return outputs.withColumn("probs", softmax(F.col("output")))
    clipped = F.transform("output", lambda x: F.greatest(x.cast("double"), F.lit(0.0)))
    if output_type == "probabilities":
        return outputs.withColumn("probs", normalize_probabilities(clipped))
    total = array_sum(F.col("output"))
    looks = F.forall("output", lambda x: x >= -1e-8) & (F.abs(total - 1.0) <= 1e-4 + 1e-5)
    flags = outputs.groupBy(*group).agg(F.bool_and(looks).alias("_is_probability"), F.count(F.lit(1)).alias("_n"))
    flagged = lookup_by_key(outputs, flags, group, size="_n", spread=[F.col("image_idx")]) if group else attach_scalars(outputs, flags)
    probs = F.when(F.col("_is_probability"), normalize_probabilities(clipped)).otherwise(softmax(F.col("output")))
    return flagged.withColumn("probs", probs).drop("_is_probability", "_n")


def compare_to_clean(patched: DataFrame, clean: DataFrame | None = None) -> DataFrame:
    """One row per candidate and image with classes, confidence gain and L1 change.

    Images that carry `clean_probs` from before they were expanded need no join here.
    """
    joined = patched if clean is None else patched.select("candidate_id", "image_idx", "probs").join(
        clean.select("image_idx", F.col("probs").alias("clean_probs")), "image_idx")
    l1 = array_sum(F.zip_with("probs", "clean_probs", lambda a, b: F.abs(a - b)))
    return joined.select(
        "candidate_id", "image_idx", argmax(F.col("clean_probs")).alias("clean_class"), argmax(F.col("probs")).alias("patched_class"),
        F.array_max("clean_probs").alias("clean_confidence"), F.array_max("probs").alias("patched_confidence"), l1.alias("l1_change"))


def infer_target(compared: DataFrame) -> DataFrame:
    """B4.5 most frequent class among changed predictions, the lowest id on a tie: one row, null if none."""
    counts = (compared.where("patched_class <> clean_class").groupBy("patched_class").agg(F.count(F.lit(1)).alias("n")))
    return counts.agg(F.max(F.struct("n", (-F.col("patched_class")).alias("neg"))).alias("best")).select(
        (-F.col("best.neg")).alias("target_class"))


def candidate_metrics(compared: DataFrame, target: DataFrame) -> DataFrame:
    """B4.4 per candidate: change and target rates, confidence gain, L1 change."""
    rows = attach_scalars(compared, target)
    changed = F.col("patched_class") != F.col("clean_class")
    hit = F.when(F.col("target_class").isNull(), changed).otherwise(F.col("patched_class") == F.col("target_class"))
    gain = F.col("patched_confidence") - F.col("clean_confidence")
    return rows.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("sample_count"), F.count_if(changed).alias("class_change_count"),
        F.avg(changed.cast("double")).alias("class_change_rate"), F.first("target_class").alias("target_class"),
        F.count_if(hit).alias("target_hit_count"), F.avg(hit.cast("double")).alias("target_hit_rate"),
        F.avg("clean_confidence").alias("mean_clean_confidence"), F.avg("patched_confidence").alias("mean_patched_confidence"),
        F.avg(gain).alias("mean_confidence_gain"), F.max(gain).alias("max_confidence_gain"),
        F.avg("l1_change").alias("mean_probability_l1_change"))


def grade_candidates(metrics: DataFrame, config: TriggerConfig = TriggerConfig()) -> DataFrame:
    """B4.6 evidence flag on every candidate."""
    c = config
    steady = F.when(F.col("target_class").isNull(), F.col("class_change_rate")).otherwise(F.col("target_hit_rate"))
    moved = ((F.col("mean_confidence_gain") >= c.min_confidence_gain)
             | (F.col("mean_probability_l1_change") >= c.min_probability_l1_change))
    found = ((F.col("sample_count") >= c.min_samples) & (F.col("class_change_rate") >= c.min_prediction_change_rate)
             & moved & (steady >= c.min_prediction_change_rate))
    return metrics.withColumn("candidate_trigger_like", found)


def candidate_evidence(graded: DataFrame) -> DataFrame:
    """B4.6 candidates with evidence, strongest first; candidate_id settles ties."""
    return graded.where("candidate_trigger_like").orderBy(
        F.desc("class_change_rate"), F.desc("mean_confidence_gain"), F.desc("mean_probability_l1_change"), "candidate_id")


def clean_baseline(clean: DataFrame) -> DataFrame:
    """B4.7 confidence of the clean predictions."""
    top = F.array_max("probs")
    return clean.agg(F.count(F.lit(1)).alias("sample_count"), F.avg(top).alias("mean_confidence"),
                     F.min(top).alias("min_confidence"), F.max(top).alias("max_confidence"))


def clean_classes(clean: DataFrame) -> DataFrame:
    """B4.7 class distribution of the clean predictions."""
    return clean.groupBy(argmax(F.col("probs")).alias("class_id")).agg(F.count(F.lit(1)).alias("n"))
