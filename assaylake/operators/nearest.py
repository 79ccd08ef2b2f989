"""A4 distance to a trusted reference population: exact cosine nearest neighbour by ball bounds.

Equal reference vectors are one indexed point that carries its lowest index and its count, so copies cost one
comparison. Vectors of length zero have distance 1 to everything and stay outside the index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import let, norm
from ..session import cut_lineage
from .keyed import attach_scalars
from .metric_balls import BALL_ROWS, BLOCK_ROWS, Balls, build_balls, nearest

_FAR = 1.0


def _unit(features: Column) -> Column:
    """The vector with length 1; null for a zero vector."""
    return let(features.cast("array<double>"), lambda x: let(norm(x), lambda n: F.when(n > 0, F.transform(x, lambda v: v / n))))


def _points(reference: DataFrame) -> DataFrame:
    """`v, point (lowest index), count` of each distinct reference vector; staged."""
    grouped = reference.groupBy("features").agg(F.min("ref_index").alias("point"), F.count(F.lit(1)).alias("count"))
    return cut_lineage(grouped.select(_unit(F.col("features")).alias("v"), "point", "count"))


def _index(points: DataFrame, ball_rows: int, block_rows: int) -> Balls | None:
    usable = points.where("v is not null")
    return None if usable.isEmpty() else build_balls(usable, ball_rows=min(ball_rows, block_rows), block_rows=block_rows)


def nearest_reference(candidates: DataFrame, reference: DataFrame, *, ball_rows: int = BALL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Nearest reference row of each candidate: `id, distance, ref_index, compared`; ties go to the lowest index.

    Candidates are `id, features` with ids of their own, the reference is `ref_index, features`; `compared` counts the
    distinct reference vectors a candidate met. An empty reference gives no row.
    """
    points = _points(reference)
    balls = _index(points, ball_rows, block_rows)
    queries = cut_lineage(candidates.select("id", _unit(F.col("features")).alias("v")))
    lowest = points.agg(F.min(F.when(F.col("v").isNull(), F.col("point"))).alias("zero"), F.min("point").alias("any"))
    zero = attach_scalars(queries.where("v is null").select("id"), lowest.select("any")).where("any is not null").select(
        "id", F.lit(_FAR).alias("distance"), F.col("any").alias("ref_index"), F.lit(0).cast("long").alias("compared"))
    usable = queries.where("v is not null")
    if balls is None:
        rest = attach_scalars(usable.select("id"), lowest.select("zero")).where("zero is not null")
        return zero.unionByName(rest.select("id", F.lit(_FAR).alias("distance"), F.col("zero").alias("ref_index"), F.lit(0).cast("long").alias("compared")))
    found = attach_scalars(nearest(usable, balls, block_rows=block_rows), lowest.select("zero"))
    own, other = F.struct("distance", "point"), F.struct(F.lit(_FAR).alias("distance"), F.col("zero").alias("point"))
    best = F.when(F.col("zero").isNotNull() & (other < own), other).otherwise(own)
    return found.select("id", best["distance"].alias("distance"), best["point"].alias("ref_index"), "compared").unionByName(zero)


def leave_one_out(reference: DataFrame, *, ball_rows: int = BALL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`point, count, distance` of each distinct reference vector to its nearest other reference row (0 where it occurs twice)."""
    points = _points(reference)
    zero = F.col("v").isNull()
    alone = points.where((F.col("count") == 1) & ~zero)
    apart = points.where(~((F.col("count") == 1) & ~zero)).select("point", "count", F.when(zero, F.lit(_FAR)).otherwise(F.lit(0.0)).alias("distance"))
    balls = _index(points, ball_rows, block_rows)
    if balls is None:
        return apart
    near = nearest(alone.select(F.col("point").alias("id"), "v"), balls, own=True, block_rows=block_rows)
    zeros = points.agg(F.count_if(zero).alias("zeros"))
    near = attach_scalars(near, zeros).select(F.col("id").alias("point"), F.lit(1).cast("long").alias("count"),
                                              F.when(F.col("zeros") > 0, F.least("distance", F.lit(_FAR))).otherwise(F.col("distance")).alias("distance"))
    return apart.unionByName(near)


def fit_reference(reference: DataFrame, *, ball_rows: int = BALL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A4.3 one row `reference_count, threshold`: the largest leave-one-out nearest distance, as float32."""
    if reference.limit(2).count() < 2:
        raise ValueError("at least two reference rows are required")
    return leave_one_out(reference, ball_rows=ball_rows, block_rows=block_rows).agg(
        F.sum("count").alias("reference_count"), F.max(F.col("distance").cast("float")).cast("double").alias("threshold"))


def assess_candidates(candidates: DataFrame, reference: DataFrame, *, ball_rows: int = BALL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A4.4 `id, ref_index, distance, threshold, potential_ood` with a strict comparison."""
    fitted = cut_lineage(fit_reference(reference, ball_rows=ball_rows, block_rows=block_rows).select("threshold"))
    found = nearest_reference(candidates, reference, ball_rows=ball_rows, block_rows=block_rows)
    return (attach_scalars(found, fitted)
            .withColumn("potential_ood", F.col("distance") > F.col("threshold"))
            .select("id", F.col("ref_index").alias("nearest_reference_index"), "distance", "threshold", "potential_ood"))


def assessment_totals(results: DataFrame) -> DataFrame:
    """A4.5 totals; an empty candidate set gives zeros."""
    return results.agg(F.count(F.lit(1)).alias("candidate_count"),
                       F.count_if("potential_ood").alias("potential_ood_count"))


def visited_share(found: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: candidates, distinct reference vectors, and the comparisons made against those of a full search."""
    distinct = reference.select("features").distinct().agg(F.count(F.lit(1)).alias("reference_vectors"))
    made = found.agg(F.count(F.lit(1)).alias("candidate_count"), F.sum("compared").alias("comparisons"))
    return attach_scalars(made, distinct).withColumn("share", F.col("comparisons") / (F.col("candidate_count") * F.col("reference_vectors")))
