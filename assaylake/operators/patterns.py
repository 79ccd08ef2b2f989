"""A8 repeated-pattern evidence from region candidates.

Candidates are `file, region_no, peak_hf, y0, x0, cx, cy, descriptor`; the processing order is file,
falling peak, y0, x0. A null descriptor belongs to no pattern. Joins of tables that both grow with the candidates
are merged, as their packed files look small enough for a broadcast, which the driver would have to hold.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PatternConfig
from ..functions.numeric import ratio
from ..functions.statistics import hypergeometric_tail_udf
from ..functions.text import zone
from ..session import cut_lineage
from .components import connected_components
from .hamming import BUCKET_ROWS, hamming_pairs
from .keyed import attach_scalars, lookup_by_key
from .ordering import number_rows

#: Edges of a component that one task settles.
TASK_EDGES = 1_000_000


def _turn() -> Column:
    return F.struct(F.col("file"), (-F.col("peak_hf")).alias("fall"), F.col("y0"), F.col("x0"), F.col("region_no"))


def _settled_in_task(edges: pd.DataFrame) -> pd.DataFrame:
    """First fit over one component: `descriptor, leader` of every node. Edges are `later, earlier` with their ranks."""
    earlier: dict[int, list[tuple[int, int]]] = {}
    rank = dict(zip(edges["earlier"], edges["earlier_rank"]))
    rank.update(zip(edges["later"], edges["later_rank"]))
    for node, other, place in zip(edges["later"], edges["earlier"], edges["earlier_rank"]):
        earlier.setdefault(node, []).append((place, other))
    leader: dict[int, int] = {}
    for node in sorted(rank, key=rank.get):
        fits = [(place, other) for place, other in earlier.get(node, ()) if leader[other] == other]
        leader[node] = min(fits)[1] if fits else node
    return pd.DataFrame({"descriptor": list(leader), "leader": list(leader.values())}, dtype="int64")


def _settled_in_rounds(edges: DataFrame) -> DataFrame:
    """The same for components beyond one task: each round settles every node whose earlier neighbours are settled."""
    waiting = edges.select(F.col("later").alias("descriptor")).distinct()
    leaders = edges.select(F.col("earlier").alias("descriptor")).distinct().join(waiting.hint("merge"), "descriptor", "left_anti")
    open_rows = waiting
    while True:
        followers = (edges.join(leaders.select(F.col("descriptor").alias("earlier")).hint("merge"), "earlier", "left_semi")
                     .select(F.col("later").alias("descriptor")).distinct())
        open_rows = cut_lineage(open_rows.join(followers.hint("merge"), "descriptor", "left_anti"))
        if open_rows.isEmpty():
            break
        blocked = (edges.join(open_rows.select(F.col("descriptor").alias("earlier")).hint("merge"), "earlier", "left_semi")
                   .select(F.col("later").alias("descriptor")).distinct())
        fresh = open_rows.join(blocked.hint("merge"), "descriptor", "left_anti")
        leaders = cut_lineage(leaders.unionByName(fresh))
        open_rows = open_rows.join(leaders.hint("merge"), "descriptor", "left_anti")
    earliest = (edges.join(leaders.select(F.col("descriptor").alias("earlier")).hint("merge"), "earlier", "left_semi")
                .groupBy(F.col("later").alias("descriptor")).agg(F.min_by("earlier", "earlier_rank").alias("leader")))
    own = leaders.select("descriptor", F.col("descriptor").alias("leader"))
    return own.unionByName(earliest.join(leaders.hint("merge"), "descriptor", "left_anti"))


def first_fit_leaders(candidates: DataFrame, config: PatternConfig = PatternConfig(), *,
                      bucket_rows: int = BUCKET_ROWS, task_edges: int = TASK_EDGES) -> DataFrame:
    """A8.4 `descriptor, leader`: the same assignment as joining the first cluster that is close enough.

    In order of first appearance a descriptor leads when no earlier leader is within the tolerance;
    everyone else follows their earliest leader. Only descriptors of one connected component decide on each other, so
    components of up to `task_edges` edges are settled one by one inside tasks, long chains included; only larger ones
    take rounds over the whole table.
    """
    turns = candidates.where("descriptor is not null").groupBy("descriptor").agg(F.min(_turn()).alias("turn"))
    first = cut_lineage(number_rows(turns, [F.col("turn")], "rank").select("descriptor", "rank"))
    pairs = hamming_pairs(first, config.hamming_tolerance, column="descriptor", bucket_rows=bucket_rows)
    a = first.select(F.col("descriptor").alias("hash_a"), F.col("rank").alias("rank_a"))
    b = first.select(F.col("descriptor").alias("hash_b"), F.col("rank").alias("rank_b"))
    earlier_a = F.col("rank_a") < F.col("rank_b")
    edges = cut_lineage(pairs.join(a.hint("merge"), "hash_a").join(b.hint("merge"), "hash_b").select(
        F.when(earlier_a, F.col("hash_b")).otherwise(F.col("hash_a")).alias("later"),
        F.when(earlier_a, F.col("hash_a")).otherwise(F.col("hash_b")).alias("earlier"),
        F.greatest("rank_a", "rank_b").alias("later_rank"), F.least("rank_a", "rank_b").alias("earlier_rank")))
    component = connected_components(edges, "later", "earlier")
    placed = edges.join(component.withColumnRenamed("node", "later").hint("merge"), "later")
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    placed = cut_lineage(lookup_by_key(placed, sizes, ["component"], size="_n", spread=[F.col("later"), F.col("earlier")]))
    settled = placed.where(F.col("_n") <= task_edges).drop("_n").groupBy("component").applyInPandas(
        _settled_in_task, "descriptor long, leader long")
    giant = placed.where(F.col("_n") > task_edges)
    if not giant.isEmpty():
        settled = settled.unionByName(_settled_in_rounds(giant.drop("_n", "component")))
    settled = cut_lineage(settled)
    alone = first.select("descriptor").join(settled.hint("merge"), "descriptor", "left_anti")
    return settled.unionByName(alone.select("descriptor", F.col("descriptor").alias("leader")))


def assign_leaders(candidates: DataFrame, leaders: DataFrame) -> DataFrame:
    """Candidates with their pattern leader (null without a descriptor)."""
    sizes = candidates.groupBy("descriptor").agg(F.count(F.lit(1)).alias("_n"))
    stats = leaders.join(sizes.hint("merge"), "descriptor")
    looked = lookup_by_key(candidates, stats, ["descriptor"], size="_n", spread=[F.col("file"), F.col("region_no")])
    return looked.drop("_n")


def pattern_members(assigned: DataFrame) -> DataFrame:
    """One member per pattern and file: its first candidate in processing order."""
    first = F.min(F.struct((-F.col("peak_hf")).alias("fall"), "y0", "x0", "region_no", "cx", "cy", "peak_hf"))
    return (assigned.where("leader is not null").groupBy("leader", "file").agg(first.alias("m"))
            .select("leader", "file", "m.cx", "m.cy", "m.peak_hf"))


def patterns(members: DataFrame, assessed: DataFrame, config: PatternConfig = PatternConfig()) -> DataFrame:
    """A8.5 / A8.6 ranked patterns with support, spatial concentration and severity.

    `assessed` has one row with `images_assessed`. Centres lie on the window grid, so a group's median
    only ever holds a handful of distinct values.
    """
    grouped = (members.groupBy("leader")
               .agg(F.count(F.lit(1)).alias("image_count"), F.min("file").alias("first_file"),
                    F.avg("peak_hf").alias("mean_peak_hf"),
                    F.median("cx").alias("median_x"), F.median("cy").alias("median_y"))
               .where(F.col("image_count") >= config.min_pattern_images))
    placed = lookup_by_key(members, grouped.select("leader", "image_count", "median_x", "median_y"), ["leader"],
                           size="image_count", spread=[F.col("file")]).where("image_count is not null")
    offset = F.greatest(F.abs(F.col("cx") - F.col("median_x")), F.abs(F.col("cy") - F.col("median_y")))
    spread = placed.groupBy("leader").agg(
        F.avg((offset <= config.spatial_tolerance).cast("double")).alias("concentrated_fraction"),
        F.max(offset).alias("max_offset"))
    concentrated = F.col("concentrated_fraction") >= config.spatial_min_fraction
    base = F.when(~concentrated, "low").when(F.col("image_count") >= config.high_count, "high").otherwise("medium")
    majority = F.col("support_fraction") > config.majority_support
    rows = attach_scalars(grouped.join(spread.hint("merge"), "leader"), assessed).withColumn(
        "support_fraction", ratio(F.col("image_count"), F.col("images_assessed")))
    rows = rows.withColumn("descriptor_hex", F.lower(F.lpad(F.hex("leader"), 16, "0")))
    ranked = number_rows(rows, [F.desc("image_count"), F.col("first_file"), F.col("descriptor_hex")], "rank")
    return ranked.select(
        F.format_string("P%03d", F.col("rank") + 1).alias("pattern_id"), "leader", "descriptor_hex", "image_count",
        "first_file", "support_fraction", "mean_peak_hf", "median_x", "median_y",
        zone(F.col("median_x"), F.col("median_y")).alias("zone"), "concentrated_fraction", "max_offset",
        concentrated.alias("concentrated"),
        F.when(majority & (base == "high"), "medium").otherwise(base).alias("severity"),
        majority.alias("majority_caveat"))


def class_evidence(members: DataFrame, ranked: DataFrame, labels: DataFrame,
                   config: PatternConfig = PatternConfig()) -> DataFrame:
    """A8.7 association of each pattern with one class; labels are `file, label` of assessed files.

    All members count, not only the first listed ones.
    """
    totals = labels.groupBy(F.col("label").alias("top_class")).agg(F.count(F.lit(1)).alias("top_class_total"))
    labelled = labels.agg(F.count(F.lit(1)).alias("labelled_total"))
    counted = (members.join(labels.hint("merge"), "file").groupBy("leader", "label").agg(F.count(F.lit(1)).alias("n")))
    top = (counted.groupBy("leader")
           .agg(F.sum("n").alias("labelled_member_count"), F.max(F.struct("n", "label")).alias("top"))
           .where(F.col("labelled_member_count") >= config.min_pattern_images))
    joined = (ranked.select("pattern_id", "leader").join(top.hint("merge"), "leader")
              .select("pattern_id", F.col("top.label").alias("top_class"), "labelled_member_count",
                      F.col("top.n").alias("top_class_member_count"))
              .join(totals, "top_class"))
    joined = attach_scalars(joined, labelled)
    share = F.col("top_class_member_count") / F.col("labelled_member_count")
    prior = F.col("top_class_total") / F.col("labelled_total")
    p_value = hypergeometric_tail_udf("top_class_member_count", "labelled_member_count", "top_class_total", "labelled_total")
    return (joined.withColumn("p_value", p_value)
            .select("pattern_id", "top_class", "labelled_member_count", "top_class_member_count", "top_class_total",
                    "labelled_total", share.alias("member_share"), prior.alias("class_prior"),
                    (share / prior).alias("enrichment"), "p_value",
                    ((share >= config.class_min_share) & (F.col("p_value") <= config.class_max_p)).alias("disproportionate")))


def candidate_findings(assigned: DataFrame, ranked: DataFrame) -> DataFrame:
    """A8.8 one finding per candidate with its code and severity."""
    stats = ranked.select("leader", "pattern_id", "image_count", "concentrated", F.col("severity").alias("pattern_severity"))
    looked = lookup_by_key(assigned, stats, ["leader"], size="image_count", spread=[F.col("file"), F.col("region_no")])
    alone = F.col("pattern_id").isNull()
    code = (F.when(alone, "LOCALIZED_HIGH_FREQUENCY_ANOMALY")
            .when(F.col("concentrated"), "REPEATED_PATTERN_SPATIAL_CONCENTRATION")
            .otherwise("REPEATED_LOCALIZED_PATTERN"))
    severity = F.when(~alone & F.col("concentrated"), F.col("pattern_severity")).otherwise("low")
    level = F.when(alone, "observation").otherwise("heuristic")
    return looked.select("file", "region_no", "y0", "x0", code.alias("code"), severity.alias("severity"),
                         level.alias("evidence_level"), "pattern_id")


def image_totals(findings: DataFrame, ranked: DataFrame, assessed: DataFrame) -> DataFrame:
    """Totals of a pattern run: files with any candidate, files with concentrated patterns, patterns."""
    per_file = findings.groupBy("file").agg(
        F.max((F.col("code") == "REPEATED_PATTERN_SPATIAL_CONCENTRATION").cast("int")).alias("hit"))
    counts = per_file.agg(F.count(F.lit(1)).alias("images_with_localized_anomaly"),
                          F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("candidate_trigger_count"))
    return (attach_scalars(counts, assessed)
            .withColumn("repeated_pattern_count", ranked.agg(F.count(F.lit(1)).alias("n")).scalar()))
