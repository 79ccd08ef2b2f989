"""B3 statistics of tensors and activations from chunk tables, and their comparison.

Chunks are `model_id, tensor_name, chunk_no, values array<double>`; headers are
`model_id, tensor_name, kind, trainable, shape, dtype`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TensorThresholds
from ..functions.hashing import json_list, sha256_text
from .ordering import FAN_OUT, number_rows, tree_digest

_INF = float("inf")


def tensor_statistics(chunks: DataFrame, keys: tuple[str, ...] = ("model_id", "tensor_name")) -> DataFrame:
    """B3.1 / B3.2 / B3.5 counts and moments; mean, std, min and max are over finite values.

    Values are aggregated map-side with mergeable moments, so one large tensor is no hot spot.
    """
    v = F.col("v")
    finite = F.when(~F.isnan(v) & (F.abs(v) != _INF), v)
    rows = chunks.select(*keys, F.explode("values").alias("v"))
    aggs = [
        F.count(F.lit(1)).alias("element_count"), F.count(finite).alias("finite_count"),
        F.count_if(F.isnan(v)).alias("nan_count"), F.count_if(v == _INF).alias("posinf_count"),
        F.count_if(v == -_INF).alias("neginf_count"), F.count_if(v == 0.0).alias("zero_count"),
        F.avg(finite).alias("mean"), F.stddev_pop(finite).alias("std"), F.min(finite).alias("min"), F.max(finite).alias("max"),
    ]
    stats = rows.groupBy(*keys).agg(*aggs)
    return (stats.withColumn("non_finite_count", F.col("nan_count") + F.col("posinf_count") + F.col("neginf_count"))
            .withColumn("zero_fraction", F.try_divide(F.col("zero_count").cast("double"), F.col("element_count"))))


def exact_percentiles(chunks: DataFrame, percentiles: tuple[float, ...], keys: tuple[str, ...] = ("model_id", "tensor_name")) -> DataFrame:
    """B3.3 percentiles of the finite values with linear interpolation.

    All values are numbered once in (key, value) order, so a large tensor is many range partitions, and only the ranks
    on either side of each percentile are picked.
    """
    keys = list(keys)
    values = chunks.select(*keys, F.explode("values").alias("v")).where(~F.isnan("v") & (F.abs("v") != _INF))
    numbered = number_rows(values, [*map(F.col, keys), F.col("v")], "idx")
    groups = numbered.groupBy(*keys).agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n"))
    rank = F.col("p") / 100.0 * (F.col("n") - 1)
    wanted = (groups.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in percentiles])))
              .select(*keys, "p", (rank - F.floor(rank)).alias("share"), F.explode(F.array(F.floor(rank), F.ceil(rank))).alias("at"), "first")
              .select(*keys, "p", "share", (F.col("first") + F.col("at")).alias("idx")))
    ends = wanted.join(numbered.select("idx", "v"), "idx").groupBy(*keys, "p", "share").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("share")
    return ends.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == float(p), value)).alias(f"p{p:g}") for p in percentiles])


def with_headers(headers: DataFrame, stats: DataFrame, keys: tuple[str, ...] = ("model_id", "tensor_name")) -> DataFrame:
    """Headers with statistics; a tensor without elements has zero counts and null statistics."""
    counts = [c for c in stats.columns if c.endswith("_count")]
    return headers.join(stats, list(keys), "left").fillna(0, counts)


def tensor_digests(chunks: DataFrame, headers: DataFrame, *, fan_out: int = FAN_OUT) -> DataFrame:
    """B3.1 digest per tensor over dtype, shape and all values in chunk order, as hexadecimal text that keeps every bit.

    Each chunk is hashed where it lies, the chunk digests by tree_digest, and dtype and shape enter the final hash.
    """
    def text(v: Column) -> Column:
        return (F.when(F.isnan(v), "nan").when(v == _INF, "inf").when(v == -_INF, "-inf")
                .otherwise(F.format_string("%a", v)))

    item = F.concat(F.lit('"'), sha256_text(F.array_join(F.transform("values", text), ",")), F.lit('"'))
    tree = tree_digest(chunks.select("model_id", "tensor_name", F.col("chunk_no").alias("idx"), item.alias("item")),
                       ["model_id", "tensor_name"], fan_out=fan_out)
    shape = F.concat(F.lit("["), F.array_join(F.transform("shape", lambda n: n.cast("string")), ","), F.lit("]"))
    joined = tree.join(headers.select("model_id", "tensor_name", "dtype", shape.alias("shape")), ["model_id", "tensor_name"])
    return joined.select("model_id", "tensor_name", sha256_text(F.concat_ws("|", "dtype", "shape", "digest")).alias("digest_sha256"))


def model_totals(tensors: DataFrame) -> DataFrame:
    """B3.4 rollup per model from headers with `element_count`."""
    parameter, buffer = F.col("kind") == "parameter", F.col("kind") == "buffer"
    elements = F.col("element_count")
    known = F.count_if(parameter & F.col("trainable").isNull()) == 0
    total = lambda cond: F.coalesce(F.sum(F.when(cond, elements)), F.lit(0)).cast("long")
    return tensors.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("tensor_count"), F.count_if(parameter).alias("parameter_tensor_count"),
        F.count_if(buffer).alias("buffer_tensor_count"), total(parameter).alias("total_parameter_count"),
        F.when(known, total(parameter & F.col("trainable"))).alias("trainable_parameter_count"),
        F.when(known, total(parameter & ~F.col("trainable"))).alias("non_trainable_parameter_count"),
        total(buffer).alias("buffer_element_count"), F.count_if(elements == 0).alias("empty_tensor_count"),
        F.max(F.struct("element_count", "tensor_name")).alias("_largest"),
    ).withColumn("largest_tensor", F.col("_largest.tensor_name")).drop("_largest")


def layout_digests(tensors: DataFrame) -> DataFrame:
    """B3.4 digest per model over name, kind, shape and dtype of its tensors in name order (headers only)."""
    shape = F.concat(F.lit("["), F.array_join(F.transform("shape", lambda s: s.cast("string")), ","), F.lit("]"))
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    row = F.concat(F.lit("["), F.concat_ws(",", quoted("tensor_name"), quoted("kind"), shape, quoted("dtype")), F.lit("]"))
    return tensors.groupBy("model_id").agg(
        sha256_text(json_list(F.transform(F.array_sort(F.collect_list(F.struct("tensor_name", row.alias("row")))),
                                          lambda x: x["row"]))).alias("layout_digest"))


def dtype_distribution(tensors: DataFrame) -> DataFrame:
    return tensors.groupBy("model_id", "dtype").agg(
        F.count(F.lit(1)).alias("tensor_count"), F.sum("element_count").alias("element_count"))


def rank_distribution(tensors: DataFrame) -> DataFrame:
    return tensors.groupBy("model_id", F.size("shape").alias("tensor_rank")).agg(F.count(F.lit(1)).alias("tensor_count"))


def layer_calls(layers: DataFrame, calls: DataFrame) -> DataFrame:
    """B3.5 each declared layer with its call count and whether its output shape stayed the same."""
    seen = calls.groupBy("layer").agg(F.count(F.lit(1)).alias("call_count"), F.countDistinct("output_shape").alias("shapes"))
    return layers.select("layer").join(seen, "layer", "left").select(
        "layer", F.coalesce("call_count", F.lit(0)).alias("call_count"), F.col("call_count").isNotNull().alias("called"),
        (F.col("shapes") == 1).alias("shape_consistent"))


def pooled_statistics(chunks: DataFrame) -> DataFrame:
    """B3.9 one row over all stored constants of a model."""
    return tensor_statistics(chunks, ("model_id",))


def _metrics(names: dict[str, tuple[str, float, str | None]], eps: float) -> Column:
    """Array of metric structs: name -> (basis, threshold, scale column)."""
    items = []
    for name, (basis, threshold, scale) in names.items():
        r, a = F.col(f"r_{name}").cast("double"), F.col(name).cast("double")
        absolute = F.abs(a - r)
        relative = absolute / F.greatest(F.abs(r), F.lit(eps))
        normalized = absolute / (F.coalesce(F.col(scale), F.lit(0.0)) + eps) if scale else F.lit(None).cast("double")
        used = {"absolute": absolute, "relative": relative, "normalized": normalized}[basis]
        missing = r.isNull() != a.isNull()
        items.append(F.when(r.isNotNull() | a.isNotNull(), F.struct(
            F.lit(name).alias("metric"), r.alias("reference"), a.alias("assessed"), absolute.alias("absolute_difference"),
            relative.alias("relative_difference"), normalized.alias("normalized_difference"), F.lit(basis).alias("basis"),
            F.lit(float(threshold)).alias("threshold"), (missing | F.coalesce(used > threshold, F.lit(False))).alias("exceeded"),
            missing.alias("missing_statistic"))))
    return F.filter(F.array(*items), lambda m: m.isNotNull())


_STATS = ("mean", "std", "zero_fraction", "min", "max", "nan_count", "posinf_count", "neginf_count")


def compare_statistics(reference: DataFrame, assessed: DataFrame, *, key: str = "tensor_name", activations: bool = False,
                       percentiles: tuple[str, ...] = (), thresholds: TensorThresholds = TensorThresholds()) -> DataFrame:
    """B3.6 statistics of two models matched by name, one row per metric; shapes must agree to compare.

    Both sides carry the statistics and `shape`, `dtype`.
    """
    t, prefix = thresholds, "activation" if activations else "param"
    get = lambda name: getattr(t, f"{prefix}_{name}")
    spec = {
        "mean": ("normalized", get("mean_norm_diff"), "r_std"), "std": ("relative", get("std_rel_diff"), None),
        "zero_fraction": ("absolute", get("zero_fraction_abs_diff"), None),
        "min": ("normalized", get("extreme_norm_diff"), "r_span"), "max": ("normalized", get("extreme_norm_diff"), "r_span"),
        **{c: ("absolute", t.non_finite_count_abs_diff, None) for c in ("nan_count", "posinf_count", "neginf_count")},
        **{p: ("normalized", t.activation_percentile_norm_diff, "r_std") for p in percentiles},
    }
    names = [*_STATS, *percentiles]
    r = reference.select(key, F.col("shape").alias("r_shape"), F.col("dtype").alias("r_dtype"), *[F.col(n).alias(f"r_{n}") for n in names])
    joined = assessed.select(key, "shape", "dtype", *names).join(r, key).where(F.col("shape") == F.col("r_shape"))
    joined = joined.withColumn("r_span", F.col("r_max") - F.col("r_min"))
    return joined.select(key, F.explode(_metrics(spec, t.eps)).alias("m")).select(key, "m.*")


def compare_presence(reference: DataFrame, assessed: DataFrame, metrics: DataFrame, *, key: str = "tensor_name") -> DataFrame:
    """B3.6 one row per name: on one side only, shape or dtype mismatch, and the metrics over threshold."""
    r = reference.select(key, F.lit(True).alias("in_r"), F.col("shape").alias("r_shape"), F.col("dtype").alias("r_dtype"))
    a = assessed.select(key, F.lit(True).alias("in_a"), F.col("shape").alias("a_shape"), F.col("dtype").alias("a_dtype"))
    hits = metrics.where("exceeded").groupBy(key).agg(F.array_sort(F.collect_list("metric")).alias("hit"))
    both = F.col("in_r").isNotNull() & F.col("in_a").isNotNull()
    shapes = both & (F.col("r_shape") != F.col("a_shape"))
    side = (F.when(F.col("in_a").isNull(), "only_reference").when(F.col("in_r").isNull(), "only_assessed")
            .when(shapes, "shape_mismatch").otherwise("compared"))
    none = F.array().cast("array<string>")
    flags = (F.when(side != "compared", F.when(shapes, F.array(F.lit("shape_mismatch"))).otherwise(none))
             .otherwise(F.array_sort(F.concat(
                 F.when(F.col("r_dtype") != F.col("a_dtype"), F.array(F.lit("dtype_mismatch"))).otherwise(none),
                 F.coalesce("hit", none)))))
    return (r.join(a, key, "full").join(hits, key, "left")
            .select(key, side.alias("match_state"), flags.alias("flags"), (F.size(flags) > 0).alias("flagged")))


def compare_structure(reference: DataFrame, assessed: DataFrame, thresholds: TensorThresholds = TensorThresholds()) -> DataFrame:
    """B3.7 totals and layout digests of two one-row rollups, one row per item."""
    counts = ("tensor_count", "parameter_tensor_count", "buffer_tensor_count", "total_parameter_count",
              "trainable_parameter_count", "non_trainable_parameter_count", "buffer_element_count")
    r = reference.select(F.struct(*[F.col(c).alias(c) for c in (*counts, "layout_digest")])).scalar()
    joined = assessed.withColumn("r", r).select(
        *counts, "layout_digest", *[F.col("r")[c].alias(f"r_{c}") for c in (*counts, "layout_digest")])
    spec = {c: ("relative", thresholds.count_rel_diff, None) for c in counts}
    items = joined.select(F.explode(_metrics(spec, thresholds.eps)).alias("m")).select(
        F.col("m.metric").alias("item"), F.col("m.reference").cast("string").alias("reference"),
        F.col("m.assessed").cast("string").alias("assessed"), "m.exceeded")
    layout = joined.where("layout_digest is not null and r_layout_digest is not null").select(
        F.lit("parameter_layout_digest").alias("item"), F.col("r_layout_digest").alias("reference"),
        F.col("layout_digest").alias("assessed"), (F.col("layout_digest") != F.col("r_layout_digest")).alias("exceeded"))
    return items.unionByName(layout)


def module_type_changes(reference: DataFrame, assessed: DataFrame) -> DataFrame:
    """B3.7 module types whose counts differ, from `module_type, n`."""
    r = reference.select("module_type", F.col("n").alias("reference"))
    a = assessed.select("module_type", F.col("n").alias("assessed"))
    return r.join(a, "module_type", "full").fillna(0).where("reference <> assessed")


def comparison_summary(presence: DataFrame, structure: DataFrame, layers: DataFrame | None = None) -> DataFrame:
    """B3.8 compatibility ladder and anomaly counts of a comparison."""
    def section(frame: DataFrame, what: str) -> DataFrame:
        state = F.col("match_state")
        common = F.count_if(state.isin("compared", "shape_mismatch"))
        return frame.agg(
            F.when((F.count(F.lit(1)) > 0) & (common == 0), "incompatible")
            .when(F.count_if(state != "compared") > 0, "partially_compatible").otherwise("compatible").alias(f"{what}_status"),
            F.count_if("flagged").alias(f"flagged_{what}_count"), F.count_if(state == "compared").alias(f"compared_{what}_count"),
            F.count_if(state.isin("only_reference", "only_assessed")).alias(f"unmatched_{what}_count"))

    summary = section(presence, "tensor")
    if layers is not None:
        summary = summary.withColumn("l", section(layers, "layer").select(F.struct("*")).scalar()).select(
            *summary.columns, "l.*")
    else:
        summary = summary.withColumns({"layer_status": F.lit("not_requested"), "flagged_layer_count": F.lit(0).cast("long"),
                                       "compared_layer_count": F.lit(0).cast("long"), "unmatched_layer_count": F.lit(0).cast("long")})
    summary = summary.withColumn("flagged_structure_item_count", structure.agg(F.count_if("exceeded")).scalar())
    comparable = lambda c: F.col(c).isin("compatible", "partially_compatible")
    fully = lambda c: F.col(c).isin("compatible", "not_requested")
    overall = (F.when(~comparable("tensor_status") & ~comparable("layer_status"), "incompatible")
               .when(fully("tensor_status") & fully("layer_status"), "compatible").otherwise("partially_compatible"))
    total = (F.col("flagged_tensor_count") + F.col("flagged_layer_count") + F.col("flagged_structure_item_count")
             + F.col("unmatched_tensor_count") + F.col("unmatched_layer_count"))
    return summary.withColumn("compatibility_status", overall).withColumn("candidate_anomaly_count", total).withColumn(
        "requires_review", total > 0)
