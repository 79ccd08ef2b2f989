"""A5 label consistency: annotation files parsed, validated and compared between similar images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, cosine_similarity, norm
from ..session import cut_lineage
from .keyed import attach_scalars, lookup_by_key
from .near_duplicates import THRESHOLD
from .hamming import BUCKET_ROWS, hamming_pairs

SIMILARITY = 0.90
_NAMES = ("x_center", "y_center", "width", "height")


def _line_errors(line: Column, num_classes: int | None) -> Column:
    """Error texts of one numbered line, in check order."""
    head = F.concat(F.lit("Line "), line["no"].cast("string"), F.lit(": "))
    count = F.size(line["parts"])
    cls = line["class_id"]
    wrong_count = F.concat(head, F.lit("expected 5 values, found "), count.cast("string"), F.lit("."))
    not_numeric = F.concat(head, F.lit("non-numeric annotation values."))
    checks = [F.when(cls < 0, F.concat(head, F.lit("negative class ID "), cls.cast("string"), F.lit(".")))]
    if num_classes is not None:
        checks.append(F.when(cls >= num_classes, F.concat(
            head, F.lit("class ID "), cls.cast("string"),
            F.lit(f" is outside configured class range 0-{num_classes - 1}."))))
    for name in _NAMES:
        outside = ~line[name].between(0.0, 1.0) | F.isnan(line[name])
        checks.append(F.when(outside, F.concat(
            head, F.lit(f"{name}="), line[name].cast("string"), F.lit(" is outside [0, 1]."))))
    for name in ("width", "height"):
        checks.append(F.when(line[name] <= 0, F.concat(head, F.lit(f"{name} must be greater than zero."))))
    ranged = F.filter(F.array(*checks), lambda e: e.isNotNull())
    return (F.when(count != 5, F.array(wrong_count))
            .when(~line["numeric"], F.array(not_numeric)).otherwise(ranged))


def parse_labels(files: DataFrame, num_classes: int | None = None) -> DataFrame:
    """A5.1 parse `image, text` (text null = no label file).

    Gives `image, exists, empty, valid, errors, annotations, class_set, signature`. Lines of the wrong
    length or with non-numeric values are reported and skipped; lines out of range are reported and kept.
    """
    raw = F.filter(F.transform(F.split("text", r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    numbered = F.transform("raw", lambda x, i: F.struct(i + 1, F.split(x, r"\s+")))

    def typed(row: Column) -> Column:
        parts = row["col2"]
        values = [F.get(parts, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(_NAMES, start=1)]
        cls = F.get(parts, F.lit(0)).try_cast("int")
        numeric = cls.isNotNull()
        for i in range(1, 5):
            numeric = numeric & F.get(parts, F.lit(i)).try_cast("double").isNotNull()
        return F.struct(row["col1"].alias("no"), parts.alias("parts"), cls.alias("class_id"), *values,
                        numeric.alias("numeric"))

    base = files.withColumn("raw", F.coalesce(raw, F.array().cast("array<string>")))
    base = base.withColumn("lines", F.transform(numbered, typed))
    kept = F.filter("lines", lambda x: (F.size(x["parts"]) == 5) & x["numeric"])
    exists = F.col("text").isNotNull()
    errors = F.when(~exists, F.array(F.lit("Missing label file."))).otherwise(
        F.flatten(F.transform("lines", lambda x: _line_errors(x, num_classes))))
    parsed = base.select(
        "image", exists.alias("exists"), (exists & (F.size("raw") == 0)).alias("empty"), errors.alias("errors"),
        F.transform(kept, lambda x: F.struct(
            x["class_id"].alias("class_id"), *[x[n].alias(n) for n in _NAMES])).alias("annotations"))
    return parsed.select(
        "image", "exists", "empty", (F.size("errors") == 0).alias("valid"), "errors", "annotations",
        F.array_sort(F.array_distinct(F.transform("annotations", lambda a: a["class_id"]))).alias("class_set"),
        F.array_sort(F.transform("annotations", lambda a: F.struct(
            a["class_id"].alias("class_id"), *[F.bround(a[n], 4).alias(n) for n in _NAMES]))).alias("signature"))


def label_states(images: DataFrame, parsed: DataFrame) -> DataFrame:
    """A5.2 every image with its label state: missing, malformed, empty or ok."""
    state = (F.when(F.col("valid").isNull() | ~F.col("exists"), "missing").when(~F.col("valid"), "malformed")
             .when(F.col("empty"), "empty").otherwise("ok"))
    return images.select("image").join(parsed, "image", "left").select("image", state.alias("label_state"), "errors")


def ambiguous_stems(images: DataFrame, stem: Column) -> DataFrame:
    """Stems shared by several images: such a label file belongs to more than one image."""
    return (images.groupBy(stem.alias("stem")).agg(F.count(F.lit(1)).alias("image_count")).where("image_count > 1"))


def appearance_similarity(left: Column, right: Column) -> Column:
    """A5.5 cosine of two appearance vectors clipped to [0, 1], 0 when either is zero."""
    return F.coalesce(clamp(cosine_similarity(left, right)), F.lit(0.0))


def label_profiles(images: DataFrame) -> DataFrame:
    """Images with the same hash, class set and appearance collapse to one profile with its file count.

    Input: `image, hash, class_set, features` of valid, non-empty labels.
    """
    return (images.groupBy("hash", "class_set", "features")
            .agg(F.count(F.lit(1)).alias("files"), F.min("image").alias("image"))
            .withColumn("profile", F.sha2(F.to_json(F.struct("hash", "class_set", "features", "image")), 256)))


def _ringed(profiles: DataFrame, similarity: float) -> DataFrame:
    """Profiles with the ring of their distance to one fixed profile.

    On unit vectors a cosine of at least `similarity` is a chord of at most sqrt(2 - 2 similarity), so by the triangle
    inequality similar profiles lie in the same ring of that width or in neighbouring ones. Zero vectors are similar to nothing.
    """
    usable = profiles.where(norm(F.col("features")) > 0)
    pivot = usable.agg(F.min_by("features", "profile").alias("pivot"))  # one vector
    cosine = F.coalesce(cosine_similarity(F.col("features"), F.col("pivot")), F.lit(0.0))
    width = (2 - 2 * similarity) ** 0.5 + 1e-6
    return attach_scalars(usable, pivot).withColumn("ring", F.floor(F.sqrt(2 - 2 * cosine) / width)).drop("pivot")


def conflicting_profiles(profiles: DataFrame, *, threshold: int = THRESHOLD, similarity: float = SIMILARITY,
                         bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A5.6 pairs of profiles within the hash threshold whose class sets differ and appearance agrees.

    `conflict_pairs` is the number of image pairs a row stands for. Copies are already one profile, so
    a group of equal images adds one row per differing label, not one per pair of copies. Of the appearances under one
    hash only those in neighbouring rings around a fixed one meet (see `_ringed`).
    """
    near = hamming_pairs(profiles, threshold, bucket_rows=bucket_rows)
    hashes = profiles.select("hash").distinct()
    links = (near.unionByName(near.select(F.col("hash_b").alias("hash_a"), F.col("hash_a").alias("hash_b"), "hamming_distance"))
             .unionByName(hashes.select(F.col("hash").alias("hash_a"), F.col("hash").alias("hash_b"),
                                        F.lit(0).alias("hamming_distance"))))
    side = ["profile", "image", "class_set", "features", "files"]
    ringed = cut_lineage(_ringed(profiles, similarity)) if similarity > 0 else profiles.withColumn("ring", F.lit(0).cast("long"))
    near_rings = F.explode(F.sequence(F.col("ring") - 1, F.col("ring") + 1))
    a = ringed.select(F.col("hash").alias("hash_a"), *[F.col(c).alias(f"{c}_a") for c in side], near_rings.alias("ring"))
    b = ringed.select(F.col("hash").alias("hash_b"), "ring", *[F.col(c).alias(f"{c}_b") for c in side])
    alike = appearance_similarity(F.col("features_a"), F.col("features_b"))
    once = F.struct("image_a", "profile_a") < F.struct("image_b", "profile_b")
    pairs = links.join(a, "hash_a").join(b, ["hash_b", "ring"]).where(once & (F.col("class_set_a") != F.col("class_set_b")))
    return (pairs.withColumn("similarity", alike).where(F.col("similarity") >= similarity)
            .select("profile_a", "profile_b", "image_a", "image_b", "hamming_distance", "similarity", "class_set_a",
                    "class_set_b", "files_a", "files_b", (F.col("files_a") * F.col("files_b")).alias("conflict_pairs")))


def label_totals(states: DataFrame, conflicts: DataFrame) -> DataFrame:
    """A5.7 counts per state, conflicting pairs and their sum."""
    counts = states.agg(*[F.count_if(F.col("label_state") == s).alias(f"{s}_label_count")
                          for s in ("missing", "malformed", "empty")])
    pairs = conflicts.agg(F.coalesce(F.sum("conflict_pairs"), F.lit(0)).cast("long").alias("n")).scalar()
    whole = counts.withColumn("conflicting_pair_count", pairs)
    return whole.withColumn("finding_count", F.col("missing_label_count") + F.col("malformed_label_count")
                            + F.col("empty_label_count") + F.col("conflicting_pair_count"))


def profile_sides(conflicts: DataFrame, image_profiles: DataFrame) -> DataFrame:
    """Conflict rows with the images of both sides counted by an owner column.

    `image_profiles` is `profile, owner`, one row per image. Gives, per (pair, owner), how many image
    pairs the owner takes part in: n_a*N_b + N_a*n_b - n_a*n_b.
    """
    owned = image_profiles.groupBy("profile", "owner").agg(F.count(F.lit(1)).alias("n"))
    a = (conflicts.join(owned.withColumnRenamed("profile", "profile_a"), "profile_a")
         .select("profile_a", "profile_b", "files_a", "files_b", "owner", F.col("n").alias("na"), F.lit(0).cast("long").alias("nb")))
    b = (conflicts.join(owned.withColumnRenamed("profile", "profile_b"), "profile_b")
         .select("profile_a", "profile_b", "files_a", "files_b", "owner", F.lit(0).cast("long").alias("na"), F.col("n").alias("nb")))
    sides = (a.unionByName(b).groupBy("profile_a", "profile_b", "files_a", "files_b", "owner")
             .agg(F.sum("na").alias("na"), F.sum("nb").alias("nb")))
    part = F.col("na") * F.col("files_b") + F.col("files_a") * F.col("nb") - F.col("na") * F.col("nb")
    return sides.select("profile_a", "profile_b", "owner", part.alias("pairs"))


def images_of_profiles(images: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each image with its profile id; a profile of many copies is spread by `lookup_by_key`."""
    keys = ["hash", "class_set", "features"]
    stats = profiles.select(*keys, "profile", "files")
    return lookup_by_key(images, stats, keys, size="files", spread=[F.col("image")])
