"""Numeric helpers as column expressions, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once per row.

    An outer expression used inside a lambda is computed again for every element; a lambda variable
    is not.
    """
    return F.transform(F.array(value), body)[0]


def safe_float(value: Column) -> Column:
    """Number as double; null, NaN and infinities become 0."""
    number = value.cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    return F.when(usable, number).otherwise(F.lit(0.0))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))  # least and greatest skip nulls


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def dot(left: Column, right: Column) -> Column:
    return array_sum(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")))


def norm(values: Column) -> Column:
    return F.sqrt(dot(values, values))


def cosine_similarity(left: Column, right: Column) -> Column:
    """Cosine clipped to [-1, 1]; null when either vector is zero."""
    return let(F.try_divide(dot(left, right), norm(left) * norm(right)), lambda c: clamp(c, -1.0, 1.0))


def cosine_distance(left: Column, right: Column) -> Column:
    """1 - cosine; 1 when either vector is zero."""
    return F.coalesce(F.lit(1.0) - cosine_similarity(left, right), F.lit(1.0))


def softmax(logits: Column) -> Column:
    def powers(x: Column) -> Column:
        return let(F.array_max(x).cast("double"), lambda top: F.transform(
            x, lambda v: F.exp(F.greatest(v.cast("double") - top, F.lit(-700.0)))))

    def share(e: Column) -> Column:
        return let(array_sum(e), lambda total: F.transform(e, lambda v: v / total))

    return let(let(logits, powers), share)


def normalize_probabilities(values: Column) -> Column:
    """Row divided by its sum; null where an entry is negative or not finite, or the sum is 0."""
    def share(p: Column) -> Column:
        good = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x != F.lit(float("inf"))))
        return let(array_sum(p), lambda total: F.when(good & (total > 0), F.transform(p, lambda x: x.cast("double") / total)))

    return let(values, share)


def argmax(values: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def entropy_nats(probabilities: Column) -> Column:
    return F.abs(F.aggregate(
        probabilities, F.lit(0.0),
        lambda acc, p: acc - F.when(p > 0, p * F.ln(p)).otherwise(F.lit(0.0)),
    ))


def total_variation(left: Column, right: Column) -> Column:
    """Half the L1 distance of two aligned vectors."""
    return F.lit(0.5) * array_sum(F.zip_with(left, right, lambda a, b: F.abs(a - b)))


def histogram_bin(value: Column, bins: int) -> Column:
    """Bin of a value in [0, 1] with the last bin closed; null outside the range."""
    inside = (value >= 0) & (value <= 1)
    return F.when(inside, F.least(F.floor(value * bins), F.lit(bins - 1)).cast("int"))


def hamming(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseXOR(right))


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)
