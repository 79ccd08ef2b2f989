"""U2 / B2.1 probe inputs: named transforms of vectors, driven by a specification table.

A transform is a function from a vector column (doubles), the row's id and its parameters to a vector column, so all probes of a
row are one projection. A specification has a row for each probe: `probe, transform, params`.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import array_sum, let

SPEC = "probe string, transform string, params map<string,double>"
_STEPS = float(1 << 52)


@dataclass(frozen=True)
class Transform:
    build: Callable[..., Column]
    defaults: dict[str, float]


REGISTRY: dict[str, Transform] = {}


def transform(name: str, **defaults: float):
    """Register `fn(vector, row_id, **parameters) -> vector` under a name; every parameter has a default."""
    def wrap(fn: Callable[..., Column]) -> Callable[..., Column]:
        if name in REGISTRY:
            raise ValueError(f"transform {name} is already registered")
        REGISTRY[name] = Transform(fn, defaults)
        return fn
    return wrap


@transform("identity")
def identity(x: Column, row_id: Column) -> Column:
    return x


@transform("flip")
def flip(x: Column, row_id: Column) -> Column:
    return F.reverse(x)


@transform("scale", factor=1.0)
def scale(x: Column, row_id: Column, factor: float) -> Column:
    return F.transform(x, lambda v: v * factor)


@transform("offset", amount=0.0)
def offset(x: Column, row_id: Column, amount: float) -> Column:
    return F.transform(x, lambda v: v + amount)


@transform("contrast", factor=1.0)
def contrast(x: Column, row_id: Column, factor: float) -> Column:
    """Distance from the vector's own mean, scaled."""
    return let(x, lambda w: let(array_sum(w) / F.size(w), lambda m: F.transform(w, lambda v: m + (v - m) * factor)))


@transform("shift", by=1)
def shift(x: Column, row_id: Column, by: float) -> Column:
    """Entries move `by` places to the right, the last ones to the front."""
    return let(x, lambda w: F.transform(w, lambda v, i: F.get(w, F.pmod(i - int(by), F.size(w)))))


@transform("blur", radius=1)
def blur(x: Column, row_id: Column, radius: float) -> Column:
    """Mean of the entries within `radius` places."""
    r = int(radius)

    def near(w: Column, i: Column) -> Column:
        return let(F.slice(w, F.greatest(i - r, F.lit(0)) + 1, F.least(i + r, F.size(w) - 1) - F.greatest(i - r, F.lit(0)) + 1), lambda s: array_sum(s) / F.size(s))

    return let(x, lambda w: F.transform(w, lambda v, i: near(w, i)))


@transform("noise", sigma=1.0, seed=0)
def noise(x: Column, row_id: Column, sigma: float, seed: float) -> Column:
    """Normal noise that depends on seed, row and place only."""
    def uniform(i: Column, which: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(int(seed)), row_id, i, F.lit(which)), F.lit(1 << 52)).cast("double") + 0.5) / _STEPS

    return F.transform(x, lambda v, i: v + sigma * F.sqrt(-2 * F.log(uniform(i, 0))) * F.cos(2 * math.pi * uniform(i, 1)))


def battery(spark: SparkSession) -> DataFrame:
    """The standard ten probes over vectors."""
    rows = [("clean", "identity", {}), ("flip", "flip", {}), ("scale_down", "scale", {"factor": 0.7}), ("scale_up", "scale", {"factor": 1.3}),
            ("offset", "offset", {"amount": 0.1}), ("contrast_down", "contrast", {"factor": 0.6}), ("contrast_up", "contrast", {"factor": 1.5}),
            ("noise", "noise", {"sigma": 0.05, "seed": 1337.0}), ("blur", "blur", {"radius": 1.0}), ("shift", "shift", {"by": 2.0})]
    return spark.createDataFrame(rows, SPEC)


def checked_spec(spec: DataFrame) -> list[tuple[str, str, dict[str, float]]]:
    """The rows of a specification with all parameters, in order of the probes; a wrong one raises ValueError."""
    rows = spec.orderBy("probe").collect()  # one row for each probe that a user names
    if not rows:
        raise ValueError("a specification has at least one probe")
    out, seen = [], set()
    for r in rows:
        probe, name, given = r["probe"], r["transform"], r["params"] or {}
        if not probe or probe in seen:
            raise ValueError(f"probe names are unique and not empty: {probe!r}")
        if name not in REGISTRY:
            raise ValueError(f"probe {probe}: there is no transform {name!r}; known are {', '.join(sorted(REGISTRY))}")
        known = REGISTRY[name].defaults
        wrong = sorted(set(given) - set(known))
        if wrong or any(v is None or not math.isfinite(v) for v in given.values()):
            raise ValueError(f"probe {probe}: parameters of {name} are finite numbers out of {sorted(known)}, given {sorted(given)}")
        seen.add(probe)
        out.append((probe, name, {**known, **given}))
    return out


def probe_inputs(rows: DataFrame, spec: DataFrame, *, row_id: str, vector: str) -> DataFrame:
    """`probe, row_id, vector` of every row and probe. Null vectors stay null."""
    probes = checked_spec(spec)
    x = F.col(vector).cast("array<double>")
    made = F.array(*[F.struct(F.lit(p).alias("probe"), REGISTRY[name].build(x, F.col(row_id), **params).alias(vector)) for p, name, params in probes])
    return rows.select(row_id, F.explode(made).alias("_p")).select("_p.probe", row_id, f"_p.{vector}")
