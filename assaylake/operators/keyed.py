"""Key lookups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

HOT_ROWS = 1_000_000
SALTS = 64
HOT_KEYS = 10_000
COLD_SALTS = 4
#: Keys beyond which the small side of a lookup is sorted and merged: its files are packed and it is there COLD_SALTS times, so
#: Spark would take it for small and have the driver hold it for a broadcast.
MERGED_KEYS = 100_000


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame (totals, thresholds) as one scalar subquery."""
    packed = one_row.select(F.struct(*one_row.columns)).scalar()
    return df.withColumn("_one", packed).select(*df.columns, *[F.col("_one")[c].alias(c) for c in one_row.columns])


def lookup_by_key(
    rows: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    *,
    size: str,
    spread: Sequence[Column] | None = None,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Left join `rows` to `stats`, which has one row per key and the key's row count in `size`.

    Keys with more than `hot_rows` rows and more than one in HOT_KEYS of all rows are broadcast (HOT_KEYS of them at
    most) and their rows, like rows with a null key, are spread over `salts` tasks. All other keys meet in a shuffle join
    whose small side is there COLD_SALTS times, so rows of a key that `stats` does not know are spread as well.
    """
    keys = list(keys)
    stats = cut_lineage(stats)  # read three times below, and often made from `rows` by an aggregation
    values = [c for c in stats.columns if c not in keys]
    least = F.greatest(F.lit(hot_rows), (stats.agg(F.sum(size)).scalar() / HOT_KEYS).cast("long"))
    hot = stats.where(F.col(size) > least).select(
        *keys, F.lit(True).alias("_hot"), *[F.col(v).alias(f"_hot_{v}") for v in values])
    cold = (stats.where(F.col(size) <= least)
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(COLD_SALTS - 1)))))
    spread_by = spread or [F.col(c) for c in rows.columns]
    at = F.xxhash64(*spread_by)
    wide = F.col("_hot") | F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    salted = (rows.join(F.broadcast(hot), keys, "left")
              .withColumn("_salt", F.when(wide, F.lit(COLD_SALTS) + F.pmod(at, F.lit(salts))).otherwise(F.pmod(at, F.lit(COLD_SALTS))).cast("int")))
    joined = salted.join(cold.hint("merge") if stats.count() > MERGED_KEYS else cold, [*keys, "_salt"], "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col(f"_hot_{v}"), F.col(v)).alias(v) for v in values])
