"""Row numbers, positions in a group and ordered digests without passing all rows through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import sha256_text
from ..session import cut_lineage, shuffle_partitions
from .keyed import lookup_by_key

WINDOW_ROWS = 1_000_000
FAN_OUT = 4_096


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "row_index") -> DataFrame:
    """0-based index in the given total order.

    The rows are range-partitioned, written, numbered inside each partition and shifted by the sizes of the
    partitions before (one row for each partition).
    """
    order = list(order)
    parts = shuffle_partitions(df.sparkSession)
    ranged = (df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
              .withColumn("_part", F.spark_partition_id())
              .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    fixed = cut_lineage(ranged)
    sizes = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (fixed.join(F.broadcast(starts), "_part")
            .select(*df.columns, (F.col("_start") + F.col("_row")).alias(name)))


def position_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "pos", *,
                      window_rows: int = WINDOW_ROWS) -> DataFrame:
    """0-based position of each row in its group.

    A window per group is used when the largest group fits; otherwise all rows are numbered once in
    (key, order) and each group's first index is subtracted.
    """
    keys, order = list(keys), list(order)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    if largest <= window_rows:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(window) - 1).cast("long"))
    numbered = number_rows(df, [*[F.col(k) for k in keys], *order], "_index")
    firsts = numbered.groupBy(*keys).agg(F.min("_index").alias("_first"), F.count(F.lit(1)).alias("_n"))
    placed = lookup_by_key(numbered, firsts, keys, size="_n", spread=[F.col("_index")])
    return placed.select(*df.columns, (F.col("_index") - F.col("_first")).alias(name))


def previous_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str, *,
                      window_rows: int = WINDOW_ROWS) -> DataFrame:
    """`value` of the row just before in the group, null for the first.

    As in `position_in_group`, a window where the largest group fits; otherwise rows meet the ones placed before them.
    """
    keys, order = list(keys), list(order)
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    if largest <= window_rows:
        return df.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    placed = cut_lineage(position_in_group(df, keys, order, "_k", window_rows=window_rows))
    before = placed.select(*keys, (F.col("_k") + 1).alias("_k"), F.col(value).alias(name))
    return placed.join(before, [*keys, "_k"], "left").drop("_k")


def ordered_digest(df: DataFrame, order: Sequence[Column], item: Column, *, fan_out: int = FAN_OUT) -> DataFrame:
    """(item_count, digest) of all items in order, see tree_digest; one row."""
    order = list(order)
    keyed = df.select(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]).alias("key"), item.alias("item"))
    return tree_digest(number_rows(keyed, [F.col("key")], "idx").select("idx", "item"), fan_out=fan_out)


def tree_digest(items: DataFrame, keys: Sequence[str] = (), *, fan_out: int = FAN_OUT) -> DataFrame:
    """(keys, item_count, digest) of `idx, item` rows: three levels at every size.

    `fan_out` consecutive items are hashed as a JSON list, `fan_out` of those digests likewise, and the list of what
    that gives is hashed. So no task holds more than `fan_out` items, or one digest for each fan_out * fan_out.
    """
    keys = list(keys)
    level = items.select(*keys, "idx", "item", F.lit(1).cast("long").alias("n"))
    for _ in range(2):
        level = (level.groupBy(*keys, F.floor(F.col("idx") / fan_out).alias("idx"))
                 .agg(_list_digest().alias("digest"), F.sum("n").alias("n"))
                 .select(*keys, "idx", F.concat(F.lit('"'), F.col("digest"), F.lit('"')).alias("item"), "n"))
    return level.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("item_count"), _list_digest().alias("digest"))


def _list_digest() -> Column:
    items = F.transform(F.array_sort(F.collect_list(F.struct("idx", "item"))), lambda x: x["item"])
    return sha256_text(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))


def tree_digest_sql(source: str, order: str, item: str, keys: str = "", fan_out: int = FAN_OUT) -> str:
    """The same in SQL, as a table expression (keys, item_count, digest)."""
    k = f"{keys}, " if keys else ""
    by = f"PARTITION BY {keys} " if keys else ""
    level = lambda inner: (f"SELECT {k}i // {fan_out} AS i, '\"' || sha256('[' || string_agg(item, ',' ORDER BY i) || ']') || '\"' AS item, sum(n) AS n "
                           f"FROM ({inner}) GROUP BY {k}i // {fan_out}")
    rows = f"SELECT {k}row_number() OVER ({by}ORDER BY {order}) - 1 AS i, {item} AS item, 1 AS n FROM {source}"
    group = f" GROUP BY {keys}" if keys else ""
    return (f"(SELECT {k}CAST(coalesce(sum(n), 0) AS BIGINT) AS item_count, sha256('[' || coalesce(string_agg(item, ',' ORDER BY i), '') || ']') AS digest "
            f"FROM ({level(level(rows))}){group})")
