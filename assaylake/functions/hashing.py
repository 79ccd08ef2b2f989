"""Digests and canonical JSON as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_text(value: Column | str) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.sha2(column.cast("binary"), 256)


def canonical_json(**fields: Column | str) -> Column:
    """JSON object with sorted keys, no blanks and explicit nulls.

    Nested structs must already be sorted. Floating numbers should be formatted first, their text
    differs between systems.
    """
    columns = [
        (F.col(value) if isinstance(value, str) else value).alias(name)
        for name, value in sorted(fields.items())
    ]
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def json_list(items: Column) -> Column:
    """JSON array from an array of JSON texts."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def digest_object(**fields: Column | str) -> Column:
    return sha256_text(canonical_json(**fields))


def normalize_digest(value: Column) -> Column:
    """Bare lower-case 64-hex digest, null when the text is not one."""
    bare = F.regexp_replace(F.lower(F.trim(value)), "^sha256:", "")
    return F.when(bare.rlike("^[0-9a-f]{64}$"), bare)


def short_digest(value: Column, width: int = 28) -> Column:
    """Display form: head and tail around an ellipsis when longer than `width`."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(F.length(text) <= width, text).otherwise(
        F.concat(F.left(text, F.lit(width - 11)), F.lit("…"), F.right(text, F.lit(10)))
    )
