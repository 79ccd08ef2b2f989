"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import SEVERITIES, ZONES


def clean_text(value: Column) -> Column:
    """Control characters dropped, blanks trimmed, null as empty text."""
    return F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\x00-\x1f\x7f]", ""))


def exif_epoch(value: Column) -> Column:
    """Seconds since 1970 of `yyyy:MM:dd HH:mm:ss`, null when it does not parse. Session zone must be UTC."""
    text = F.substring(clean_text(value), 1, 19)
    return F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")).cast("double")


def iso_time(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot, empty when the name has none (a leading dot is no suffix)."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+?(\.[^.]*)$", 1))


def file_stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")


def path_order(path: Column) -> Column:
    """Sort key by path parts, so that `a/b` comes before `a-b`."""
    return F.split(path, "/")


def zone(x: Column, y: Column) -> Column:
    def third(value: Column, names) -> Column:
        return (F.when(value < F.lit(1 / 3), names[0])
                .when(value < F.lit(2 / 3), names[1]).otherwise(names[2]))

    rows = [third(x, [F.lit(n) for n in names]) for names in ZONES]
    return third(y, rows)


def severity_rank(value: Column) -> Column:
    """Position in none < low < medium < high < critical; 0 for anything else."""
    ranks = F.create_map(*[F.lit(item) for pair in enumerate(SEVERITIES) for item in reversed(pair)])
    return F.coalesce(F.try_element_at(ranks, F.lower(F.trim(value))), F.lit(0))


def severity_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), rank.cast("int"))


def known_severity(value: Column, default: str) -> Column:
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin(*SEVERITIES), text).otherwise(F.lit(default))
