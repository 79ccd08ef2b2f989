"""Places of pattern matches in text, and cutting them out, in Spark's own functions.

The pieces between matches and the matches give the offsets; both come from the same left-to-right search. Patterns
must be written so that the search is linear in the text: runs possessive, starting only where a run starts, and
repeated groups of one character, which the regular-expression engine walks without recursion. Offsets are summed in
blocks, so many matches in one text stay cheap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numeric import let

BLOCK = 128
SPAN = "array<struct<start:int,end:int,match:string>>"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _block_starts(sizes: Column) -> Column:
    """Sum of all sizes before each block of BLOCK elements."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")),
                         lambda b: _sum(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))))
    return F.aggregate(blocks, F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))


def _placed(matches: Column, gaps: Column) -> Column:
    """(start, end, match) of each match from the lengths of what lies between."""
    n = F.size(matches)
    sizes = F.slice(F.zip_with(gaps, matches, lambda g, m: g + F.coalesce(F.length(m), F.lit(0))), F.lit(1), n)

    def place(sizes: Column, before: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            end = F.element_at(before, F.floor(i / BLOCK).cast("int") + 1) + _sum(F.slice(sizes, i - i % BLOCK + 1, i % BLOCK + 1))
            return let(end, lambda e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("match")))
        return F.transform(matches, one)

    return let(sizes, lambda s: let(_block_starts(s), lambda b: place(s, b)))


def matches(text: Column, pattern: str, only_if: Column) -> Column:
    """Leftmost non-overlapping matches as (start, end, match), in code points, end exclusive; text is not null.

    only_if: a cheap condition without which there is no match.
    """
    none = F.array().cast(SPAN)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    placed = let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(
        let(F.transform(F.split(text, pattern, -1), lambda g: F.length(g)), lambda g: _placed(m, g))))
    return F.when(only_if, placed).otherwise(none)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def replaced(text: Column, spans: Column, put: str = "put", block: int = 1024) -> Column:
    """The text with each span (start, end, and the field `put` to write there) replaced.

    The text is cut into blocks of code points and each block keeps what no span covers, so one long text with many
    spans is not walked again for every span. Where spans overlap, each writes its `put` at its start.
    """
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))

    def cut(b: Column, k: Column) -> Column:
        low = k * block
        own = F.filter(spans, lambda s: (s["start"] < low + block) & (s["end"] > low))

        def step(done, s):
            begin = F.greatest(s["start"] - low, done["at"])
            written = F.when(s["start"] >= low, s[put]).otherwise("")
            return F.struct(F.concat(done["out"], b.substr(done["at"] + 1, begin - done["at"]), written).alias("out"),
                            F.greatest(done["at"], F.least(s["end"] - low, F.lit(block))).alias("at"))

        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
        return F.aggregate(own, start, step, lambda d: F.concat(d["out"], b.substr(d["at"] + 1, F.lit(block))))

    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.transform(blocks, cut), ""))
