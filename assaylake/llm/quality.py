"""Quality by weak supervision: rules vote or abstain, expectation-maximisation estimates how far each can be trusted.

`text_statistics` takes one pass over the texts. Each rule turns its statistics into a vote: good, bad or none. The
votes of all documents are counted by pattern (at most 3^rules rows, whatever the corpus size) and a latent class
model is fitted on those counts: P(vote | class) for every rule and the share of the classes. The posterior probability of `good` replaces "all rules must pass".

Defined cases: null and empty texts have no words and fail the base rule; repeated rows are judged alike, each for
itself; an empty table gives an empty result; columns of any name pass through in `doc`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .staging import staged

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_letters",
              "n_upper", "n_exclaimed", "n_lettered_words", "n_span_distinct", "n_span_repeats")
#: Words of a span: distinct words and repeated windows are counted in each span of a text, so that their shares do not depend on its length.
SPAN_WORDS = 1_000
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_LETTER = _UPPER | np.isin(np.arange(256), np.arange(97, 123))
_LINE = np.arange(256) == 10


def _covered(words: int, at: np.ndarray, size: int = 3) -> np.ndarray:
    """Which words lie in a window that starts at one of the given words."""
    steps = np.zeros(words + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + size, -1) if len(at) else None
    return np.cumsum(steps[:-1]) > 0


def _in_spans(table: W.Words, hashes: np.ndarray, windows: np.ndarray, at: np.ndarray, distinct: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and words in repeated windows, summed over the spans of each row; of the whole row where it is one span."""
    words = np.diff(table.first)
    long = words > SPAN_WORDS
    if not long.any():
        return distinct, repeats
    before = np.concatenate(([0], np.cumsum(-(-words // SPAN_WORDS))))
    span = before[table.row] + (np.arange(len(hashes)) - table.first[table.row]) // SPAN_WORDS
    of_long = long[table.row]
    first = np.unique(W.in_row(hashes[of_long], span[of_long]), return_index=True)[1]
    inside = of_long[at]
    again = at[inside][W.repeated(W.in_row(windows[inside], span[at[inside]]))]
    return (np.where(long, W.count_per(table.rows, table.row[of_long][first]), distinct),
            np.where(long, W.count_per(table.rows, table.row[_covered(len(hashes), again)]), repeats))


def _statistics(column: pa.Array) -> dict[str, np.ndarray]:
    parts = {name: [] for name in STATISTICS}
    for _, part in W.slices(column):
        table, n = W.split(part), len(part)
        hashes = table.hashes()

        def counted(flag):
            """Bytes of a kind in each row."""
            total = np.concatenate(([0], np.cumsum(flag)))
            return total[table.offsets[1:]] - total[table.offsets[:-1]], total

        inside = ~W.WHITE[table.data]
        code_points = inside & ((table.data & 0xC0) != 0x80)
        lettered = counted(_LETTER[table.data] | (table.data >= 128))[1]
        lines = W.split(part, _LINE)
        full = np.searchsorted(table.start, lines.end) > np.searchsorted(table.start, lines.start)  # with a word
        line_row, line_hash = lines.row[full], lines.hashes()[full]
        windows, at = W.shingles(table, 3, hashes)
        again = at[W.repeated(W.in_row(windows, table.row[at]))]
        distinct, repeats = W.distinct_per(n, table.row, hashes), W.count_per(n, table.row[_covered(len(hashes), again)])
        span_distinct, span_repeats = _in_spans(table, hashes, windows, at, distinct, repeats)
        for name, value in {
            "n_words": np.diff(table.first), "word_chars": counted(code_points)[0], "n_symbols": counted(_SYMBOL[table.data])[0],
            "n_dup_lines": W.count_per(n, line_row) - W.distinct_per(n, line_row, line_hash),
            "n_repeat_words": repeats, "n_lines": W.count_per(n, line_row),
            "n_distinct_words": distinct, "n_letters": counted(_LETTER[table.data])[0],
            "n_upper": counted(_UPPER[table.data])[0],
            "n_exclaimed": W.count_per(n, table.row[table.data[table.end - 1] == 33]) if len(table.end) else np.zeros(n, np.int64),
            "n_lettered_words": W.count_per(n, table.row[lettered[table.end] > lettered[table.start]]),
            "n_span_distinct": span_distinct, "n_span_repeats": span_repeats,
        }.items():
            parts[name].append(value)
    return {name: np.concatenate([*value, np.zeros(0, np.int64)]) for name, value in parts.items()}


def text_statistics(docs: DataFrame, text: str = "text", doc_columns: tuple[str, ...] | None = None) -> DataFrame:
    """doc (struct of the whole row, or of the named columns) and the counts of STATISTICS."""
    def measure(batches):
        for batch in batches:
            found = _statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(found[k].astype(np.int64)) for k in STATISTICS)],
                                             ["doc", *STATISTICS])

    rows = docs.select(F.struct(*[docs[c] for c in doc_columns or docs.columns]).alias("doc"), docs[text].alias("text"))
    return rows.mapInArrow(measure, T.StructType([rows.schema["doc"], *(T.StructField(k, T.LongType()) for k in STATISTICS)]))


@dataclass(frozen=True)
class Rule:
    """A share of two counts; above or below the bounds it votes, in between (or over nothing) it abstains."""
    name: str
    part: str
    whole: str
    good: tuple[float, float]
    bad: tuple[float, float]  # a vote for bad is one outside of this range

    def vote(self) -> Column:
        share = F.col(self.part) / F.when(F.col(self.whole) > 0, F.col(self.whole))
        return (F.when(share.isNull(), 0).when((share < self.bad[0]) | (share > self.bad[1]), 2)
                .when((share >= self.good[0]) & (share <= self.good[1]), 1).otherwise(0))


RULES = (
    Rule("length", "n_words", "one", (100, 50_000), (50, float("inf"))),  # nothing is said of long texts
    Rule("word_length", "word_chars", "n_words", (3, 9), (2, 14)),
    Rule("symbols", "n_symbols", "n_words", (0, 0.02), (0, 0.1)),
    Rule("repeated_lines", "n_dup_lines", "n_lines", (0, 0.2), (0, 0.6)),
    Rule("repeated_windows", "n_span_repeats", "n_words", (0, 0.1), (0, 0.3)),
    Rule("distinct_words", "n_span_distinct", "n_words", (0.2, 1), (0.08, 1)),
    Rule("upper_case", "n_upper", "n_letters", (0, 0.12), (0, 0.3)),
    Rule("exclamation", "n_exclaimed", "n_words", (0, 0.02), (0, 0.15)),
    Rule("lettered_words", "n_lettered_words", "n_words", (0.95, 1), (0.8, 1)),
)


def votes(statistics: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The statistics and a vote for each rule: 0 none, 1 good, 2 bad."""
    rows = statistics.withColumn("one", F.lit(1))
    return rows.withColumns({f"vote_{r.name}": r.vote() for r in rules}).drop("one")


def posteriors(voted: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = 100, false_alarms: float = 0.01) -> DataFrame:
    """A row for each pattern of votes that occurs (at most 3^rules): its probability of good, by expectation-maximisation.

    Bad text is bad in one way or another, and a rule sees only its own way. So the classes are `good` and one way of
    being bad for each rule, and what is estimated is P(votes bad | class, votes) for all of them; abstaining says
    nothing. A pattern starts in the classes of the rules that vote bad, or in `good`. Priors are a few
    pseudo-documents, the same for any corpus size, and no rule is taken to fail more than `false_alarms` of good text.
    """
    names = [f"vote_{r.name}" for r in rules]
    table = voted.groupBy(*names).agg(F.count("*").alias("n")).toArrow()
    v = np.stack([table[c].to_numpy() for c in names], 1).reshape(-1, len(rules))
    n = table["n"].to_numpy().astype(float)
    bad, good = (v == 2).astype(float), (v == 1).astype(float)
    own = np.eye(len(rules), dtype=bool)
    prior_bad = np.concatenate([np.ones((1, len(rules))), np.where(own, 20.0, 1.0)])
    prior_good = np.concatenate([np.full((1, len(rules)), 200.0), np.where(own, 1.0, 5.0)])
    blamed = bad / np.maximum(1, bad.sum(1, keepdims=True))
    failed = bad.any(1)
    member = np.column_stack([np.where(failed, 0.1, 0.95), np.where(failed[:, None], 0.9 * blamed, 0.05 / len(rules))])
    for _ in range(rounds):
        weight = member * n[:, None]
        share = (weight.sum(0) + 1) / (weight.sum() + len(rules) + 1)
        votes_bad, votes_good = weight.T @ bad + prior_bad, weight.T @ good + prior_good
        given = votes_bad / (votes_bad + votes_good)
        given[0] = np.minimum(given[0], false_alarms)
        score = bad @ np.log(given).T + good @ np.log(1 - given).T + np.log(share)
        member = np.exp(score - score.max(1, keepdims=True, initial=-np.inf))
        member /= member.sum(1, keepdims=True)
    schema = T.StructType([*(T.StructField(c, T.IntegerType()) for c in names), T.StructField("quality", T.DoubleType())])
    rows = [(*map(int, p), float(q)) for p, q in zip(v, member[:, 0])]
    return voted.sparkSession.createDataFrame(rows, schema)


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, least: float = 0.5,
           doc_columns: tuple[str, ...] | None = None) -> DataFrame:
    """doc, statistics, votes, base_failed, quality (posterior probability of good) and kept."""
    voted = votes(staged(text_statistics(docs, text, doc_columns), "quality"), rules)
    known = F.broadcast(posteriors(voted, rules))  # at most 3^rules rows
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (voted.join(known, [f"vote_{r.name}" for r in rules]).withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least)))


def quality_report(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """A row for each document: counts, base verdict, posterior and votes. `doc` holds the id only, not the text."""
    rows = judged(docs, doc_columns=(doc_id,))
    return rows.select(F.col(f"doc.{doc_id}").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept", "quality", *[f"vote_{r.name}" for r in RULES])


def accepted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, columns as given."""
    return judged(docs, text).where("kept").select("doc.*")
