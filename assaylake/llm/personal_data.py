"""Personal data by weak supervision, in DataFrame functions only.

Candidates are pattern matches of several kinds. Labelers of three sorts look at each: pattern (shape, check digits,
number ranges), gazetteer (top-level domains, calling codes, card issuers, reserved addresses) and context (words
before it, neighbouring characters); each votes personal, not personal, or abstains. Votes are counted by pattern (at
most kinds x 3^labelers rows for any corpus), expectation-maximisation on those counts estimates each labeler's
reliability, and a logistic span classifier over kind, votes and length is trained on the posteriors, by the same
counts. Spans of the base definition always stay; other candidates are added where the classifier says so.

Defined cases: null and empty texts have no span; repeated rows are each scanned; an empty table gives no row; null
ids are carried through; columns of any name pass through in `doc`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import let
from . import spans as S
from .staging import staged

# Patterns of the base kinds. They match what the plain definitions match, written for a linear search.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:[A-Za-z0-9.-](?<!\.(?![A-Za-z0-9-])))*+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[0-9 -](?<![ -](?![0-9])))++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# Patterns of further kinds.
LOCAL_PHONE = r"(?<![0-9+().-])(?<!\+[0-9]{1,3} )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Z0-9])"
# Gazetteers.
DOMAINS = "com org net edu gov mil int info biz io de fr es uk us eu it nl pl pt ru cn jp br in au ca ch at be se no".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
ISSUERS = "^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|30[0-5]|36|38)"
RESERVED = r"^0*(0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^192\.168\.|^169\.254\."
BEFORE = r"(?i)(mail|e-mail|contact|phone|tel|call|mobile|fax|card|visa|credit|pay|ip|addr|address|host|ssn|social|iban|account)\W{0,4}$"
AGAINST = r"(?i)(version|release|isbn|order|invoice|serial|part|build|v)\W{0,3}$"

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "local_phone", "ssn", "iban")
LABELERS = ("shape", "check", "gazetteer", "context", "against", "alone", "varied")
#: Prior spans of each labeler: (for, against) among personal ones and among others. Checks hardly ever fail a personal one.
PRIOR = {name: ((9.0, 1.0), (2.0, 8.0)) for name in LABELERS} | {name: ((30.0, 0.25), (2.0, 8.0)) for name in ("check", "against", "varied")}
#: Largest share of candidates taken to be personal before their votes are seen; most candidates are, and would carry the rest.
LARGEST_SHARE = 0.5


def _luhn(number: Column) -> Column:
    """Whether up to 20 digits pass Luhn's check."""
    padded = F.lpad(number, 20, "0")

    def value(i):
        d = F.ascii(F.substring(padded, i, 1)) - 48
        return d if i % 2 == 0 else F.when(d > 4, 2 * d - 9).otherwise(2 * d)

    return sum((value(i) for i in range(2, 21)), value(1)) % 10 == 0


_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP_RANGE = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 for personal, 2 against, 0 none."""
    if no is None:
        return F.when(yes, 1).otherwise(2)
    return F.when(yes, 1).when(no, 2).otherwise(0)


def _kind_rules(kind: str, match: Column) -> dict[str, Column]:
    """Base validity and the votes that depend on the match alone."""
    if kind == "email":
        domain = F.lower(F.regexp_extract(match, r"\.([A-Za-z0-9-]*)$", 1))
        return {"base": F.lit(True), "shape": _vote(match.rlike(r"^[A-Za-z0-9]")), "check": F.lit(0), "gazetteer": _vote(domain.isin(DOMAINS)),
                "varied": F.lit(0)}
    if kind == "ip":
        valid = match.rlike(IP_RANGE)
        return {"base": valid, "shape": _vote(~match.rlike(r"^0|\.0[0-9]")), "check": _vote(valid), "gazetteer": _vote(F.lit(False), match.rlike(RESERVED)),
                "varied": F.lit(0)}
    if kind == "iban":
        return {"base": F.lit(False), "shape": _vote(F.length(match) >= 15), "check": F.lit(0), "gazetteer": F.lit(0), "varied": F.lit(0)}
    number = S.digits(match)
    varied = _vote(F.lit(False), number.rlike(r"^([0-9])\1+$"))
    size = F.length(number)
    if kind == "card":
        sized = size.between(13, 19)
        valid = sized & _luhn(F.when(sized, number).otherwise("1"))
        return {"base": valid, "shape": _vote(sized), "check": _vote(valid), "gazetteer": _vote(number.rlike(ISSUERS)), "varied": varied}
    if kind == "phone":
        valid = size.between(9, 15)
        code = F.regexp_extract(match, r"^\+([0-9]{1,3})", 1)
        known = code.isin(CALLING) | code.substr(1, 2).isin(CALLING) | code.substr(1, 1).isin("1", "7")
        return {"base": valid, "shape": _vote(valid), "check": F.lit(0), "gazetteer": _vote(known), "varied": varied}
    if kind == "ssn":
        return {"base": F.lit(False), "shape": F.lit(1), "check": _vote(~number.rlike("^(000|666|9)|0000$")), "gazetteer": F.lit(0), "varied": varied}
    return {"base": F.lit(False), "shape": F.lit(1), "check": _vote(size == 10), "gazetteer": _vote(F.lit(False), number.rlike("^[01]")), "varied": varied}


_FOUND = {
    "email": (EMAIL, lambda t: t.contains("@")), "ip": (IP, lambda t: t.rlike(r"[0-9]\.[0-9]")), "card": (CARD, lambda t: t.rlike("[0-9][0-9 -]{11}")),
    "phone": (PHONE, lambda t: t.contains("+")), "local_phone": (LOCAL_PHONE, lambda t: t.rlike(r"[0-9]{3}[ .-][0-9]{4}")),
    "ssn": (SSN, lambda t: t.rlike("-[0-9]{2}-")), "iban": (IBAN, lambda t: t.rlike("[A-Z]{2}[0-9]{2}[A-Z0-9]")),
}


def _candidates(text: Column) -> Column:
    """All candidates of one text with their votes, by kind and start."""
    def of(kind: str, order: int) -> Column:
        pattern, only_if = _FOUND[kind]

        def judged(s: Column) -> Column:
            low = F.greatest(s["start"] - 24, F.lit(0))
            before, after = text.substr(low + 1, s["start"] - low), text.substr(s["end"] + 1, F.lit(1))
            own = _kind_rules(kind, s["match"])
            votes = own | {"context": _vote(before.rlike(BEFORE), F.lit(False)), "against": _vote(F.lit(False), before.rlike(AGAINST)),
                           "alone": _vote(~before.rlike(r"[\p{L}\p{N}]$") & ~after.rlike(r"^[\p{L}\p{N}]"))}
            return F.struct(F.lit(order).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), votes["base"].alias("base"),
                            F.struct(*[votes[n].cast("int").alias(n) for n in LABELERS]).alias("votes"))

        # a card's or address's digits in a longer run of numbers are of no interest unless they could be one
        worth = {"card": lambda s: F.length(S.digits(s["match"])) >= 12}.get(kind)
        found = S.matches(text, pattern, only_if(text))
        return F.transform(F.filter(found, worth) if worth else found, judged)

    return F.concat(*[of(k, i) for i, k in enumerate(KINDS)])


def candidates(docs: DataFrame, text: str = "text", doc_columns: tuple[str, ...] | None = None) -> DataFrame:
    """doc (struct of the whole row, or of the named columns) and found: array of (kind, start, end, base, votes); staged."""
    rows = docs.select(F.struct(*[docs[c] for c in doc_columns or docs.columns]).alias("doc"), F.coalesce(docs[text], F.lit("")).alias("text"))
    return staged(rows.select("doc", _candidates(F.col("text")).alias("found")), "candidates")


@dataclass(frozen=True)
class SpanModel:
    """Weights of the classifier: bias by kind, and weight by (labeler, vote)."""
    bias: list[float]
    weight: list[list[float]]

    def probability(self, s: Column) -> Column:
        kinds = F.array(*[F.lit(float(b)) for b in self.bias])
        odds = F.element_at(kinds, s["kind"] + 1)
        for name, weights in zip(LABELERS, self.weight):
            odds = odds + F.element_at(F.array(*[F.lit(float(w)) for w in weights]), s["votes"][name] + 1)
        return 1 / (1 + F.exp(-odds))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def fit(found: DataFrame, rounds: int = 60, steps: int = 400) -> SpanModel:
    """Expectation-maximisation on counts of vote patterns, then the classifier on its posteriors."""
    spans = found.select(F.explode("found").alias("s"))
    counted = spans.groupBy("s.kind", *[F.col(f"s.votes.{n}").alias(n) for n in LABELERS]).agg(F.count("*").alias("n"))
    patterns = [(r["kind"], [r[n] for n in LABELERS], float(r["n"])) for r in counted.collect()]  # at most kinds x 3^labelers
    total = sum(n for _, _, n in patterns) or 1.0
    # posterior of "personal" for each pattern, from the share of votes for it at first
    post = [(1 + 2 * v.count(1)) / (2 + 2 * v.count(1) + 2 * v.count(2)) for _, v, _ in patterns]
    for _ in range(rounds):
        # reliability: P(votes for | personal) and P(votes for | not)
        right = []
        for j, name in enumerate(LABELERS):
            (for_yes, against_yes), (for_no, against_no) = PRIOR[name]
            for (_, v, n), p in zip(patterns, post):
                if v[j] == 1:
                    for_yes, for_no = for_yes + n * p, for_no + n * (1 - p)
                elif v[j] == 2:
                    against_yes, against_no = against_yes + n * p, against_no + n * (1 - p)
            right.append((for_yes / (for_yes + against_yes), for_no / (for_no + against_no)))
        share = min(LARGEST_SHARE, (sum(n * p for (_, _, n), p in zip(patterns, post)) + 1) / (total + 2))
        prior = math.log(share / (1 - share))
        post = [_sigmoid(prior + sum(math.log(a / b) if x == 1 else math.log((1 - a) / (1 - b)) if x == 2 else 0.0 for x, (a, b) in zip(v, right)))
                for _, v, _ in patterns]
    # the classifier starts from the reliabilities and is trained on the posteriors; roots, so that rare patterns count
    bias, weight = [prior] * len(KINDS), [[0.0, math.log(a / b), math.log((1 - a) / (1 - b))] for a, b in right]
    mass = sum(math.sqrt(n) for _, _, n in patterns) or 1.0
    for _ in range(steps):
        step_bias, step_weight = [1e-4 * (prior - b) for b in bias], [[0.0] * 3 for _ in weight]
        for (kind, v, n), p in zip(patterns, post):
            error = math.sqrt(n) / mass * (p - _sigmoid(bias[kind] + sum(weight[j][x] for j, x in enumerate(v))))
            step_bias[kind] += error
            for j, x in enumerate(v):
                step_weight[j][x] += error
        bias = [b + 2 * s for b, s in zip(bias, step_bias)]
        weight = [[w + 2 * s for w, s in zip(ws, ss)] for ws, ss in zip(weight, step_weight)]
    return SpanModel(bias, weight)


def personal_spans(docs: DataFrame, text: str = "text", doc_columns: tuple[str, ...] | None = None, least: float = 0.5) -> DataFrame:
    """doc and spans: array of (kind, start, end, base, probability), by kind and start."""
    found = candidates(docs, text, doc_columns)
    model = fit(found)

    def scored(s: Column) -> Column:
        return F.struct(F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                        s["base"].alias("base"), model.probability(s).alias("probability"))

    def covered(s: Column, base: Column) -> Column:
        return F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    kept = let(F.transform(F.col("found"), scored), lambda all_: let(F.filter(all_, lambda s: s["base"]), lambda base: F.filter(
        all_, lambda s: s["base"] | ((s["probability"] >= least) & ~covered(s, base)))))
    return found.select("doc", F.when(F.size("found") == 0, F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean,probability:double>>"))
                        .otherwise(kept).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data_report(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    rows = personal_spans(docs, doc_columns=(doc_id,))
    base = F.filter("spans", lambda s: s["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return rows.select(F.col(f"doc.{doc_id}").alias("doc_id"), *[number(k) for k in BASE_KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
                       joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with each span written as its kind in brackets; columns as given."""
    rows = personal_spans(docs, text)
    marked = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                                 F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("put"))))
    columns = [F.when(F.col(f"doc.{c}").isNull() | (F.size("spans") == 0), F.col(f"doc.{c}"))
               .otherwise(let(marked, lambda m: S.replaced(F.col(f"doc.{text}"), m))).alias(c) if c == text else F.col(f"doc.{c}").alias(c) for c in docs.columns]
    return rows.select(*columns)
