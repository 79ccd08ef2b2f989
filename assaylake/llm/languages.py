"""Language by error-correcting output codes over byte n-grams.

Every language has a codeword of +1 and -1; for each bit a binary logistic classifier over hashed byte two- and
three-grams predicts it. Decoding takes the language whose codeword loses least against the predicted margins, bits
weighted by how well their classifier does on the training sample, and flags a document whose second-best language
comes close. Up to six languages have all distinct bits there are, more get random codewords of greatest distance.

Training uses a sample of at most `sample` labelled rows in expectation, equal shares of each language; scoring reads
whole texts. Defined cases: a text that is null or has no letter is `und` with score 0, as is every text if no row has
a language to learn from; with a single language all lettered texts get it; repeated rows are scored each; null ids are
carried through and count as held out; an empty table gives no row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .folds import held_out

FEATURES = 1 << 13  # the lower half for two-grams, the upper for three-grams
UNKNOWN = "und"
_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


def ngram_counts(column: pa.Array):
    """(first row, relative n-gram frequencies rows x FEATURES, roots taken) for slices of a text column."""
    for at, part in W.slices(pc.utf8_lower(W.text_column(column)), W.SLICE_BYTES // 4):
        for low in range(0, len(part), 512):
            data, offsets = W.raw(part.slice(low, 512))
            rows, half = len(offsets) - 1, FEATURES // 2
            code = np.where(_LETTER[data], data, 32).astype(np.uint32)
            row = np.repeat(np.arange(rows), np.diff(offsets))
            total = np.zeros(rows * FEATURES)
            for n in (2, 3):
                if len(code) < n:
                    continue
                gram = code[:-1] * np.uint32(256) + code[1:] if n == 2 else (code[:-2] * np.uint32(256) + code[1:-1]) * np.uint32(256) + code[2:]
                inside = row[:len(gram)] == row[n - 1:]
                bucket = ((gram * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64) + (n - 2) * half
                total += np.bincount((row[:len(gram)] * FEATURES + bucket)[inside], minlength=len(total))
            counts = total.reshape(rows, FEATURES)
            yield at + low, np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True))).astype(np.float32)


def codewords(languages: int, seed: int = 11) -> np.ndarray:
    """languages x bits of +1 and -1."""
    if languages <= 6:
        bits = (np.arange(1, 1 << (languages - 1))[None, :] >> np.arange(languages)[:, None]) & 1
        return np.where(bits == 1, -1.0, 1.0)
    draw, best, most = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = draw.choice([-1.0, 1.0], (languages, int(np.ceil(10 * np.log2(languages)))))
        apart = code @ code.T
        np.fill_diagonal(apart, -np.inf)
        if (distance := code.shape[1] - apart.max()) > most and (np.abs(code.sum(0)) < languages).all():
            best, most = code, distance
    return best


@dataclass
class Codes:
    languages: list[str]
    code: np.ndarray    # languages x bits
    weight: np.ndarray  # FEATURES x bits
    bias: np.ndarray
    trust: np.ndarray   # of each bit

    def losses(self, x: np.ndarray) -> np.ndarray:
        margin = x @ self.weight + self.bias
        return np.stack([(np.logaddexp(0, -margin * c) * self.trust).sum(1) for c in self.code], 1)


def fit_codes(x: np.ndarray, languages: list[str], label: np.ndarray, rounds: int = 150) -> Codes:
    """A logistic classifier for each bit, all at once, by Adam on the whole sample."""
    code = codewords(len(languages))
    target = (code[label] + 1) / 2
    share = 1 / np.bincount(label, minlength=len(languages))[label]
    share = (share / share.sum())[:, None]
    weight, bias = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    state = [[np.zeros_like(weight), np.zeros_like(weight)], [np.zeros_like(bias), np.zeros_like(bias)]]
    for t in range(1, rounds + 1):
        error = ((1 / (1 + np.exp(-(x @ weight + bias))) - target) * share).astype(np.float32)
        for p, g, (m, v) in ((weight, x.T @ error + 1e-6 * weight, state[0]), (bias, error.sum(0), state[1])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.3 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    margin = (x @ weight + bias) * code[label]
    right = np.clip((share * (margin > 0)).sum(0), 0.5, 1 - 1e-3)
    trust = np.log(right / (1 - right)) + 1e-3
    return Codes(languages, code, weight, bias, trust / trust.sum())


def training_sample(docs: DataFrame, doc_id: str, text: str, lang: str, sample: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, features and labels of about `sample` rows that may be learnt from, equal shares of each language."""
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), docs[lang].cast("string").alias("lang"))
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # a row for each language
    languages = sorted(counts)
    if not languages:
        return [], np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64)
    each = max(20, sample // len(languages))
    chance = docs.sparkSession.createDataFrame([(k, min(1.0, each / n), i) for i, (k, n) in enumerate(sorted(counts.items()))], "lang string, chance double, label int")
    drawn = F.xxhash64(F.lit(5), F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 63) - 1)) / F.lit(2.0 ** 63)
    picked = rows.withColumn("drawn", drawn).where(~held_out(F.col("doc_id")) & F.col("text").isNotNull()).join(F.broadcast(chance), "lang").where("drawn < chance")

    def features(batches):
        for batch in batches:
            for at, x in ngram_counts(batch.column("text")):
                row, place = np.nonzero(x)
                offsets = np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(at, len(x)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(place.astype(np.int32))),
                                                  pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[row, place]))], ["label", "place", "value"])

    table = picked.select("label", "text").mapInArrow(features, "label int, place array<int>, value array<float>").toArrow().combine_chunks()
    x = np.zeros((table.num_rows, FEATURES), np.float32)
    if table.num_rows:
        place, value = (table[c].combine_chunks() for c in ("place", "value"))
        x[np.repeat(np.arange(len(x)), pc.list_value_length(place).to_numpy(zero_copy_only=False)), place.flatten().to_numpy()] = value.flatten().to_numpy()
    return languages, x, table["label"].to_numpy().astype(np.int64)


def languages_of(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 2000, margin: float = 0.2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, second (the next language) and ambiguous for every row."""
    names, x, label = training_sample(docs, doc_id, text, lang, sample)
    seen = np.unique(label)
    names, label = [names[i] for i in seen], np.searchsorted(seen, label)
    model = fit_codes(x, names, label) if len(names) > 1 else None
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x bits

    def decide(batches):
        codes = shared.value
        for batch in batches:
            column = W.text_column(batch.column("text"))
            lettered = pc.match_substring_regex(column, r"\p{L}").to_numpy(zero_copy_only=False)
            best, second = np.full(len(column), -1), np.full(len(column), -1)
            score, gap = np.zeros(len(column)), np.ones(len(column))
            if codes is not None:
                for at, x in ngram_counts(column):
                    loss = codes.losses(x)
                    order, to = np.argsort(loss, 1, kind="stable"), slice(at, at + len(x))
                    chance = np.exp(-8 * (loss - loss.min(1, keepdims=True)))
                    chance = np.sort(chance / chance.sum(1, keepdims=True), 1)
                    best[to], second[to], score[to], gap[to] = order[:, 0], order[:, 1], chance[:, -1], chance[:, -1] - chance[:, -2]
            elif names:
                best[:], score[:] = 0, 1.0
            best[~lettered], second[~lettered], score[~lettered] = -1, -1, 0.0
            known = pa.array([UNKNOWN, *names], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), known.take(pa.array(best + 1)), pa.array(score), pa.array([names[i] if i >= 0 else None for i in second], pa.string()),
                 pa.array((best >= 0) & (gap < margin))], ["doc_id", "lang_pred", "score", "second", "ambiguous"])

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(n, k) for n, k in (
        ("lang_pred", T.StringType()), ("score", T.DoubleType()), ("second", T.StringType()), ("ambiguous", T.BooleanType())))])
    out = rows.mapInArrow(decide, schema)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "second", "ambiguous")
