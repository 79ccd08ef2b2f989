"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in NumPy.

A word enters as its own hashed embedding, the mean of its character-n-gram embeddings, and the highest log odds of its
n-grams between toxic and other training documents. Windows of `width` words,
each overlapping the next by half, run through a gated recurrent network in both directions; attention weights pool the
states of a window into one score, and a document scores as its worst window. The input part of the gates depends on
the word alone and is computed once for each distinct word of a slice of texts.

A document's label says only that some window is toxic. So training alternates: choose each toxic document's most
suspicious window and each other document's most suspicious and some random ones, at first by log odds of words and
n-grams, later by the network, and train on those. The sample is at most `sample` toxic documents and
`others` times as many of the other label, of those that may be learnt from (whole texts); labels, language, source and id are no inputs of a score.

Defined cases: null and empty texts, and texts without letters or digits, score the toxic share of the training sample
(below one half at most); without documents of both labels everything scores that share; repeated rows are scored each;
of conflicting labels of one id toxic counts; null ids count as held out; an empty table gives no row.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .folds import held_out

WIDTH, STRIDE = 32, 16
WORDS, GRAMS, PART = 1 << 14, 1 << 15, 8  # hashed embeddings of words and n-grams, and their size
HIDDEN, LOOK = 12, 8
_GRAM_SIZES = (3, 4, 5)


@dataclass
class Inputs:
    """Distinct words of some texts: their embedding rows, and each text's words as places among them."""
    word: np.ndarray       # embedding row of each distinct word
    gram: np.ndarray       # embedding rows of all their n-grams
    gram_word: np.ndarray  # the distinct word of each n-gram
    place: np.ndarray      # distinct word of each running word
    first: np.ndarray      # first running word of each text


def word_inputs(table: W.Words) -> Inputs:
    _, example, place = np.unique(table.hashes(), return_index=True, return_inverse=True)
    size = table.end[example] - table.start[example]
    ends = np.cumsum(size)
    data = table.data[np.repeat(table.start[example] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
    owner = np.repeat(np.arange(len(size)), size)
    hashes = W.range_hashes(data, ends - size, ends)
    grams, owners = [], []
    for n in _GRAM_SIZES:
        at = np.flatnonzero(owner[:len(owner) - n + 1] == owner[n - 1:]) if len(owner) >= n else np.zeros(0, np.int64)
        opening = (at == (ends - size)[owner[at]]).astype(np.uint64)  # an n-gram that begins its word is one of its own
        grams.append((W.mix(W.range_hashes(data, at, at + n) + opening) % np.uint64(GRAMS)).astype(np.int64))
        owners.append(owner[at])
    return Inputs((hashes % np.uint64(WORDS)).astype(np.int64), np.concatenate(grams), np.concatenate(owners), place, table.first)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first running word) of every window: each STRIDE words while words remain that none before holds."""
    size = np.diff(first)
    number = np.where(size > 0, np.maximum(0, -(-(size - WIDTH) // STRIDE)) + 1, 0)
    text = np.repeat(np.arange(len(size)), number)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    return text, first[text] + turn * STRIDE


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    p: dict[str, np.ndarray] = field(default_factory=dict)
    share: float = 0.0
    odds: np.ndarray = field(default_factory=lambda: np.zeros(GRAMS, np.float32))  # of each n-gram

    @classmethod
    def new(cls, odds: np.ndarray, seed: int = 3) -> Network:
        draw = np.random.default_rng(seed)

        def normal(*shape, scale):
            return draw.normal(0, scale, shape).astype(np.float32)

        return cls({"word": normal(WORDS, PART, scale=0.1), "gram": normal(GRAMS, PART, scale=0.1), "in": normal(2, 2 * PART + 1, 3 * HIDDEN, scale=0.5),
                    "in_bias": np.zeros((2, 1, 3 * HIDDEN), np.float32), "state": normal(2, HIDDEN, 3 * HIDDEN, scale=0.3),
                    "look": normal(2 * HIDDEN, LOOK, scale=0.3), "look_bias": np.zeros(LOOK, np.float32), "attend": normal(LOOK, scale=0.3),
                    "out": normal(2 * HIDDEN, scale=0.3), "out_bias": np.zeros(1, np.float32)}, odds=(np.clip(odds, -10, 30) / 10).astype(np.float32))

    def embed(self, x: Inputs) -> tuple[np.ndarray, np.ndarray]:
        """Input vector of each distinct word, and its number of n-grams."""
        number = np.maximum(1, np.bincount(x.gram_word, minlength=len(x.word))).astype(np.float32)
        grams = np.zeros((len(x.word), PART), np.float32)
        for k in range(PART):
            grams[:, k] = np.bincount(x.gram_word, self.p["gram"][x.gram, k], len(x.word))
        odds = np.zeros((len(x.word), 1), np.float32)
        np.maximum.at(odds[:, 0], x.gram_word, self.odds[x.gram])
        return np.concatenate((self.p["word"][x.word], grams / np.sqrt(number)[:, None], odds), 1), number

    def gates(self, vectors: np.ndarray) -> np.ndarray:
        """Input part of the gates, 2 directions x words x 3 HIDDEN; one more row for no word."""
        out = np.matmul(vectors[None], self.p["in"]) + self.p["in_bias"]
        return np.concatenate((out, np.zeros_like(out[:, :1])), 1).astype(np.float32)

    def run(self, gates: np.ndarray, index: np.ndarray, keep: bool = False):
        """Logits of windows given as places of distinct words (windows x WIDTH, the last row of `gates` where there is none)."""
        n, none = len(index), gates.shape[1] - 1
        h, states, trace = np.zeros((2, n, HIDDEN), np.float32), [], []
        for t in range(index.shape[1]):
            now = np.stack((index[:, t], index[:, -1 - t]))
            given = np.stack((gates[0, now[0]], gates[1, now[1]]))
            there = (now != none).astype(np.float32)[:, :, None]
            fed = np.matmul(h, self.p["state"])
            both = _sigmoid(given[:, :, :2 * HIDDEN] + fed[:, :, :2 * HIDDEN])
            z, r = both[:, :, :HIDDEN], both[:, :, HIDDEN:]
            q = fed[:, :, 2 * HIDDEN:]
            new = np.tanh(given[:, :, 2 * HIDDEN:] + r * q)
            z = 1 - (1 - z) * there  # where there is no word the state stays
            if keep:
                trace.append((h, z, r, q, new, there, now))
            h = z * h + (1 - z) * new
            states.append(h)
        states = np.stack(states)
        all_ = np.concatenate((states[:, 0], states[::-1, 1]), 2)  # time x windows x 2 HIDDEN
        seen = np.tanh(all_ @ self.p["look"] + self.p["look_bias"])
        weight = seen @ self.p["attend"]
        weight = np.where(index.T != none, weight, -1e9)
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = (weight[:, :, None] * all_).sum(0)
        logit = pooled @ self.p["out"] + self.p["out_bias"][0]
        return (logit, (trace, all_, seen, weight, pooled)) if keep else logit

    def gradients(self, x: Inputs, vectors, number, gates, index, target, importance) -> dict[str, np.ndarray]:
        logit, (trace, all_, seen, weight, pooled) = self.run(gates, index, keep=True)
        p, n, steps = self.p, len(index), index.shape[1]
        d_logit = ((_sigmoid(logit) - target) * importance / importance.sum()).astype(np.float32)
        g = {"out": pooled.T @ d_logit, "out_bias": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * p["out"]
        d_all = weight[:, :, None] * d_pooled
        d_weight = (all_ * d_pooled).sum(2)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        g["attend"] = np.einsum("tna,tn->a", seen, d_score)
        d_seen = d_score[:, :, None] * p["attend"] * (1 - seen ** 2)
        g["look"], g["look_bias"] = np.einsum("tnh,tna->ha", all_, d_seen), d_seen.sum((0, 1))
        d_all = d_all + d_seen @ p["look"].T
        d_states = np.stack((d_all[:, :, :HIDDEN], d_all[::-1, :, HIDDEN:]), 1)  # time x direction x windows x HIDDEN
        d_gates, g["state"] = np.zeros_like(gates), np.zeros_like(p["state"])
        d_h = np.zeros((2, n, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, q, new, there, now = trace[t]
            d_h = d_h + d_states[t]
            d_new = d_h * (1 - z) * (1 - new ** 2)
            raw_z = 1 - (1 - z) / np.maximum(there, 1e-9)
            d_z = d_h * (h - new) * there * raw_z * (1 - raw_z)
            d_r = d_new * q * r * (1 - r)
            d_fed = np.concatenate((d_z, d_r, d_new * r), 2)
            d_given = np.concatenate((d_z, d_r, d_new), 2)
            g["state"] += np.matmul(h.transpose(0, 2, 1), d_fed)
            d_h = d_h * z + np.matmul(d_fed, p["state"].transpose(0, 2, 1))
            for side in (0, 1):
                np.add.at(d_gates[side], now[side], d_given[side])
        d_gates = d_gates[:, :-1]
        g["in"], g["in_bias"] = np.matmul(vectors.T[None], d_gates), d_gates.sum(1, keepdims=True)
        d_vectors = np.matmul(d_gates, p["in"].transpose(0, 2, 1)).sum(0)
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], x.word, d_vectors[:, :PART])
        np.add.at(g["gram"], x.gram, (d_vectors[:, PART:2 * PART] / np.sqrt(number)[:, None])[x.gram_word])
        return g

    def scores(self, x: Inputs, block: int = 4096) -> np.ndarray:
        """Probability of each text: that of its worst window."""
        text, start = windows(x.first)
        out = np.full(len(x.first) - 1, self.share)
        if not self.p or not len(text):
            return out
        gates = self.gates(self.embed(x)[0])
        logit = np.concatenate([self.run(gates, window_index(x, text[a:a + block], start[a:a + block])) for a in range(0, len(text), block)])
        best = np.full(len(out), -np.inf)
        np.maximum.at(best, text, logit)
        return np.where(np.isfinite(best), _sigmoid(best), out)


def window_index(x: Inputs, text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Places of distinct words, windows x WIDTH; one past the last distinct word where the text has ended."""
    at = start[:, None] + np.arange(WIDTH)
    there = at < x.first[text + 1][:, None]
    return np.where(there, x.place[np.minimum(at, len(x.place) - 1)], len(x.word))


def _odds(pairs, toxic: np.ndarray, size: int) -> np.ndarray:
    """How much more documents of label 1 hold each feature, in standard deviations or so. pairs: (feature, document) arrays,
    each document in one of them."""
    hits = np.zeros((2, size))
    for feature, doc in pairs:
        pair = np.unique(doc * size + feature)
        for k in (0, 1):
            hits[k] += np.bincount(pair[toxic[pair // size] == k] % size, minlength=size)
    rate = [(hits[k] + 0.5) / ((toxic == k).sum() + 1) for k in (0, 1)]
    return np.log(rate[1] / rate[0]) * np.sqrt(hits[1])


def _suspicion(x: Inputs, toxic: np.ndarray, at_once: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Odds of each distinct word (the highest of itself and its n-grams) and of each n-gram."""
    by_word = np.argsort(x.gram_word, kind="stable")
    number = np.bincount(x.gram_word, minlength=len(x.word))
    begin = np.cumsum(number) - number

    def own(low: int):
        """(document, distinct word) of some documents."""
        words = slice(x.first[low], x.first[min(low + at_once, len(toxic))])
        doc = np.searchsorted(x.first, np.arange(words.start, words.stop), "right") - 1
        pair = np.unique(doc * len(x.word) + x.place[words])
        return pair // len(x.word), pair % len(x.word)

    def grams(low: int):
        doc, word = own(low)
        n = number[word]
        return x.gram[by_word[np.repeat(begin[word] - np.cumsum(n) + n, n) + np.arange(n.sum())]], np.repeat(doc, n)

    lows = range(0, len(toxic), at_once)
    odds = _odds((own(low)[::-1] for low in lows), toxic, len(x.word))
    gram_odds = _odds(map(grams, lows), toxic, GRAMS)
    np.maximum.at(odds, x.gram_word, gram_odds[x.gram])
    return odds, gram_odds


def train(texts: pa.Array, toxic: np.ndarray, phases: int = 3, epochs: int = 4, batch: int = 256, seed: int = 3) -> Network:
    share = float(min(0.49, (toxic.sum() + 0.5) / (len(toxic) + 1)))
    table = W.split(pc.utf8_lower(W.text_column(texts)), W.NOT_ALPHANUMERIC)
    if len(np.unique(toxic)) < 2 or not len(table.start):
        return Network({}, share)
    x, draw = word_inputs(table), np.random.default_rng(seed)
    odds, gram_odds = _suspicion(x, toxic)
    net = Network.new(gram_odds, seed)
    text, start = windows(x.first)
    index = window_index(x, text, start)
    suspicion = np.append(odds, -np.inf)[index].max(1)
    adam = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, truth = 0, toxic[text]
    for phase in range(phases):
        order = np.lexsort((-suspicion, text))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        chosen = np.flatnonzero((rank == 0) | ((truth == 0) & (rank < 2)) | ((truth == 0) & (draw.random(len(text)) < 3 / np.bincount(text)[text])))
        importance = np.where(truth == 1, 0.35 / max(1, truth[chosen].sum()), 0.65 / max(1, (1 - truth[chosen]).sum()))
        for _ in range(epochs):
            for at in np.array_split(draw.permutation(chosen), max(1, len(chosen) // batch)):
                used, local = np.unique(index[at], return_inverse=True)
                part = _subset(x, used[used < len(x.word)], local.reshape(len(at), WIDTH))
                vectors, grams = net.embed(part)
                g = net.gradients(part, vectors, grams, net.gates(vectors), part.place, truth[at].astype(np.float32), importance[at].astype(np.float32))
                step += 1
                for k, v in net.p.items():
                    m, s = adam[k]
                    m += 0.1 * (g[k] - m)
                    s += 0.01 * (g[k] ** 2 - s)
                    v -= (0.01 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        gates = net.gates(net.embed(x)[0])
        suspicion = np.concatenate([net.run(gates, index[a:a + 4096]) for a in range(0, len(index), 4096)])
    net.share = share
    return net


def _subset(x: Inputs, used: np.ndarray, local: np.ndarray) -> Inputs:
    """The chosen distinct words; `place` holds windows of them."""
    number = np.full(len(x.word), -1)
    number[used] = np.arange(len(used))
    mine = number[x.gram_word] >= 0
    return Inputs(x.word[used], x.gram[mine], number[x.gram_word[mine]], local, np.zeros(1, np.int64))


def training_documents(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, toxic: str, sample: int, others: int) -> DataFrame:
    """id, text and label of at most `sample` toxic documents and `others` times as many without the label."""
    known = (labels.select(labels[doc_id].alias("id"), labels[toxic].cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("id").isNotNull())
             .where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic")))
    picked = known.where("toxic = 1").orderBy(F.xxhash64(F.lit(9), "id"), "id").limit(sample).unionByName(
        known.where("toxic = 0").orderBy(F.xxhash64(F.lit(9), "id"), "id").limit(others * sample))
    rows = docs.select(docs[doc_id].alias("id"), docs[text].alias("text")).where(F.col("text").isNotNull())
    return rows.join(F.broadcast(picked), "id").groupBy("id").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))


def fitted(sample: DataFrame) -> Network:
    """The network trained on a bounded sample, in one task."""
    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by("id").combine_chunks()
        net = train(group["text"].combine_chunks(), group["toxic"].to_numpy().astype(np.int64))
        return pa.table({"network": pa.array([pickle.dumps((net.p, net.share, net.odds))], pa.binary())})

    found = sample.groupBy().applyInArrow(fit, "network binary").collect()
    return Network(*pickle.loads(found[0]["network"])) if found else Network()


def toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = 800,
             others: int = 3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    net = fitted(training_documents(docs, labels, doc_id, text, toxic, sample, others))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def score(batches):
        model = shared.value
        for batch in batches:
            column = pc.utf8_lower(W.text_column(batch.column("text")))
            found = [model.scores(word_inputs(W.split(part, W.NOT_ALPHANUMERIC))) for _, part in W.slices(column)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate([*found, np.zeros(0)]))], ["doc_id", "score"])

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    scored = rows.mapInArrow(score, T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
