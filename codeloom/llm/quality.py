"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words that cover its whole text. A
passage's input is the mean of its words' inputs, each the mean embedding of the word's
hashed character 3-grams, case and marks included, and some measures of its spelling;
besides, how much the passage repeats itself and how long it is. One layer encodes
it. Labels hold for whole documents: gated attention, a product of a tanh and a
sigmoid layer, learns from them which passages tell, and one logistic unit scores the
attention-weighted sum of the encoded passages.

Training runs in numpy on the driver over a bounded sample of labelled documents,
``PER_CLASS`` of each class, chosen by a hash of their id. A quarter of them is
kept from training and sets the scale of the scores: 0.3 lies between what most of its good
documents and most of its bad ones reach.

Odd rows: a null text is an empty one, with one empty passage. Rows with a null or
other label or without an id teach nothing; of repeated labels of an id the largest
holds; a row without an id is held out. Without both classes every text gets the smoothed
share of good ones. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.toxicity import Adam

PER_CLASS = 800
THRESHOLD = 0.3
PASSAGE = 64
BUCKETS, GRAM_DIM, HIDDEN, GATE = 1 << 13, 8, 16, 8
_SPELLING = 6  # measures of a word
_INPUT = GRAM_DIM + _SPELLING + 3
_STEPS, _DOCS, _RATE, _DECAY = 600, 32, 0.01, 0.02
_REMEMBERED = 150_000
_WORDS_AT_ONCE = 1 << 18
_EDGE = 2  # code point that stands for both ends of a word
_STOPS = ".,;:!?"


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@cache
def _kinds() -> np.ndarray:
    """Of the code points of the first plane: 1 for letters, 2 for digits, 0 for marks; 4 more for capitals and 8 more for stops."""
    kinds = [chr(i).isalpha() + 2 * chr(i).isdigit() + 4 * chr(i).isupper() + 8 * (chr(i) in _STOPS) for i in range(1 << 16)]
    return np.array(kinds, "u1")


def _read(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words' character 3-grams, edges included, the place of each word's first, and measures of its spelling.

    The measures: shares of capitals, digits and marks, whether it ends in a mark that is
    no stop, whether it has no letter, and its length.
    """
    edge = chr(_EDGE)
    joined = edge + edge.join(w.replace(edge, "?") for w in words) + edge
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    value = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ codes[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F)
    value = (value ^ codes[2:] ^ value >> np.uint64(31)) * np.uint64(0x165667B19E3779F9)
    inside = np.flatnonzero(codes[1:-1] != _EDGE)
    buckets = (value[inside] >> np.uint64(40)).astype("i8") % BUCKETS
    codes = codes[1:-1][inside]
    sizes = np.fromiter(map(len, words), "i8", len(words))
    begin = np.cumsum(sizes) - sizes
    kinds = np.where(codes < 1 << 16, _kinds()[np.minimum(codes, 0xFFFF)], 0)  # beyond the first plane: marks
    share = lambda some: np.add.reduceat(some.astype("f4"), begin) / sizes
    letters, digits = share(kinds & 3 == 1), share(kinds & 3 == 2)
    last = kinds[begin + sizes - 1]
    spelling = np.stack([share(kinds & 4 != 0), digits, 1 - letters - digits, last == 0, letters == 0, np.minimum(sizes, 40) / 10], axis=1)
    return buckets, begin, spelling.astype("f4")


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    scale: tuple[float, float] = (1.0, 0.0)  # slope and middle of the logits
    cache: dict[str, int] = field(default_factory=dict, repr=False)
    rows: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "scale": self.scale, "cache": {}, "rows": None}

    def _lookup(self, words: list[str]) -> np.ndarray:
        """Row of each word in ``rows``."""
        if self.rows is None or len(self.cache) > _REMEMBERED:
            self.cache, self.rows = {}, np.zeros((1 << 12, GRAM_DIM + _SPELLING), "f4")
        missing = list({w for w in words if w not in self.cache})
        first = len(self.cache)
        while first + len(missing) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for at in range(0, len(missing), 1 << 14):
            part = missing[at:at + (1 << 14)]
            buckets, begin, spelling = _read(part)
            sizes = np.diff(np.r_[begin, len(buckets)])[:, None]
            rows = self.rows[first + at:first + at + len(part)]
            rows[:, :GRAM_DIM] = np.add.reduceat(self.weights["grams"][buckets], begin, axis=0) / sizes
            rows[:, GRAM_DIM:] = spelling
        self.cache.update(zip(missing, range(first, first + len(missing))))
        return np.fromiter(map(self.cache.__getitem__, words), "i4", len(words))

    def encode(self, inputs: np.ndarray) -> np.ndarray:
        return np.tanh(inputs @ self.weights["in"] + self.weights["in_bias"])

    def attention(self, encoded: np.ndarray, begin: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Weight of every passage within its document; documents are runs of passages that start at ``begin``."""
        w = self.weights
        felt, gate = np.tanh(encoded @ w["felt"] + w["felt_bias"]), _sigmoid(encoded @ w["gate"] + w["gate_bias"])
        score = (felt * gate) @ w["query"]
        sizes = np.diff(np.r_[begin, len(encoded)])
        score = np.exp(score - np.repeat(np.maximum.reduceat(score, begin), sizes))
        if keep is not None:
            keep.update(felt=felt, gate=gate)
        return score / np.repeat(np.add.reduceat(score, begin), sizes)

    def bag_logits(self, inputs: np.ndarray, begin: np.ndarray, keep: dict | None = None) -> np.ndarray:
        encoded = self.encode(inputs)
        attention = self.attention(encoded, begin, keep)
        pooled = np.add.reduceat(encoded * attention[:, None], begin, axis=0)
        if keep is not None:
            keep.update(encoded=encoded, attention=attention, pooled=pooled)
        return pooled @ self.weights["out"] + self.weights["out_bias"]

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Scores of whole texts before they are scaled."""
        words = [(t or "").split() for t in texts]
        flat = [w for some in words for w in some]
        rows = self._lookup(flat)
        starts, sizes, begin = _passages(words)
        inputs = np.zeros((len(starts), _INPUT), "f4")
        filled = np.flatnonzero(sizes)
        at = 0
        while at < len(filled):  # a long text's words are gathered a part at a time
            end = max(int(np.searchsorted(starts[filled], starts[filled[at]] + _WORDS_AT_ONCE)), at + 1)
            some = filled[at:end]
            a, b = starts[some[0]], starts[some[-1]] + sizes[some[-1]]
            inputs[some, :GRAM_DIM + _SPELLING] = np.add.reduceat(self.rows[rows[a:b]], starts[some] - a, axis=0) / sizes[some][:, None]
            at = end
        inputs[:, GRAM_DIM + _SPELLING:] = _measures(rows, starts, sizes)
        return self.bag_logits(inputs, begin)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Score of each whole text, between 0 and 1."""
        slope, middle = self.scale
        return np.round(_sigmoid(slope * (self.logits(texts).astype("f8") - middle)), 6)


def _passages(docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and number of words of all passages, and each document's first passage; no words are one empty passage."""
    starts, sizes, begin, at = [], [], [], 0
    for words in docs:
        n = len(words)
        begin.append(len(starts))
        starts += range(at, at + max(n, 1), PASSAGE)
        sizes += [PASSAGE] * (n // PASSAGE) + ([n % PASSAGE] if n % PASSAGE or not n else [])
        at += n
    return np.array(starts, "i8"), np.array(sizes, "i8"), np.array(begin, "i8")


def _measures(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each passage: share of words that repeat an earlier one, share that repeat the one before, log of its length."""
    out = np.zeros((len(starts), 3), "f4")
    padded = np.append(rows.astype("i8"), np.full(PASSAGE, -1))
    for at in range(0, len(starts), 1 << 12):
        first, n = starts[at:at + (1 << 12), None], sizes[at:at + (1 << 12)]
        place = np.arange(PASSAGE)
        inside = place < n[:, None]
        window = np.where(inside, padded[first + place], -1 - place)
        same = (window[:, 1:] == window[:, :-1]).sum(axis=1)
        ordered = np.sort(window, axis=1)
        again = (ordered[:, 1:] == ordered[:, :-1]).sum(axis=1)
        out[at:at + (1 << 12)] = np.stack([3 * again / np.maximum(n, 1), 3 * same / np.maximum(n, 1), np.log1p(n) / 4], axis=1)
    return out


# Training


@dataclass
class Bags:
    """Passages of documents as sparse weights of gram buckets and the measures that are fixed."""

    begin: np.ndarray  # first passage of each document, and the end
    grams: list[tuple[np.ndarray, np.ndarray]]
    fixed: np.ndarray

    def some(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Passage, bucket and weight of every gram of some documents, their fixed measures, and each one's first passage."""
        passages = np.concatenate([np.arange(self.begin[d], self.begin[d + 1]) for d in docs])
        sizes = self.begin[docs + 1] - self.begin[docs]
        picked = [self.grams[p] for p in passages]
        owner = np.repeat(np.arange(len(picked)), [len(b) for b, _ in picked])
        return owner, np.concatenate([b for b, _ in picked]), np.concatenate([w for _, w in picked]), self.fixed[passages], np.cumsum(sizes) - sizes


def _bags(texts: list[str]) -> Bags:
    words = [t.split() for t in texts]
    distinct = {w: i for i, w in enumerate(dict.fromkeys(w for some in words for w in some))}
    rows = np.fromiter((distinct[w] for some in words for w in some), "i8")
    starts, sizes, begin = _passages(words)
    buckets, at, spelling = _read(list(distinct)) if distinct else (np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros((0, _SPELLING), "f4"))
    at = np.r_[at, len(buckets)]
    fixed = np.zeros((len(starts), _SPELLING + 3), "f4")
    fixed[:, _SPELLING:] = _measures(rows, starts, sizes)
    grams = []
    for i, (a, n) in enumerate(zip(starts, sizes)):
        mine = rows[a:a + n]
        if not n:
            grams.append((np.zeros(0, "i8"), np.zeros(0, "f4")))
            continue
        fixed[i, :_SPELLING] = spelling[mine].mean(axis=0)
        found = np.concatenate([buckets[at[w]:at[w + 1]] for w in mine])
        weight = np.repeat(1 / (n * (at[mine + 1] - at[mine])), at[mine + 1] - at[mine])
        unique, inverse = np.unique(found, return_inverse=True)
        grams.append((unique, np.bincount(inverse, weight).astype("f4")))
    return Bags(np.r_[begin, len(starts)], grams, fixed)


def _inputs(model: Model, owner, buckets, weights, fixed) -> np.ndarray:
    mean = np.zeros((len(fixed), GRAM_DIM), "f4")
    rows = model.weights["grams"][buckets] * weights[:, None]
    for k in range(GRAM_DIM):
        mean[:, k] = np.bincount(owner, rows[:, k], len(fixed))
    return np.concatenate([mean, fixed], axis=1)


def gradients(model: Model, bags: Bags, docs: np.ndarray, labels: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the mean logistic loss over some documents, and their scores."""
    w = model.weights
    owner, buckets, weights, fixed, begin = bags.some(docs)
    inputs, kept = _inputs(model, owner, buckets, weights, fixed), {}
    p = _sigmoid(model.bag_logits(inputs, begin, kept))
    encoded, attention, felt, gate = kept["encoded"], kept["attention"], kept["felt"], kept["gate"]
    sizes = np.diff(np.r_[begin, len(encoded)])
    d_logit = ((p - labels) / len(docs)).astype("f4")
    g = {"out": kept["pooled"].T @ d_logit, "out_bias": d_logit.sum(keepdims=True)}
    d_pooled = np.repeat(d_logit, sizes)[:, None] * w["out"]
    d_encoded = attention[:, None] * d_pooled
    d_attention = (encoded * d_pooled).sum(axis=1)
    d_score = attention * (d_attention - np.repeat(np.add.reduceat(attention * d_attention, begin), sizes))
    g["query"] = (felt * gate).T @ d_score
    d_both = d_score[:, None] * w["query"]
    d_felt, d_gate = d_both * gate * (1 - felt * felt), d_both * felt * gate * (1 - gate)
    for name, d in (("felt", d_felt), ("gate", d_gate)):
        g[name], g[f"{name}_bias"] = encoded.T @ d, d.sum(axis=0)
        d_encoded = d_encoded + d @ w[name].T
    d_in = d_encoded * (1 - encoded * encoded)
    g["in"], g["in_bias"] = inputs.T @ d_in, d_in.sum(axis=0)
    d_rows = (d_in @ w["in"].T)[owner, :GRAM_DIM] * weights[:, None]
    g["grams"] = np.stack([np.bincount(buckets, d_rows[:, k], BUCKETS) for k in range(GRAM_DIM)], axis=1).astype("f4")
    return g, p


def initial(seed: int) -> Model:
    rng = np.random.default_rng(seed)
    normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype("f4")
    return Model({
        "grams": normal(0.3, BUCKETS, GRAM_DIM),
        "in": normal(1 / np.sqrt(_INPUT), _INPUT, HIDDEN), "in_bias": np.zeros(HIDDEN, "f4"),
        "felt": normal(1 / np.sqrt(HIDDEN), HIDDEN, GATE), "felt_bias": np.zeros(GATE, "f4"),
        "gate": normal(1 / np.sqrt(HIDDEN), HIDDEN, GATE), "gate_bias": np.zeros(GATE, "f4"),
        "query": normal(1 / np.sqrt(GATE), GATE), "out": normal(1 / np.sqrt(HIDDEN), HIDDEN), "out_bias": np.zeros(1, "f4"),
    })


def fit(texts: list[str], labels: list[int], seed: int = 11) -> Model:
    """A model from whole labelled texts, in an order that doesn't depend on them."""
    rng = np.random.default_rng(seed)
    model = initial(seed)
    labels = np.array(labels, "f4")
    every = np.arange(len(labels))
    taught = every % 4 != 3
    good, bad = np.flatnonzero((labels == 1) & taught), np.flatnonzero((labels == 0) & taught)
    if not len(good) or not len(bad):
        share = (int(labels.sum()) + 1) / (len(labels) + 2)
        model.weights["out"][:] = 0
        model.weights["out_bias"][:] = np.log(share / (1 - share))
        return model
    # Short texts are rare; a few words out of some good ones stand in for them.
    pieces = []
    for i in good[::4]:
        words = texts[i].split()
        n = int(rng.integers(1, 13))
        if len(words) > 2 * n:
            at = int(rng.integers(len(words) - n))
            pieces.append(" ".join(words[at:at + n]))
    good = np.r_[good, len(texts) + np.arange(len(pieces))]
    taught_labels = np.r_[labels, np.ones(len(pieces), "f4")]
    bags = _bags([*texts, *pieces])
    adam = Adam(model.weights)
    for step in range(_STEPS):
        docs = np.concatenate([rng.choice(good, _DOCS // 2), rng.choice(bad, _DOCS // 2)])
        g, _ = gradients(model, bags, docs, taught_labels[docs])
        rate = _RATE * (1 - 0.9 * step / _STEPS)
        adam.step(model.weights, g, rate)
        for name in ("grams", "in", "felt", "gate", "out"):
            model.weights[name] *= np.float32(1 - rate * _DECAY)
    aside = every[~taught]
    reached = model.logits([texts[i] for i in aside])
    high, low = reached[labels[aside] == 1], reached[labels[aside] == 0]
    if len(low) and len(high):
        low, high = float(np.quantile(low, 0.9)), float(np.quantile(high, 0.02))
        slope = 6 / max(high - low, 2.0)
        model.scale = (slope, (min(low, high) + high) / 2 - np.log(THRESHOLD / (1 - THRESHOLD)) / slope)
    return model


# On Spark


def is_held_out(id_col: str = "doc_id"):
    """Documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    per_class: int = PER_CLASS,
) -> Model:
    """A model from at most ``per_class`` labelled documents of each class outside the held-out fifth."""
    known = labels.filter(~is_held_out(id_col) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(label_col).alias("_label"))
    texts, values = [], []
    for value in (1, 0):
        some = known.filter(F.col("_label") == value).select("_id", F.xxhash64("_id").alias("_order")).orderBy("_order", "_id").limit(per_class)
        rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(some), "_id")
        for row in rows.groupBy("_order", "_id").agg(F.max("_text").alias("_text")).orderBy("_order", "_id").collect():
            texts.append(row["_text"] or "")
            values.append(value)
    return fit(texts, values)


def scores(column, model: Model):
    """Column of scores of a text column."""
    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out, start, size = [], 0, 0
            values = texts.tolist()
            for i, text in enumerate(values):
                size += len(text or "")
                if size > 1 << 21 or i == len(values) - 1:
                    out.append(model.scores(values[start:i + 1]))
                    start, size = i + 1, 0
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return of(column)


def score_documents(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """(id, held_out, score, predicted) for every row; repeated rows come as often as they do, no rows give none."""
    return docs.select(F.col(id_col), is_held_out(id_col).alias("held_out"), scores(F.col(text_col), model).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
