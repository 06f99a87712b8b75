"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

A word's input is its embedding, if it is in the vocabulary of the training sample,
joined with the sum of the embeddings of its hashed character n-grams, so that
unseen forms of a stem are read too. Two gated recurrent passes run over a window of
words; attention weights their states, and one logistic unit scores the weighted
sum. A text's score is that of its highest-scoring window; windows overlap and cover
the whole text.

Training runs in numpy on the driver over a bounded sample of labelled documents,
``PER_CLASS`` of each class, chosen by a hash of their id. Labels hold for whole
documents, so after the first rounds each toxic document is represented by its
highest-scoring windows, clean ones by their highest-scoring and some random ones;
toxic documents none of whose windows look toxic by then count as mislabelled. A
quarter of the sample is kept from training and sets the scale of the scores: 0.7
lies half way between what the highest 2 % of its clean documents and half of its
toxic ones reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import fresh

PER_CLASS = 900
THRESHOLD = 0.7
WINDOW, STRIDE = 48, 32
HIDDEN, WORD_DIM, CHAR_DIM, BUCKETS, VOCABULARY = 8, 8, 12, 1 << 14, 4000
_ROUNDS, _STEPS, _BATCH, _RATE, _DECAY = 6, 80, 128, 0.012, 0.3
_REMEMBERED = 150_000
_WINDOWS_AT_ONCE = 1024
_EDGE = 2  # code point that stands for both ends of a word
_MARKS = ".,;:!?\"'()[]{}<>*#%&$-_/\\|~`=+"


def _plain(word: str) -> str:
    return word.lower().strip(_MARKS) or word


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character 3- and 5-grams of the words, edges included, and the word each belongs to."""
    edge = chr(_EDGE)
    joined = edge + edge.join(w.replace(edge, " ") for w in words) + edge
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    at_edge = codes == _EDGE
    word_of = np.cumsum(at_edge) - 1
    buckets, owners = [], []
    for n in (3, 5):
        if len(codes) < n:
            continue
        m = len(codes) - n + 1
        inside = ~at_edge[1:m + 1]
        for k in range(2, n - 1):
            inside = inside & ~at_edge[k:m + k]
        at = np.flatnonzero(inside)
        value = np.full(len(at), n, "u8")
        for k in range(n):
            value = (value ^ codes[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        buckets.append((value % np.uint64(BUCKETS)).astype("i4"))
        owners.append(word_of[at + 1])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(buckets)[order], owner[order]


def _spans(n: int) -> list[tuple[int, int]]:
    """Overlapping windows that cover n words; the last one ends at the end."""
    if n <= WINDOW:
        return [(0, n)]
    return [(a, a + WINDOW) for a in range(0, n - WINDOW, STRIDE)] + [(n - WINDOW, n)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: dict[str, np.ndarray]
    scale: tuple[float, float] = (1.0, 0.0)  # slope and middle of the logits
    cache: dict[str, int] = field(default_factory=dict, repr=False)
    rows: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "weights": self.weights, "scale": self.scale, "cache": {}, "rows": None}

    # Inputs of the two passes for words: (words, 2, 3 * HIDDEN).

    def word_features(self, words: list[str]):
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in words), "i4", len(words))
        buckets, owner = _grams(words)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        scale = (1 / np.sqrt(np.diff(np.r_[starts, len(owner)]))).astype("f4")
        return ids, buckets, starts, scale

    def embed(self, features) -> np.ndarray:
        ids, buckets, starts, scale = features
        chars = np.add.reduceat(self.weights["chars"][buckets], starts, axis=0) * scale[:, None]
        return np.concatenate([self.weights["words"][ids], chars], axis=1)

    def project(self, embedded: np.ndarray) -> np.ndarray:
        return np.einsum("ni,dij->ndj", embedded, self.weights["in"], optimize=True) + self.weights["bias"]

    def _lookup(self, words: list[str]) -> np.ndarray:
        """Row of each word in ``rows``; row 0 is the input of no word at all."""
        if self.rows is None or len(self.cache) > _REMEMBERED:
            self.cache, self.rows = {}, np.zeros((1 << 12, 2, 3 * HIDDEN), "f4")
            self.rows[0] = self.weights["bias"]
        cache = self.cache
        missing = list({w for w in words if w not in cache})
        if missing:
            first = len(cache) + 1
            while first + len(missing) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for at in range(0, len(missing), 1 << 14):
                part = missing[at:at + (1 << 14)]
                plain = [_plain(w) for w in part]
                self.rows[first + at:first + at + len(part)] = self.project(self.embed(self.word_features(plain)))
            cache.update(zip(missing, range(first, first + len(missing))))
        return np.fromiter(map(cache.__getitem__, words), "i4", len(words))

    def states(self, inputs: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """States of both passes (steps, 2, windows, HIDDEN) for inputs (steps, 2, windows, 3 * HIDDEN)."""
        steps, _, n, _ = inputs.shape
        h = np.zeros((2, n, HIDDEN), "f4")
        out = np.empty((steps, 2, n, HIDDEN), "f4")
        for t in range(steps):
            mixed = np.matmul(h, self.weights["state"])
            gates = _sigmoid(inputs[t, :, :, :2 * HIDDEN] + mixed[:, :, :2 * HIDDEN])
            update, reset = gates[:, :, :HIDDEN], gates[:, :, HIDDEN:]
            new = np.tanh(inputs[t, :, :, 2 * HIDDEN:] + reset * mixed[:, :, 2 * HIDDEN:])
            after = new + update * (h - new)
            if mask is not None:
                after = np.where(mask[t], after, h)
            if keep is not None:
                keep.append((h, mixed, update, reset, new))
            out[t] = h = after
        return out

    def logits(self, states: np.ndarray, mask: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
        """Scores of windows; ``states`` of the backward pass are in reading order already."""
        w = self.weights
        both = np.concatenate([states[:, 0], states[:, 1]], axis=2)
        felt = np.tanh(both @ w["attend"] + w["attend_bias"])
        score = felt @ w["query"]
        if mask is not None:
            score = np.where(mask, score, -1e9)
        score = np.exp(score - score.max(axis=0))
        attention = score / score.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", attention, both)
        if keep is not None:
            keep.update(both=both, felt=felt, attention=attention, pooled=pooled)
        return pooled @ w["out"] + w["out_bias"]

    def window_logits(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Scores of windows given as row numbers (windows, steps), padded behind ``lengths``."""
        steps = rows.shape[1]
        mask = None if lengths.min(initial=steps) == steps else np.arange(steps)[:, None] < lengths[None, :]
        ahead = self.rows[:, 0][rows.T]
        back = self.rows[:, 1][rows.T[::-1]]
        both = None if mask is None else np.stack([mask, mask[::-1]], axis=1)[..., None]
        states = self.states(np.stack([ahead, back], axis=1), both)
        states[:, 1] = states[::-1, 1].copy()
        return self.logits(states, mask)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Score of each whole text, between 0 and 1."""
        slope, middle = self.scale
        return np.round(_sigmoid(slope * (self.best_logits(texts) - middle)), 6)

    def best_logits(self, texts: list[str | None]) -> np.ndarray:
        """The highest window score of each text."""
        owner, found = self.all_logits([(t or "").split() for t in texts])
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, found)
        return best

    def all_logits(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all windows of texts given as words, in order, and the text each belongs to."""
        rows = np.concatenate([self._lookup([w for words in docs for w in words]), np.zeros(WINDOW, "i4")])
        at, places = 0, []
        for i, words in enumerate(docs):
            places += [(at + a, b - a, i) for a, b in _spans(len(words))]
            at += len(words)
        first, lengths, owner = np.array(places, "i8").reshape(-1, 3).T
        out = np.empty(len(first))
        # Windows of full length go together, so that only the short texts need a mask.
        order = np.argsort(lengths, kind="stable")
        for start in range(0, len(order), _WINDOWS_AT_ONCE):
            some = order[start:start + _WINDOWS_AT_ONCE]
            steps = max(int(lengths[some].max()), 1)
            window = rows[first[some][:, None] + np.arange(steps)]
            window[np.arange(steps) >= lengths[some][:, None]] = 0
            out[some] = self.window_logits(window, np.maximum(lengths[some], 1))
        return owner, out


# Training


def _initial(vocabulary: dict[str, int], seed: int) -> Model:
    rng = np.random.default_rng(seed)
    normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype("f4")
    inputs = WORD_DIM + CHAR_DIM
    return Model(vocabulary, {
        "words": np.concatenate([np.zeros((1, WORD_DIM), "f4"), normal(0.1, len(vocabulary), WORD_DIM)]),
        "chars": normal(0.1, BUCKETS, CHAR_DIM),
        "in": normal(1 / np.sqrt(inputs), 2, inputs, 3 * HIDDEN), "bias": np.zeros((2, 1, 3 * HIDDEN), "f4")[:, 0],
        "state": normal(1 / np.sqrt(HIDDEN), 2, HIDDEN, 3 * HIDDEN),
        "attend": normal(1 / np.sqrt(2 * HIDDEN), 2 * HIDDEN, HIDDEN), "attend_bias": np.zeros(HIDDEN, "f4"),
        "query": normal(1 / np.sqrt(HIDDEN), HIDDEN), "out": normal(1 / np.sqrt(2 * HIDDEN), 2 * HIDDEN),
        "out_bias": np.zeros(1, "f4"),
    })


class Adam:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}
        self.t = 0

    def step(self, weights, gradients, rate):
        self.t += 1
        fix = np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        for k, g in gradients.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            weights[k] -= (rate * fix * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype("f4")


def _summed(place: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows that go to each of n places."""
    return np.stack([np.bincount(place, rows[:, k], n) for k in range(rows.shape[1])], axis=1).astype("f4")


def _gradients(model: Model, windows: list[list[str]], labels: np.ndarray, rng) -> tuple[dict, np.ndarray]:
    """Gradients of the mean logistic loss over windows of plain words."""
    w = model.weights
    distinct = list(dict.fromkeys(x for win in windows for x in win))
    number = {x: i + 1 for i, x in enumerate(distinct)}
    n, steps = len(windows), max(1, max(map(len, windows)))
    index = np.zeros((steps, n), "i4")
    mask = np.zeros((steps, n), bool)
    for j, win in enumerate(windows):
        index[:len(win), j] = [number[x] for x in win]
        mask[:max(len(win), 1), j] = True
    if distinct:
        features = model.word_features(distinct)
        dropped = rng.random(len(distinct)) < 0.3  # these are read by their characters alone
        features = (np.where(dropped, 0, features[0]), *features[1:])
        embedded = np.concatenate([np.zeros((1, WORD_DIM + CHAR_DIM), "f4"), model.embed(features)])
    else:
        embedded = np.zeros((1, WORD_DIM + CHAR_DIM), "f4")
    table = model.project(embedded)
    both_index = np.stack([index, index[::-1]], axis=1)
    inputs = np.stack([table[index, 0], table[index[::-1], 1]], axis=1)
    both_mask = np.stack([mask, mask[::-1]], axis=1)[..., None]
    kept: list = []
    states = model.states(inputs, both_mask, kept)
    read = states.copy()
    read[:, 1] = states[::-1, 1]
    pool: dict = {}
    p = _sigmoid(model.logits(read, mask, pool))
    g = {}
    d_logit = ((p - labels) / n).astype("f4")
    g["out"], g["out_bias"] = pool["pooled"].T @ d_logit, d_logit.sum(keepdims=True)
    d_pooled = d_logit[:, None] * w["out"]
    both, felt, attention = pool["both"], pool["felt"], pool["attention"]
    d_both = attention[..., None] * d_pooled
    d_attention = np.einsum("tnk,nk->tn", both, d_pooled)
    d_score = attention * (d_attention - (attention * d_attention).sum(axis=0))
    g["query"] = np.einsum("tn,tnk->k", d_score, felt)
    d_felt = d_score[..., None] * w["query"] * (1 - felt * felt)
    g["attend"] = np.einsum("tnk,tnj->kj", both, d_felt, optimize=True)
    g["attend_bias"] = d_felt.sum(axis=(0, 1))
    d_both = d_both + d_felt @ w["attend"].T
    d_states = np.stack([d_both[:, :, :HIDDEN], d_both[::-1, :, HIDDEN:]], axis=1)
    d_inputs = np.empty_like(inputs)
    d_state = np.zeros_like(w["state"])
    d_h = np.zeros((2, n, HIDDEN), "f4")
    back = w["state"].transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        h, mixed, update, reset, new = kept[t]
        d_after = (d_h + d_states[t]) * both_mask[t]
        passed = (d_h + d_states[t]) * ~both_mask[t]
        d_new = d_after * (1 - update) * (1 - new * new)
        d_update = d_after * (h - new) * update * (1 - update)
        d_reset = d_new * mixed[:, :, 2 * HIDDEN:] * reset * (1 - reset)
        d_mixed = np.concatenate([d_update, d_reset, d_new * reset], axis=2)
        d_inputs[t] = np.concatenate([d_update, d_reset, d_new], axis=2)
        d_state += np.matmul(h.transpose(0, 2, 1), d_mixed)
        d_h = passed + d_after * update + np.matmul(d_mixed, back)
    g["state"] = d_state
    d_table = np.zeros_like(table)
    for d in (0, 1):
        d_table[:, d] = _summed(both_index[:, d].ravel(), d_inputs[:, d].reshape(-1, 3 * HIDDEN), len(table))
    g["bias"] = d_table.sum(axis=0)
    g["in"] = np.einsum("ni,ndj->dij", embedded, d_table, optimize=True)
    if distinct:
        d_embedded = np.einsum("ndj,dij->ni", d_table, w["in"], optimize=True)[1:]
        ids, buckets, starts, scale = features
        g["words"] = _summed(ids, d_embedded[:, :WORD_DIM], len(w["words"]))
        g["words"][0] = 0
        counts = np.diff(np.r_[starts, len(buckets)])
        g["chars"] = _summed(buckets, np.repeat(d_embedded[:, WORD_DIM:] * scale[:, None], counts, axis=0), BUCKETS)
    return g, p


def fit(texts: list[str], labels: list[int], seed: int = 5) -> Model:
    """A model from whole labelled texts, in an order that doesn't depend on them.

    Without both classes among the texts it trains on it gives all texts the smoothed share of toxic ones.
    """
    rng = np.random.default_rng(seed)
    docs = [[_plain(w) for w in t.split()] for t in texts]
    labels = np.array(labels, "f4")
    seen: dict[str, int] = {}
    for words in docs:
        for word in set(words):
            seen[word] = seen.get(word, 0) + 1
    common = sorted((w for w, c in seen.items() if c >= 3), key=lambda w: (-seen[w], w))[:VOCABULARY]
    model = _initial({w: i + 1 for i, w in enumerate(common)}, seed)
    every = np.arange(len(labels))
    toxic, clean = np.flatnonzero((labels == 1) & (every % 4 != 3)), np.flatnonzero((labels == 0) & (every % 4 != 3))
    if not len(toxic) or not len(clean):
        share = (int(labels.sum()) + 1) / (len(labels) + 2)
        model.weights["out"][:] = 0
        model.weights["out_bias"][:] = np.log(share / (1 - share))
        return model
    spans = [_spans(len(d)) for d in docs]
    adam, trusted = Adam(model.weights), toxic
    best: list[np.ndarray] = []
    for turn in range(_ROUNDS):
        if turn >= 2:
            # Highest-scoring windows first, by the model so far.
            model.cache, model.rows = {}, None
            found = _per_document(model, docs)
            best = [np.argsort(-f) for f in found]
            if turn >= 3:
                top = _sigmoid(np.array([found[i].max() for i in toxic]))
                trusted = toxic[top >= 0.3] if (top >= 0.3).any() else toxic
        for step in range(_STEPS):
            picked, y = [], []
            for group, label in ((trusted, 1), (clean, 0)):
                for i in rng.choice(group, _BATCH // 2):
                    if turn < 2 or rng.random() < (0.0 if label else 0.35):
                        k = rng.integers(len(spans[i]))
                    else:
                        k = best[i][min(rng.integers(1 + (len(spans[i]) + 1) // 3 if label else 3), len(spans[i]) - 1)]
                    a, b = spans[i][k]
                    picked.append(docs[i][a:b])
                    y.append(label)
            picked[-1], y[-1] = [], 0  # an empty text is clean
            gradients, _ = _gradients(model, picked, np.array(y, "f4"), rng)
            rate = _RATE * (1 - 0.8 * (turn * _STEPS + step) / (_ROUNDS * _STEPS))
            adam.step(model.weights, gradients, rate)
            for k in ("words", "chars"):  # what is rarely confirmed fades
                model.weights[k] *= np.float32(1 - rate * _DECAY)
    model.cache, model.rows = {}, None
    aside = [i for i in every if i % 4 == 3]
    reached = model.best_logits([texts[i] for i in aside])
    low, high = reached[labels[aside] == 0], reached[labels[aside] == 1]
    if len(low) and len(high):
        low, high = float(np.quantile(low, 0.98)), float(np.median(high))
        slope = 6 / max(high - low, 2.0)
        model.scale = (slope, (low + max(high, low)) / 2 - np.log(THRESHOLD / (1 - THRESHOLD)) / slope)
    return model


def _per_document(model: Model, docs: list[list[str]], at_once: int = 200) -> list[np.ndarray]:
    """Scores of the windows of each document."""
    out = []
    for start in range(0, len(docs), at_once):
        owner, found = model.all_logits(docs[start:start + at_once])
        out += np.split(found, np.flatnonzero(np.diff(owner)) + 1)
    return out


# On Spark


def is_held_out(id_col: str = "doc_id"):
    """Documents whose labels are never learnt from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    per_class: int = PER_CLASS,
) -> Model:
    """A model from at most ``per_class`` labelled documents of each class outside the held-out third.

    Rows with a null label or id don't count; of repeated labels the largest holds.
    """
    known = labels.filter(~is_held_out(id_col) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(label_col).alias("_label"))
    texts, values = [], []
    for value in (1, 0):
        some = known.filter(F.col("_label") == value).select("_id", F.xxhash64("_id").alias("_order")).orderBy("_order", "_id").limit(per_class)
        rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(some), "_id").dropDuplicates(["_id"])
        for row in rows.orderBy("_order", "_id").collect():
            texts.append(row["_text"] or "")
            values.append(value)
    return fit(texts, values)


def scores(column, model: Model):
    """Column of scores of a text column; a null text is scored as an empty one."""
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


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold."""
    score = fresh(docs, "score")
    return docs.withColumn(score, scores(F.col(text_col), model)).filter(F.col(score) < threshold).drop(score)
