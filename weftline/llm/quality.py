"""Quality classification with random-indexing word vectors and a small network.

1. Every token has an index vector: a few +1 and -1 at places seeded by a hash of the token. A word's vector
   is the sum of the index vectors around it in the sample (random indexing), scaled to length one. Tokens outside
   the vocabulary have none; beside it, every token has the index vector of its shape (case, digits and marks,
   runs collapsed), so that unseen words still count.
2. A document is pooled over all its tokens: mean and spread of the vectors, how much of a token is
   like the one before, the share of distinct tokens, and its length.
3. A two-layer network in numpy gives a logit; a temperature fitted on a part of the sample that the network didn't
   see calibrates the probability of label 1. The share of labels among all labelled rows sets the prior.

Fit: at most PER_LABEL rows a label outside the held-out fold, those with the smallest hash of the id, and of them the texts of up
to FIT_BYTES bytes (a documented, bounded sample). Every row is scored over its whole text. Defined cases: null and empty texts are pooled to zeros and
scored as such; without labelled rows of both kinds the score is the share of label 1 (0 if there are none);
labels of an id that contradict each other are not learned from; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out_by
from .toxicity import labelled, score_all

PER_LABEL, WORDS, SHAPES, NONZERO = 2000, 64, 32, 4
VOCABULARY, LEAST, AROUND, HIDDEN, CACHE = 20_000, 4, 2, 32, 300_000
#: Shapes of unseen words that a worker holds from text to text.
SHAPES_HELD = 20_000

_SHAPE = {c: "A" for c in range(65, 91)} | {c: "a" for c in range(97, 123)} | {c: "0" for c in range(48, 58)}
_RUNS = re.compile(r"(.)\1+")


def shape(token: str) -> str:
    if not token.isascii():
        token = "".join(c if c.isascii() else "A" if c.isupper() else "a" if c.isalpha() else "?" for c in token)
    return _RUNS.sub(r"\1", token.translate(_SHAPE))


def index_vector(token: str, size: int) -> np.ndarray:
    import xxhash

    h = xxhash.xxh3_128_intdigest(token.encode("utf-8", "replace"))
    out = np.zeros(size, dtype=np.float32)
    for k in range(NONZERO):
        part = (h >> (16 * k)) & 0xFFFF
        out[(part >> 1) % size] += 1 if part & 1 else -1
    return out


@dataclass
class Model:
    words: dict[str, int] = field(default_factory=dict)  # token -> row of vectors
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, WORDS + SHAPES), np.float32))
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    layers: tuple[np.ndarray, ...] = ()
    temperature: float = 1.0
    prior: float = 0.0
    share: float = 0.0

    def rows_of(self, tokens: list[str]) -> np.ndarray:
        """A row of ``vectors`` for each token; unseen tokens get the row of their shape, made on first sight."""
        if not hasattr(self, "_known") or len(self._shapes) >= SHAPES_HELD:  # forgotten between texts only: any text gets all its shapes
            self._known, self._shapes, self._table = dict(self.words), {}, [*self.vectors]
            self._array = None
        known, out = self._known, np.empty(len(tokens), dtype=np.int64)
        for k, t in enumerate(tokens):
            row = known.get(t)
            if row is None:
                s = shape(t)
                row = self._shapes.get(s)
                if row is None:
                    row = self._shapes[s] = len(self._table)
                    self._table.append(np.concatenate((np.zeros(WORDS, np.float32), index_vector(s, SHAPES))))
                    self._array = None
                if len(known) < CACHE:
                    known[t] = row
            out[k] = row
        return out

    def pooled(self, text: str | None) -> np.ndarray:
        tokens = text.split() if text else []
        out = np.zeros(2 * (WORDS + SHAPES) + 4)
        n = len(tokens)
        if not n:
            return out
        rows = self.rows_of(tokens)
        if getattr(self, "_array", None) is None or len(self._array) < len(self._table):
            self._array = np.stack(self._table)
        kinds, inverse = np.unique(rows, return_inverse=True)
        share = np.bincount(inverse) / n
        v = self._array[kinds]
        mean = share @ v
        spread = np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0))
        same = np.fromiter(map(str.__eq__, tokens[1:], tokens), dtype=bool, count=n - 1).mean() if n > 1 else 0.0
        distinct = len(set(tokens))
        return np.concatenate((mean, spread, [same, distinct / n, np.log1p(n), np.log1p(distinct)]))

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(np.clip((x - self.centre) / self.scale, -8, 8) @ w1 + b1) @ w2 + b2

    def score(self, text: str | None) -> float:
        if not self.layers:
            return self.share
        z = self.logits(self.pooled(text)[None, :])[0] / self.temperature + self.prior
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}


def word_vectors(texts: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Random indexing over the sample: vocabulary and vectors, with the shapes' index vectors beside."""
    ids: dict[str, int] = {}
    docs = [np.fromiter((ids.setdefault(t, len(ids)) for t in text.split()), dtype=np.int64) for text in texts]
    if not ids:
        return {}, np.zeros((0, WORDS + SHAPES), np.float32)
    counts = np.bincount(np.concatenate(docs), minlength=len(ids))
    names = list(ids)
    order = sorted(np.flatnonzero(counts >= LEAST).tolist(), key=lambda i: (-counts[i], names[i]))[:VOCABULARY]
    place = np.full(len(ids), -1)
    place[order] = np.arange(len(order))
    index = np.stack([index_vector(names[i], WORDS) for i in order]) if order else np.zeros((0, WORDS), np.float32)
    around = np.zeros_like(index)
    for d in docs:
        p = place[d]
        for step in range(1, AROUND + 1):
            a, b = p[:-step], p[step:]
            both = (a >= 0) & (b >= 0)
            np.add.at(around, a[both], index[b[both]])
            np.add.at(around, b[both], index[a[both]])
    around /= np.maximum(np.linalg.norm(around, axis=1, keepdims=True), 1e-9)
    shapes = np.stack([index_vector(shape(names[i]), SHAPES) for i in order]) if order else np.zeros((0, SHAPES), np.float32)
    return {names[i]: k for k, i in enumerate(order)}, np.concatenate((around, shapes), axis=1).astype(np.float32)


def fit_network(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 5e-3, decay: float = 1e-3) -> tuple[np.ndarray, ...]:
    """Full-batch Adam on the cross-entropy of a tanh layer and a logit."""
    rng = np.random.default_rng(3)
    params = [rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        h = np.tanh(x @ params[0] + params[1])
        g = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30))) - y) / len(y)
        back = np.outer(g, params[2]) * (1 - h * h)
        grads = [x.T @ back + decay * params[0], back.sum(0), h.T @ g + decay * params[2], np.array([g.sum()])]
        for k, d in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d * d
            params[k] = params[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return tuple(params)


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss on unseen rows."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.logaddexp(0, np.where(y > 0, -z, z) / t).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(texts: list[str], labels: list[int], share: float | None = None) -> Model:
    y = np.array(labels, dtype=float)
    if not len(y) or y.all() or not y.any():
        return Model(share=float(y.mean()) if len(y) else 0.0)
    share = float(y.mean()) if share is None else share
    words, vectors = word_vectors(texts)
    model = Model(words, vectors, share=share)
    x = np.stack([model.pooled(t) for t in texts])
    unseen = np.zeros(len(y), dtype=bool)
    for label in (0, 1):
        unseen[np.flatnonzero(y == label)[::5]] = True
    unseen &= len(y) >= 50
    own = ~unseen
    model.centre, model.scale = x[own].mean(0), x[own].std(0) + 1e-2
    model.layers = fit_network(np.clip((x[own] - model.centre) / model.scale, -8, 8), y[own])
    if unseen.any():
        model.temperature = temperature(model.logits(x[unseen]), y[unseen])
    if 0 < share < 1:
        model.prior = float(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))
    return model


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    texts, y, share = labelled(docs, labels, "quality", 5, 0, per_label)
    return fit(texts, y, share)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score_all(docs, train(docs, labels))
    return out.select("doc_id", held_out_by(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
