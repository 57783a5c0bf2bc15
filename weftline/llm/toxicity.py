"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A document is cut into windows
of WINDOW bytes; each is compressed once with either dictionary, and the difference of
the lengths says which kind of text it is nearer to.

Training text: byte 5-grams within words are counted by documents of the labelled sample. Where toxic
documents hold a gram far more often than ordinary ones do (a z-score, and RATIO times as often), it is
characteristic; the runs of such grams are the samples on which zstandard trains the toxic dictionary. It trains the ordinary
one on all windows of ordinary documents. Toxic documents are mostly ordinary prose as well, so windows are
compressed with the ordinary dictionary alone and with both, the toxic one in front: what both hold costs the same and cancels.

Calibration: logistic regression on the documents' largest and summed differences, fitted across two
folds (each measured with dictionaries trained on the other), gives the probability of label 1; the threshold of the query is 0.3.

Fit: at most PER_LABEL rows a label outside the held-out fold, those with the smallest hash of the id, and of them the texts of up
to FIT_BYTES bytes (a documented, bounded sample). Every row is scored over its whole text. Defined cases: null and empty texts get the
score of a document without a window that differs; without labelled rows of both kinds the score is the share of
label 1 (0 if there are none); repeated labels of an id with different values are not learned from; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FIT_BYTES, hash_sample, held_out_by

PER_LABEL, WINDOW, STRIDE, GRAM = 2500, 256, 248, 5
#: Bytes asked of zstandard for either dictionary, and its parameters for the short samples of the toxic one.
DICTIONARY, SEGMENT, DMER = 16_384, 32, 6
Z_LEAST, RATIO = 5.0, 20.0
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BREAKS = bytes.maketrans(b"\t\n\r\v\f", b"     ")


def plain(text: str | None) -> bytes:
    return text.encode("utf-8", "replace").translate(_LOWER).translate(_BREAKS) if text else b""


def windows(data: bytes) -> list[bytes]:
    """Windows over the whole text; they overlap by a few bytes, so that short pieces at an edge are whole in one."""
    return [b" " + data[a : a + WINDOW] + b" " for a in range(0, max(len(data) - (WINDOW - STRIDE), 1), STRIDE)] if data else []


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))
    share: float = 0.0

    def __post_init__(self) -> None:
        self._lengths = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_lengths"} | {"_lengths": None}

    def differences(self, text: str | None) -> np.ndarray:
        """Bytes by which the toxic dictionary is better, for each window."""
        if self._lengths is None:
            self._lengths = [_compressor(d) for d in (self.ordinary, self.toxic)]
        ordinary, toxic = self._lengths
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(plain(text))], dtype=np.float64)

    def features(self, text: str | None) -> np.ndarray:
        d = self.differences(text)
        good = np.maximum(d, 0)
        return np.array([1.0, good.max(initial=0), np.log1p(good[good > 1].sum()), np.log1p(len(d)) / 4])

    def score(self, text: str | None) -> float:
        if not self.toxic:
            return self.share
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.weights, -30, 30))))


def _compressor(content: bytes):
    own = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    params = zstd.ZstdCompressionParameters(
        window_log=17, chain_log=17, hash_log=17, search_log=6, min_match=4, target_length=32, strategy=zstd.STRATEGY_LAZY2, write_content_size=0, write_dict_id=0
    )
    return zstd.ZstdCompressor(dict_data=own, compression_params=params).compress


def _grams(data: bytes) -> np.ndarray:
    b = np.frombuffer(b" " + data + b" ", dtype=np.uint8).astype(np.int64)
    out = np.zeros(max(len(b) - GRAM + 1, 0), dtype=np.int64)
    for k in range(GRAM):
        out = (out << 8) | b[k : len(b) - GRAM + 1 + k]
    return out


def _counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([np.unique(_grams(t)) for t in texts] or [np.zeros(0, np.int64)]), return_counts=True)


def characteristic(own: list[bytes], other: list[bytes]) -> np.ndarray:
    """The grams that ``own`` documents hold far more often than ``other`` ones, sorted."""
    g, n = _counts(own)
    h, m = _counts(other)
    at = np.minimum(np.searchsorted(h, g), max(len(h) - 1, 0))
    m = np.where(h[at] == g, m[at], 0) if len(h) else np.zeros(len(g))
    p, q = n / max(len(own), 1), m / max(len(other), 1)
    pooled = (n + m + 1) / (len(own) + len(other) + 2)
    z = (p - q) / np.sqrt(pooled * (1 - pooled) * (1 / max(len(own), 1) + 1 / max(len(other), 1)))
    within = np.ones(len(g), dtype=bool)  # a gap only at an end: grams lie within a word
    for k in range(1, GRAM - 1):
        within &= (g >> (8 * k)) & 255 != 32
    return g[within & (z >= Z_LEAST) & (p >= RATIO * q) & (n >= 3)]


def pieces(texts: list[bytes], grams: np.ndarray) -> list[bytes]:
    """The runs of characteristic grams in the texts."""
    out: list[bytes] = []
    for t in texts if len(grams) else ():
        g = _grams(t)
        hit = np.flatnonzero(grams[np.minimum(np.searchsorted(grams, g), len(grams) - 1)] == g)
        padded = b" " + t + b" "
        if len(hit):
            out += [padded[r[0] : r[-1] + GRAM] for r in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)]
    return out


def trained(samples: list[bytes], **parameters: int) -> bytes:
    """A dictionary trained by zstandard: of DICTIONARY bytes, or of less where the samples don't give so many. Samples
    too few for any training are their own dictionary, whole."""
    size = DICTIONARY
    while samples and size >= 256:
        try:
            return zstd.train_dictionary(size, samples, **parameters).as_bytes()
        except zstd.ZstdError:
            size //= 2
    return b"".join(samples)


def fit(texts: list[str], labels: list[int]) -> Model:
    data, y = [plain(t) for t in texts], np.array(labels, dtype=bool)
    if not len(y) or y.all() or not y.any():
        return Model(share=float(y.mean()) if len(y) else 0.0)
    # two folds: each calibrates with dictionaries trained on the other
    fold = np.zeros(len(y), dtype=int)
    for label in (True, False):
        own = np.flatnonzero(y == label)
        fold[own[1::2]] = 1
    x = np.zeros((len(y), 4))
    for k in (0, 1):
        part = dictionaries([d for d, f in zip(data, fold, strict=True) if f != k], y[fold != k])
        for i in np.flatnonzero(fold == k):
            x[i] = part.features(texts[i])
    model = dictionaries(data, y)
    model.weights = logistic(x, y)
    model.share = float(y.mean())
    return model


def dictionaries(data: list[bytes], y: np.ndarray) -> Model:
    toxic, ordinary = [d for d, t in zip(data, y, strict=True) if t], [d for d, t in zip(data, y, strict=True) if not t]
    base = trained([w for t in ordinary for w in windows(t)])
    return Model(trained(pieces(toxic, characteristic(toxic, ordinary)), k=SEGMENT, d=DMER) + base, base)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int, rest: int, per: int) -> tuple[list[str], list[int], float]:
    """The bounded sample of labelled rows outside the held-out fold: texts, labels, and the true share of label 1.

    The sample is drawn from the labels table alone; only its ids then pick texts."""
    own = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out_by(F.col("doc_id"), mod, rest))
    own = own.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2").select("doc_id", "y")
    counts = dict(own.groupBy("y").count().collect())
    ids = hash_sample(own, "y", per, F.xxhash64("doc_id"))
    spark = docs.sparkSession
    if not ids:
        return [], [], 0.0
    picked = spark.createDataFrame([(r["doc_id"], int(r["y"])) for r in ids], "doc_id long, y int")
    slim = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= FIT_BYTES)
    rows = slim.join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text").collect()
    rows = sorted({(r["doc_id"], r["y"], r["text"] or "") for r in rows})
    order = np.random.default_rng(5).permutation(len(rows))
    return [rows[i][2] for i in order], [rows[i][1] for i in order], counts.get(1, 0) / max(sum(counts.values()), 1)


def score_all(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score), one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in it:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model.score(t) for t in part.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    texts, y, share = labelled(docs, labels, "toxic", 4, 2, per_label)
    model = fit(texts, y)
    if model.toxic and 0 < share < 1:  # the sample is balanced, the documents are not
        model.weights[0] += np.log(share / (1 - share)) - np.log(np.mean(y) / (1 - np.mean(y)))
    return model


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score_all(docs, train(docs, labels))
    return out.select("doc_id", held_out_by(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
