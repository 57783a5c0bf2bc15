"""Language identification by a string kernel.

A document is the set of character n-grams (n = 1, 2, 3: a blended spectrum) that occur in its
whole lower-cased text, with runs of other characters than letters as one gap. The kernel of two
documents is the number of n-grams that both have, over the root of the product of their numbers:
presence, so length and repetition don't weigh in. Nystroem landmarks give a finite feature map:
kernel values against the landmarks times K_mm ** -1/2. On it, one-versus-rest ridge regression
is solved in closed form. Scoring is two matrix products for a batch of documents.

The kernel is exact: a document is compared over all n-grams of the landmarks and divided by the root of the number of
all its own, whatever its alphabet. Documents whose letters all occur in the landmarks are looked up in tables, others are sorted;
both give the same numbers.

Fit: from labelled rows outside the held-out fold, at most ``per_lang`` of each language (fewer, at least one, if all would be more
than MOST_ROWS) of texts up to FIT_BYTES bytes, those with the smallest hash of the id: a documented, bounded sample.
Every row is scored over its whole text.

Defined cases: null text and text without a letter are ``und`` with score 0; null labels are
not learned from; with no labelled row at all, everything is ``und``; repeated rows and ties give equal
results (a tie goes to the language first in order); extra columns are ignored or passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FIT_BYTES, hash_sample, held_out_by, unused

#: Codes of the lookup tables: 0 is the gap, 1 a letter that no landmark has.
CODES = 64
PER_LANG, MOST_ROWS, LANDMARKS, RIDGE, PER_BATCH = 400, 20_000, 192, 1e-3, 256


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)


_ALPHA = np.zeros(0x110000, dtype=bool)


def is_letter() -> np.ndarray:
    """For each code point, whether it is a letter; made once in a process."""
    if not _ALPHA[97]:
        _ALPHA[:] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _ALPHA


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray  # code point -> 0 for a gap, 1 for a letter, above that the code of a letter of the landmarks
    grams: tuple[np.ndarray, ...]  # the landmarks' n-grams, by n, sorted
    places: tuple[np.ndarray, ...]  # the same in the lookup tables; empty if the landmarks have more letters than the tables
    landmarks: np.ndarray  # n-grams x landmarks, normalised
    weights: np.ndarray  # landmarks x languages

    def presence(self, text: str | None) -> tuple[np.ndarray, int] | None:
        """The 0/1 row of a text over the landmarks' n-grams, and the number of all its own n-grams; None if it has no letter."""
        points = _points(text) if text else np.zeros(0, np.uint32)
        kinds = self.codes[points]
        if not kinds.any():
            return None
        out, total = [], 0
        if len(self.places) and not (kinds == 1).any():
            for n, (g, own) in enumerate(zip(spectrum(kinds, 6), self.places, strict=True), 1):
                seen = np.zeros(CODES**n, dtype=bool)
                seen[g] = True
                total += int(np.count_nonzero(seen))
                out.append(seen[own])
        else:
            for g, own in zip(spectrum(np.where(kinds > 0, points, 0), 21), self.grams, strict=True):
                g = np.unique(g)
                total += len(g)
                at = np.minimum(np.searchsorted(g, own), len(g) - 1)
                out.append(g[at] == own)
        return np.concatenate(out), total

    def kernel(self, rows: list[tuple[np.ndarray, int]]) -> np.ndarray:
        """Kernel values against the landmarks, a batch in one product."""
        hits = np.stack([r for r, _ in rows]).astype(np.float32) @ self.landmarks
        return hits / np.sqrt(np.array([n for _, n in rows], dtype=np.float32))[:, None]

    def scores(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, score = ["und"] * len(texts), np.zeros(len(texts))
        rows = [self.presence(t) for t in texts] if self.langs else []
        has = [k for k, r in enumerate(rows) if r is not None]
        if has:
            margins = self.kernel([rows[k] for k in has]) @ self.weights
            p = np.exp(6 * (margins - margins.max(1, keepdims=True)))
            p /= p.sum(1, keepdims=True)
            for k, best, row in zip(has, p.argmax(1), p, strict=True):
                langs[k], score[k] = self.langs[best], float(row[best])
        return langs, score


def spectrum(letters: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams of letters (0 is a gap) as numbers of ``bits`` a letter, with a gap at either end and gaps in a row as one."""
    c = np.concatenate(([0], letters.astype(np.int64), [0]))
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
    two = c[:-1] << bits | c[1:]
    return c[1:-1], two, two[:-1] << bits | c[2:]


def fit(texts: list[str], labels: list[str]) -> Model:
    codes = is_letter().astype(np.uint8)
    nothing = np.zeros((0, 0), np.float32)
    own = [(t, lang) for t, lang in zip(texts, labels, strict=True) if codes[_points(t)].any()]
    langs = sorted({lang for _, lang in own})
    if not langs:
        return Model([], codes, (), (), nothing, nothing)
    by_lang = [[t for t, lang in own if lang == name] for name in langs]
    marks = [some[i] for i in range(max(map(len, by_lang))) for some in by_lang if i < len(some)][:LANDMARKS]
    sets = [[np.unique(g) for g in spectrum(np.where(codes[p] > 0, p, 0), 21)] for p in map(_points, marks)]
    grams = tuple(np.unique(np.concatenate([s[n] for s in sets])) for n in range(3))
    letters = grams[0][grams[0] > 0]
    places: tuple[np.ndarray, ...] = ()
    if len(letters) <= CODES - 2:
        codes[letters] = np.arange(2, 2 + len(letters))
        places = tuple(sum(codes[(g >> 21 * k) & (1 << 21) - 1].astype(np.int64) << 6 * k for k in range(n)) for n, g in enumerate(grams, 1))
    landmarks = np.zeros((sum(map(len, grams)), len(marks)), dtype=np.float32)
    starts = np.cumsum([0, *map(len, grams)])
    for k, s in enumerate(sets):
        for n in range(3):
            landmarks[starts[n] + np.searchsorted(grams[n], s[n]), k] = 1 / np.sqrt(sum(map(len, s)))
    model = Model(langs, codes, grams, places, landmarks, nothing)
    rows = lambda some: [model.presence(t) for t in some]
    k_nm = np.concatenate([model.kernel(rows([t for t, _ in own[a : a + PER_BATCH]])) for a in range(0, len(own), PER_BATCH)]).astype(np.float64)
    k_mm = (landmarks.T @ landmarks).astype(np.float64)
    y = np.array([lang for _, lang in own])
    values, vectors = np.linalg.eigh(k_mm)
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    z = k_nm @ root
    targets = np.where(y[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    weight = np.array([1 / max(1, (y == lang).sum()) for lang in langs])[np.searchsorted(langs, y)][:, None]  # languages count alike
    ridge = z.T @ (weight * z) + RIDGE * np.eye(z.shape[1])
    model.weights = (root @ np.linalg.solve(ridge, z.T @ (weight * targets))).astype(np.float32)
    return model


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Fit on at most ``per_lang`` rows of each language, by the smallest hash of id and text."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").where(F.octet_length("text") <= FIT_BYTES).where(~held_out_by(F.col("doc_id"), 4, 2))
    sample = hash_sample(rows.select("doc_id", "lang", "text"), "lang", per_lang, F.xxhash64("doc_id", F.xxhash64("text")), MOST_ROWS)
    return fit([r["text"] for r in sample], [r["lang"] for r in sample])


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, reject: bool = False) -> DataFrame:
    """``lang_pred`` and ``score`` for every row, beside the columns ``keep`` (all by default).
    With ``reject``, rows predicted ``und`` go, and no column is added."""
    from pyspark.sql import types as T

    keep = docs.columns if keep is None else keep
    keep = keep if reject else [c for c in keep if c not in ("lang_pred", "score")]
    (extra,) = unused(keep, "_text")
    name = "text" if "text" in keep else extra
    slim = docs.select(*keep, *[F.col("text").alias(extra)] * (name == extra))
    fields = [f for f in slim.schema.fields if f.name != extra]
    out = T.StructType(fields + ([] if reject else [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(it: Iterator) -> Iterator:
        import pyarrow as pa

        model = shared.value
        for big in it:
            for a in range(0, big.num_rows, PER_BATCH):
                batch = big.slice(a, PER_BATCH)
                langs, scores = model.scores(batch.column(name).to_pylist())
                t = pa.Table.from_batches([batch]).select([f.name for f in fields])
                if reject:
                    t = t.filter(pa.array([x != "und" for x in langs]))
                else:
                    t = t.append_column("lang_pred", pa.array(langs, pa.string())).append_column("score", pa.array(scores, pa.float64()))
                yield from t.to_batches()

    return slim.mapInArrow(score, out)


def query(docs: DataFrame) -> DataFrame:
    out = identify(docs.select("doc_id", "text"), train(docs), ["doc_id"])
    return out.select("doc_id", held_out_by(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents with a language, all columns as they were."""
    return identify(docs, train(docs), reject=True)
