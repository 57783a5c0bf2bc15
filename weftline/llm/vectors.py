"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

1. Rows of one label with the very same vector are one node with a number of rows, so copies are never compared.
2. ITQ: on a bounded sample (at most SAMPLE vectors, those with the smallest hash of the id: a
   documented bound) the vectors are centred, turned to principal axes, and a rotation is learned that
   brings them nearest to the corners of a cube, so that signs are balanced binary codes. Several
   rotations from different starts give independent codes; where vectors have fewer dimensions than a code has bits,
   a code is put together from several of them.
3. Every vector is encoded. Codes are cut into substrings of ``bits`` bits; two vectors of one label that
   agree on a whole substring meet in that table's bucket. ``bits`` grows with the logarithm of the
   largest label, so buckets stay small, and the number of tables is set so that a pair exactly at the
   threshold is missed in all of them with odds under MISS. How often the bits of such pairs agree is
   measured on pairs made around sample vectors, as centring drives pairs apart where vectors have
   a common direction. Past MOST_TABLES tables, substrings get shorter; where even the shortest need
   more, all vectors of a label are compared: exact, and quadratic in its size.
4. Buckets are compared block against block (at most BLOCK vectors a side) with the original vectors in
   double precision. A pair counts in the first table in which it meets, so links are counted once
   and never listed: a block returns a count per vector and one link per vector into its local
   component. Components are formed from those.

Defined cases: null ids keep a row without links; vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null label, link with nothing; vectors of different lengths aren't compared; a row that
repeats a vec_id is a vector of its own, with a row of its own, and links with the others by its own label and vector;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_groups
from .graph import components

COSINE, SAMPLE, MISS, BLOCK = 0.93, 20_000, 1e-4, 256
#: Vectors of a label that a bucket holds on average, about.
BUCKET, MIN_BITS, MAX_BITS, CODE = 16, 8, 24, 64
#: Pairs made to measure the bits' agreement, and rotations it is measured on.
PAIRS, MEASURED, MOST_TABLES = 2000, 8, 256


@dataclass
class Codes:
    mean: np.ndarray
    turns: list[np.ndarray]  # a d x c matrix per rotation
    bits: int
    tables: int

    def substrings(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) ints: the substrings of the codes of unit vectors."""
        if not self.bits:  # one bucket
            return np.zeros((len(x), 1), dtype=np.int64)
        out = []
        for turn in self.turns:
            signs = (x - self.mean) @ turn > 0
            for a in range(0, signs.shape[1] - self.bits + 1, self.bits):
                out.append(signs[:, a : a + self.bits] @ (1 << np.arange(self.bits)))
        return np.stack(out, axis=1)[:, : self.tables].astype(np.int64)


def itq(x: np.ndarray, c: int, seed: int, rounds: int = 40) -> np.ndarray:
    """The d x c projection whose signs are the codes of the rows of the centred ``x``."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    _, _, axes = np.linalg.svd(x, full_matrices=True) if len(x) <= d else (0, 0, np.linalg.eigh(x.T @ x)[1].T[::-1])
    if c > d:  # few dimensions: rotations from several starts, side by side
        return np.concatenate([itq(x, d, (seed + 1) * 1000 + k, rounds) for k in range(-(-c // d))], axis=1)[:, :c]
    w = axes[:c].T
    v = x @ w
    r = np.linalg.qr(rng.standard_normal((c, c)))[0]
    for _ in range(rounds):
        b = np.where(v @ r > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(v.T @ b)
        r = left @ right
    return w @ r


def plan(largest: int, cosine: float = COSINE) -> tuple[int, int]:
    """(bits of a substring, tables) for a label of ``largest`` vectors."""
    bits = min(max(math.ceil(math.log2(max(largest, 1) / BUCKET + 1)), MIN_BITS), MAX_BITS)
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - meet))


def agreement(sample: np.ndarray, mean: np.ndarray, turns: list[np.ndarray], cosine: float) -> list[np.ndarray]:
    """For pairs exactly at ``cosine`` around sample vectors, the share of code bits that agree: pairs apart in
    any direction, and pairs apart in the direction of other sample vectors."""
    rng = np.random.default_rng(0)
    x = sample[rng.integers(0, len(sample), PAIRS)]
    out = []
    for away in (rng.standard_normal(x.shape), sample[rng.integers(0, len(sample), PAIRS)]):
        u = away - (away * x).sum(1, keepdims=True) * x
        long = np.linalg.norm(u, axis=1, keepdims=True)
        y = cosine * x + math.sqrt(1 - cosine**2) * u / np.maximum(long, 1e-300)
        kept = long[:, 0] > 1e-6
        if kept.any():
            out.append(np.mean([(((x - mean) @ t > 0) == ((y - mean) @ t > 0))[kept].mean(1) for t in turns], axis=0))
    return out


def tables_for(agree: list[np.ndarray], bits: int) -> int:
    """Tables after which pairs with these agreements are missed with odds under MISS; MOST_TABLES + 1 if more are needed."""
    missed = [1 - a**bits for a in agree]
    low, high = 1, MOST_TABLES + 1
    while low < high:
        n = (low + high) // 2
        low, high = (low, n) if all((m**n).mean() <= MISS for m in missed) else (n + 1, high)
    return low


def learn(sample: np.ndarray, largest: int, cosine: float = COSINE) -> Codes:
    bits, tables = plan(largest, cosine)
    mean = sample.mean(0)
    turns = [itq(sample - mean, CODE, seed) for seed in range(MEASURED)]
    agree = agreement(sample, mean, turns, cosine)
    tables = max(tables, tables_for(agree, bits))
    while tables > MOST_TABLES and bits > MIN_BITS:
        bits -= 1
        tables = tables_for(agree, bits)
    if tables > MOST_TABLES:
        return Codes(mean, [], 0, 1)
    turns += [itq(sample - mean, CODE, seed) for seed in range(MEASURED, math.ceil(tables / (CODE // bits)))]
    return Codes(mean, turns, bits, tables)


def compare(t: pa.Table, cosine: float, kind: str) -> pa.Table | None:
    """Rows linked to each node of a block pair, and each linked node's smallest nid in the block pair's local component."""
    ids, rows, block = (t.column(c).to_numpy() for c in ("nid", "n_rows", "block"))
    table, low, high = (int(t.column(c)[0].as_py()) for c in ("tab", "bi", "bj"))
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    if not len(left) or not len(right):
        return None
    x = _scaled(np.frombuffer(b"".join(t.column("x").to_pylist()), dtype=kind).reshape(t.num_rows, -1).astype(np.float64))
    codes = t.column("codes").chunk(0).flatten().to_numpy().reshape(t.num_rows, -1)
    close = x[left] @ x[right].T >= cosine
    if low == high:
        close = np.triu(close, 1)
    i, j = np.nonzero(close)
    i, j = left[i], right[j]
    if table and len(i):
        new = ~(codes[i, :table] == codes[j, :table]).any(1)
        i, j = i[new], j[new]
    if not len(i):
        return None
    count = np.bincount(i, rows[j], minlength=len(ids)) + np.bincount(j, rows[i], minlength=len(ids))
    root = ids.copy()
    while True:  # smallest nid over links, by rounds
        before = root.copy()
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        if (root == before).all():
            break
    own = count > 0
    return pa.table({"nid": ids[own], "n": count[own].astype(np.int64), "root": root[own]})


def links(nodes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(nid, n, root): partial counts of linked rows, and links into local components. ``nodes``: nid, label, embedding (good vectors), n_rows."""
    kind = "float" if nodes.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    good = nodes.select("nid", "label", F.size("embedding").alias("d"), "n_rows", F.col("embedding").cast(f"array<{kind}>").alias("v"))
    kind = "<f4" if kind == "float" else "<f8"
    widest = good.groupBy("label", "d").agg(F.count("*").alias("n")).agg(F.max("d"), F.max("n")).first()
    empty = "nid long, n long, root long"
    if widest[0] is None:
        return nodes.sparkSession.createDataFrame([], empty)
    d, largest = widest
    sample = good.orderBy(F.xxhash64("nid")).limit(SAMPLE).select("v").toArrow().column("v").to_pylist()
    model = nodes.sparkSession.sparkContext.broadcast(learn(_unit(sample, d), largest, cosine))

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                rows = part.column(4).to_pylist()
                codes = model.value.substrings(_unit(rows, d)).astype(np.int32)
                codes = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32), codes.ravel())
                x = pa.array([np.pad(np.array(r, dtype=kind), (0, d - len(r))).tobytes() for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(4)], x, codes], ["nid", "label", "d", "n_rows", "x", "codes"])

    label = good.schema["label"].dataType.simpleString()
    coded = cut(good.mapInArrow(encode, f"nid long, label {label}, d int, n_rows long, x binary, codes array<int>"), "codes")
    keys = ["tab", "label", "d", "code"]
    spread = coded.select("nid", "label", "d", F.posexplode("codes").alias("tab", "code"))
    sizes = spread.groupBy(*keys).agg(F.count("*").alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    met = spread.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64("nid", "tab"), blocks).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")})
    met = met.join(coded.select("nid", "n_rows", "x", "codes"), "nid")
    where = [*keys, "bi", "bj"]
    return in_groups(met.select(*where, "block", "nid", "n_rows", "x", "codes"), where, lambda t: compare(t, cosine, kind), empty)


def _unit(rows: list, d: int) -> np.ndarray:
    x = np.zeros((len(rows), d))
    for k, r in enumerate(rows):
        x[k, : len(r)] = r
    return _scaled(x)


def _scaled(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)  # no overflow of squares
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector."""
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    some = F.exists("embedding", lambda e: e != 0)
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & some, F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long"), "label", "embedding").withColumn("good", good)
    same = [F.xxhash64("label", "embedding"), F.xxhash64("embedding", "label", F.lit(1))]
    rows = rows.select("vec_id", "label", "embedding", *[F.when(F.col("good"), h).alias(f"h{k}") for k, h in enumerate(same)])
    nodes = rows.where("h0 IS NOT NULL").groupBy("h0", "h1").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("n_rows"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    nodes = cut(nodes.withColumn("nid", F.monotonically_increasing_id()), "vectors")
    found = cut(links(nodes, cosine), "vector-links")
    comp = components(found.select(F.col("nid").alias("a"), F.col("root").alias("b")).distinct(), "vector-components").withColumnRenamed("id", "nid")
    near = nodes.select("nid", "h0", "h1", "least", "n_rows").join(comp, "nid", "left").withColumn("component", F.coalesce("component", "nid"))
    least = near.groupBy("component").agg(F.min("least").alias("component_id"))
    counts = found.groupBy("nid").agg(F.sum("n").alias("n"))
    near = near.join(least, "component").join(counts, "nid", "left")
    near = near.select("h0", "h1", "component_id", (F.coalesce("n", F.lit(0)) + F.col("n_rows") - 1).alias("n_links"))
    out = rows.select("vec_id", "h0", "h1").join(near, ["h0", "h1"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def query(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)


ORACLE_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id WHERE r.root < l.b),
m AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
n AS (SELECT a AS id, count(*) AS n_links FROM l GROUP BY a)
SELECT m.id AS vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, m.component_id, m.id = m.component_id AS kept FROM m LEFT JOIN n USING (id)
"""
