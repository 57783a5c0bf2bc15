r"""MinHash near-duplicates by an LSH forest, confirmed on full shingle sets.

Words are ``[^\x20\x09-\x0D]+`` after lower-casing A-Z; a document's set is its distinct five-word
shingles (with fewer words, the whole sequence; without words, empty and linked with nothing).
Documents are linked where 100 * |intersection| >= 85 * |union|.

1. One pass over the texts gives each document its number of shingles, a digest of its set, and a
   signature of 128 minima. Equal sets become one node, named by its smallest id.
2. The forest: 32 orders of the signature, each sorted on another run of coordinates first. Nodes
   that share the first four coordinates of an order form a region (a pair at 0.85 shares at least
   one of the 32 with probability 1 - 5e-11). Regions of one node are dropped.
3. Each order is sorted, hot regions over many tasks, and read in blocks of neighbours. A node proposes its
   longest-common-prefix neighbours and the best match of its block. Proposals are confirmed on full sets,
   and components are formed.
4. The rest: in each region of up to REGION nodes that still holds several components, all pairs of nodes of
   different components are compared by signature, block against block; those that may reach the threshold are
   confirmed on full sets in place. Only links that join components come out, and no group's pairs are listed.
5. Larger regions with several components are first joined through hubs: the nodes nearest to the region's most
   frequent coordinates, which star-shaped families share. Where several components are left, the region is
   deepened: its nodes are sorted into more orders by longer prefixes (DEEPER), until regions are bounded and
   step 4 takes them. What is still larger at the last depth is compared block against block as well.

A pair at 0.85 that only meets in larger regions is missed at a depth of 8, 12 and 16 coordinates with odds of about
1e-7, 1e-6 and 1e-5; only pairs whose components are not joined otherwise depend on that.

Signature estimates only rule out pairs more than 4.5 standard deviations below the threshold.
Defined cases: a row without an id keeps n_shingles, has no component and is kept; repeated rows
are one node; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, in_blocks, in_groups
from .graph import components

SHINGLE, PERCENT = 5, 85
HASHES, ORDERS = 128, 32
#: Pairs whose estimate is below this can't reach 0.85 but with odds under 1e-5.
MAYBE = 0.70
#: Nodes of a block of neighbours, of a block that is compared with others, and of a region whose blocks are all compared (so each
#: node is sent at most REGION / PAIR_BLOCK times for a region).
BLOCK, PAIR_BLOCK, REGION = 256, 512, 8192
#: For larger regions: coordinates of the prefix, and orders, each by another choice of coordinates.
DEEPER = ((8, 96), (12, 256), (16, 512))
#: So many ids are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: So many hubs (300 bytes each) are broadcast.
BROADCAST_HUBS = 50_000
WORD_CACHE = 300_000

_rng = np.random.default_rng(20240611)
MULTIPLIERS = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
PRIME = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hash of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=n)
    k = min(n, SHINGLE)
    acc = h[: n - k + 1] + np.uint64(k)
    for i in range(1, k):
        acc = acc * PRIME + h[i : n - k + 1 + i]
    acc ^= acc >> np.uint64(31)
    acc *= np.uint64(0xBF58476D1CE4E5B9)
    acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def signature(hashes: np.ndarray) -> np.ndarray:
    """128 minima, 16 bits of each."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(x), 256):
        np.minimum(least, (x[a : a + 256, None] * MULTIPLIERS).min(0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on two sorted sets."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= PERCENT * (len(both) - same)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, sig): digest of the set, its size, and the signature as 32 longs."""

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in it:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                keys, ns, sigs = [], [], []
                for text in part.column(1).to_pylist():
                    s = shingles(text)
                    ns.append(len(s))
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sigs.append(signature(s).view(np.int64) if len(s) else None)
                yield pa.record_batch(
                    [part.column(0), pa.array(keys, pa.binary()), pa.array(ns, pa.int64()), pa.array(sigs, pa.list_(pa.int64()))], ["doc_id", "key", "n", "sig"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(make, "doc_id long, key binary, n long, sig array<long>")


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, key, hs): the full sets of the documents named in ``ids`` (rep)."""

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in it:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.record_batch([part.column(0), pa.array(keys, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "key", "hs"])

    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    picked = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(F.broadcast(ids) if few else ids, "rep", "left_semi")
    return picked.mapInArrow(make, "rep long, key binary, hs binary")


def _matrix(t: pa.Table) -> np.ndarray:
    flat = t.column("sig").chunk(0).flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat).view(np.uint16).reshape(t.num_rows, HASHES)


def _estimates(s: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Agreement of the signatures ``s[rows]`` with all of ``s``."""
    out = np.empty((len(rows), len(s)), dtype=np.float32)
    for a in range(0, len(rows), 64):
        out[a : a + 64] = (s[rows[a : a + 64], None, :] == s[None, :, :]).mean(2, dtype=np.float32)
    return out


def _size_ok(n: np.ndarray, rows: np.ndarray) -> np.ndarray:
    a, b = n[rows, None], n[None, :]
    return 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)


def propose(t: pa.Table) -> pa.Table | None:
    """For each node of a block of neighbours in an order: the neighbour after it and its best match."""
    m = t.num_rows
    s, rep, n = _matrix(t), t.column("rep").to_numpy(), t.column("n").to_numpy()
    est = np.where(_size_ok(n, np.arange(m)), _estimates(s, np.arange(m)), 0)
    np.fill_diagonal(est, 0)
    a = np.concatenate((np.arange(m - 1), np.arange(m)))
    b = np.concatenate((np.arange(1, m), est.argmax(1)))
    ok = est[a, b] >= MAYBE
    a, b = rep[a[ok]], rep[b[ok]]
    pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
    return pa.table({"a": pairs[0], "b": pairs[1]})


def hub(t: pa.Table) -> pa.Table:
    """The node of a part of a region that agrees most with the most frequent value of each coordinate."""
    s, rep = _matrix(t), t.column("rep").to_numpy()
    mode = np.array([np.bincount(c).argmax() for c in s.T], dtype=np.uint16)
    agree = (s == mode).sum(1)
    best = int(np.lexsort((rep, -agree))[0])
    return t.slice(best, 1).select(["ord", "k", "rep", "n", "comp", "sig"]).append_column("agree", pa.array([int(agree[best])], pa.int64()))


def deepened(level: int) -> list[np.ndarray]:
    """For each order of a level the coordinates of its prefix."""
    depth, orders = DEEPER[level]
    rng = np.random.default_rng(77 + level)
    return [rng.permutation(HASHES)[:depth] for _ in range(orders)]


def prefixes(nodes: DataFrame, level: int) -> DataFrame:
    """(rep, ord, k): the prefixes of nodes (rep, sig) in the orders of a level."""

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = deepened(level)
        rng = np.random.default_rng(5)
        odd = rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in it:
            for a in range(0, batch.num_rows, 1024):
                part = pa.Table.from_batches([batch.slice(a, 1024)]).combine_chunks()
                s, m = _matrix(part).astype(np.uint64) + np.uint64(1), part.num_rows
                ks = []
                for own in orders:
                    h = (s[:, own] * odd[: len(own)]).sum(1, dtype=np.uint64) * PRIME
                    ks.append((h ^ (h >> np.uint64(29))).view(np.int64))
                rep = np.tile(part.column("rep").to_numpy(), len(orders))
                yield pa.record_batch([pa.array(rep), pa.array(np.repeat(np.arange(len(orders), dtype=np.int32), m)), pa.array(np.concatenate(ks))], ["rep", "ord", "k"])

    return nodes.select("rep", "sig").mapInArrow(make, "rep long, ord int, k long")


def _crossing(t: pa.Table, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of two blocks' nodes in different components that may be linked and, with ``first``, meet in this order first; by falling estimate."""
    s, n, comp, block = _matrix(t), t.column("n").to_numpy(), t.column("comp").to_numpy(), t.column("block").to_numpy()
    order = int(t.column("ord")[0].as_py())
    low, high = int(t.column("bi")[0].as_py()), int(t.column("bj")[0].as_py())
    keys = s.view(np.int64)
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    if not len(left) or not len(right):
        return (np.zeros(0, int),) * 3
    out = []
    for x in range(0, len(left), 64):
        rows = left[x : x + 64]
        est = (s[rows, None, :] == s[None, right, :]).mean(2, dtype=np.float32)
        a, b = n[rows, None], n[None, right]
        may = (est >= MAYBE) & (comp[rows, None] != comp[None, right]) & (100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b))
        if low == high:
            may &= rows[:, None] < right[None, :]
        i, j = np.nonzero(may)
        if first and order and len(i):
            met = np.zeros(len(i), dtype=bool)
            for o in range(order):
                met |= keys[rows[i], o] == keys[right[j], o]
            i, j = i[~met], j[~met]
        out.append((rows[i], right[j], est[i, j]))
    i, j, e = (np.concatenate(x) for x in zip(*out, strict=True))
    by = np.argsort(-e, kind="stable")
    return i[by], j[by], e[by]


def involved(t: pa.Table, first: bool) -> pa.Table | None:
    """The nodes of a block pair that have a pair to be confirmed."""
    i, j, _ = _crossing(t, first)
    if not len(i):
        return None
    return t.take(pa.array(np.unique(np.concatenate((i, j))))).select(["rep", "ord", "k", "bi", "bj"])


def confirm(t: pa.Table, first: bool) -> pa.Table | None:
    """Links between components, confirmed on full sets; pairs already joined inside the block are passed over."""
    i, j, _ = _crossing(t, first)
    if not len(i):
        return None
    sets = [np.frombuffer(x, dtype=np.uint64) for x in t.column("hs").to_pylist()]
    rep, comp = t.column("rep").to_numpy(), t.column("comp").to_numpy()
    root = {c: c for c in comp.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(int(comp[x])), find(int(comp[y]))
        if a != b and linked(sets[x], sets[y]):
            root[max(a, b)] = min(a, b)
            out.append((int(rep[x]), int(rep[y])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())}) if out else None


def confirmed_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those that are links."""

    def test(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x, y = batch.column("ha").to_pylist(), batch.column("hb").to_pylist()
            ok = [linked(np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    ha = sets.select(F.col("rep").alias("a"), F.col("hs").alias("ha"))
    hb = sets.select(F.col("rep").alias("b"), F.col("hs").alias("hb"))
    return pairs.join(ha, "a").join(hb, "b").mapInArrow(test, "a long, b long")


def several(tagged: DataFrame) -> DataFrame:
    """Of regions (ord, k, rep, comp), those with more than one component, and their number of nodes."""
    return tagged.groupBy("ord", "k").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("ord", "k", "m")


def crossing_links(rows: DataFrame, nodes: DataFrame, sets: DataFrame, first: bool) -> DataFrame:
    """Links between components, by block pairs. ``rows``: ord, k, bi, bj, block, rep, comp."""
    where = ["ord", "k", "bi", "bj"]
    rows = rows.join(nodes.select("rep", "n", "sig"), "rep").select(*where, "block", "rep", "n", "comp", "sig")
    rows = cut(rows, "rest")
    open_ = cut(in_groups(rows, where, lambda t: involved(t, first), "rep long, ord int, k long, bi int, bj int"), "involved")
    last = rows.join(open_, ["rep", *where]).join(sets, "rep")
    found = cut(in_groups(last, where, lambda t: confirm(t, first), "a long, b long").distinct(), "links-2")
    drop_cut(rows)
    return found


def block_pairs(rows: DataFrame) -> DataFrame:
    """Rows of regions (ord, k, m, rep, comp), once for each pair of blocks that they belong to."""
    blocks = F.ceil(F.col("m") / PAIR_BLOCK).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep", "ord"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")})


def hub_links(dense: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of the nodes of large regions (ord, k, m, rep, comp) with their region's hub, where that joins components."""
    described = cut(dense.join(nodes.select("rep", "n", "sig"), "rep"), "dense")
    parts = F.pmod(F.xxhash64("rep", "ord"), F.ceil(F.col("m") / BLOCK).cast("int")).cast("int")
    found = in_groups(described.withColumn("part", parts), ["ord", "k", "part"], hub, "ord int, k long, rep long, n long, comp long, sig array<long>, agree long")
    best = F.max(F.struct("agree", (-F.col("rep")).alias("r"), F.col("rep").alias("hub"), F.col("n").alias("hub_n"), F.col("comp").alias("hub_comp"), F.col("sig").alias("hub_sig")))
    hubs = cut(found.groupBy("ord", "k").agg(best.alias("h")).select("ord", "k", "h.hub", "h.hub_n", "h.hub_comp", "h.hub_sig"), "hubs")
    few = hubs.limit(BROADCAST_HUBS + 1).count() <= BROADCAST_HUBS
    met = described.join(F.broadcast(hubs) if few else hubs, ["ord", "k"]).where("comp <> hub_comp AND 100 * least(n, hub_n) >= 85 * greatest(n, hub_n)")

    def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            a, b = (np.ascontiguousarray(batch.column(c).flatten().to_numpy()).view(np.uint16).reshape(-1, HASHES) for c in ("sig", "hub_sig"))
            ok = (a == b).mean(1) >= MAYBE
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("hub")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = met.select("rep", "hub", "sig", "hub_sig").mapInArrow(near, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return cut(confirmed_pairs(pairs, sets), "hub-links")


def deep_links(reps: DataFrame, nodes: DataFrame, comp: DataFrame, sets: DataFrame) -> list[DataFrame]:
    """Links between components among the nodes of large regions: their orders are deepened until regions are bounded."""
    out: list[DataFrame] = []
    for level in range(len(DEEPER)):
        own = cut(nodes.join(reps, "rep", "left_semi").select("rep", "sig"), "deepened")
        rows = prefixes(own, level).join(comp, "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
        rows = cut(rows, "prefixes")
        regions = cut(several(rows), "deep-regions")
        small = rows.join(regions.where(F.col("m") <= REGION), ["ord", "k"])
        out.append(crossing_links(block_pairs(small), nodes, sets, False))
        large = rows.join(regions.where(F.col("m") > REGION), ["ord", "k"])
        reps = cut(large.select("rep").distinct(), "dense-reps")
        if reps.isEmpty():
            break
        if level == len(DEEPER) - 1:  # nodes alike in all these coordinates, and still apart
            out.append(crossing_links(block_pairs(large), nodes, sets, False))
        drop_cut(rows)
    return out


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per document."""
    prints = cut(fingerprints(docs), "fingerprints")
    named = prints.where("key IS NOT NULL AND doc_id IS NOT NULL")
    nodes = cut(named.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "nodes")
    forest = nodes.select("rep", F.posexplode("sig").alias("ord", "k"))
    shared = forest.groupBy("ord", "k").agg(F.count("*").alias("m")).where("m > 1")
    members = cut(forest.join(shared, ["ord", "k"]), "members")

    ids = members.select("rep").distinct()
    sets = full_sets(docs, ids).join(nodes.select("rep", "key").withColumnRenamed("key", "own"), "rep").where("key = own").select("rep", "hs")
    sets = cut(sets, "sets")
    along = [F.element_at("sig", (F.col("ord") + i) % 32 + 1).alias(f"k{i}") for i in (1, 2, 3)]
    described = members.join(nodes.select("rep", "n", "sig"), "rep").select("ord", "k", *along, "rep", "n", "sig")
    pairs = in_blocks(described, ["ord", "k"], ["k1", "k2", "k3", "rep"], BLOCK, propose, "a long, b long").distinct()
    links = cut(confirmed_pairs(pairs, sets), "links")

    comp = cut(components(links).withColumnRenamed("id", "rep"), "components-1")
    with_comp = lambda: members.join(comp, "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component", "m")
    tagged = cut(with_comp(), "tagged")
    regions = cut(several(tagged), "regions")
    dense = tagged.join(regions.where(F.col("m") > REGION), ["ord", "k"])
    if not regions.where(F.col("m") > REGION).isEmpty():
        links = cut(links.union(hub_links(dense, nodes, sets)), "links")
        comp = cut(components(links).withColumnRenamed("id", "rep"), "components-hubs")
        tagged = cut(with_comp(), "tagged")
        regions = cut(several(tagged), "regions")
        dense = tagged.join(regions.where(F.col("m") > REGION), ["ord", "k"])
    small = tagged.join(regions.where(F.col("m") <= REGION), ["ord", "k"])
    more = [crossing_links(block_pairs(small), nodes, sets, True)]
    if not regions.where(F.col("m") > REGION).isEmpty():
        more += deep_links(cut(dense.select("rep").distinct(), "dense-reps"), nodes, comp, sets)
    for found in more:
        links = links.union(found)

    joined = cut(components(links), "components-2")
    owner = nodes.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select(F.col("key").alias("_key"), F.coalesce("component", "rep").alias("component"))
    out = prints.join(owner, F.col("key") == F.col("_key"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def query(docs: DataFrame) -> DataFrame:
    return groups(docs.select("doc_id", "text"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, all columns kept; rows that repeat a kept id go as well."""
    found = cut(groups(docs.select("doc_id", "text")), "groups")
    out = docs.join(found.where("NOT kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    n, ids = found.where("doc_id IS NOT NULL").agg(F.count("*"), F.count_distinct("doc_id")).first()
    return out if n == ids else out.where("doc_id IS NULL").unionByName(out.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS sh FROM w WHERE len(ws) > 0
), e AS (SELECT doc_id, unnest(sh) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT c.a, c.b FROM c JOIN s p ON p.doc_id = c.a JOIN s q ON q.doc_id = c.b WHERE 100 * i >= 85 * (len(p.sh) + len(q.sh) - i)),
r AS (SELECT doc_id AS id, doc_id AS root FROM w UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id WHERE r.root < l.b),
m AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT w.doc_id, coalesce(len(s.sh), 0)::BIGINT AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept
FROM w LEFT JOIN s USING (doc_id) JOIN m ON m.id = w.doc_id
"""
