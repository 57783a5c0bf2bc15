"""Sharding by histogram sort. DataFrame functions only.

The sort key of a row is the pair (hash of the text, hash of the id), so equal texts
lie side by side. Splitters between shards are found without sorting: each round
counts the exact bytes of all rows below candidate boundaries, taken on a grid over the
key ranges still open (4,096 boundaries a range), then narrows every splitter to the
grid cell that holds its target. A splitter is settled once a boundary lies within
the tolerance of its target, or once no finer boundary exists. Equal texts are
cut apart only where their bytes together exceed the tolerance; then the rounds go on over
the id hash. When all splitters stand, rows are exchanged once, by shard and a cell
of the key, and numbered inside the cells on top of the exact row counts of the
cells before.

Cells for numbering hold about CELL_BYTES each, or a 256th of small inputs, so their number grows with
the input. A text so frequent that its cell is much larger is cut further by the id hash; rows that
repeat text and id so often that this doesn't help get a random salt, written beside them first.

Only one row per splitter and round comes to the driver, whatever the input size.

Law ``bytes``: the shards' sizes (bytes of text plus one a row) are near equal, as near as
whole rows allow within ``tolerance`` of a mean shard. Defined cases: a null text has size 1
and the crc32 of the empty text; a null doc_id is hashed like any value; repeated rows have
equal keys and share a shard; an empty table gives an empty result; other columns pass through,
whatever they are called (``size``, ``shard`` and ``slot`` are replaced).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, unused

GRID_BITS, WIDTH = 12, 63
#: Bytes of text in a numbering cell, and how many times as much makes a cell too large.
CELL_BYTES, TOO_LARGE = 64 << 20, 4
#: So many cells are broadcast (20 bytes each); more are joined by a shuffle.
BROADCAST_CELLS = 1_000_000


@dataclass
class _Splitter:
    target: int
    k1: int = 0  # the open range starts at this key
    k2: int = 0
    below: int = 0  # exact bytes below it


def keys_of(doc_id: Column, text: Column) -> tuple[Column, Column, Column]:
    """Non-negative 63-bit hashes of text and id, and the bytes of the text plus one."""
    top = F.lit(2**63 - 1)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    return F.xxhash64(text).bitwiseAND(top), F.xxhash64(doc_id, F.lit(7)).bitwiseAND(top), size


def find_splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """The shards-1 keys (k1, k2) at which a new shard begins, ascending. ``keys``: k1, k2, size."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    splitters = [_Splitter(total * i // shards) for i in range(1, shards)]
    if not total:
        return [(0, 0)] * len(splitters)
    open_, bits, slack = list(range(len(splitters))), 0, tolerance * total / shards
    while open_:
        second = bits >= WIDTH
        done = bits % WIDTH
        step = min(GRID_BITS, WIDTH - done)
        shift = WIDTH - done - step
        bits += step
        still = []
        for i, cell, held, n, run in _crossings(keys, [(k, splitters[k]) for k in open_], second, done, shift):
            s = splitters[i]
            at, size = cell << shift, 1 << shift
            before, after = s.target - (s.below + run - held), s.below + run - s.target
            s.below += run - held
            s.k1, s.k2 = (s.k1, at) if second else (at, 0)
            if min(before, after) > slack and n > 1 and bits < 2 * WIDTH:
                still.append(i)
            elif after < before:  # the boundary after the cell is nearer
                s.below += held
                s.k1, s.k2 = ((s.k1, at + size) if at + size < 1 << WIDTH else (s.k1 + 1, 0)) if second else (at + size, 0)
        open_ = still
    out: list[tuple[int, int]] = []
    for s in splitters:
        out.append(max([(s.k1, s.k2), *out[-1:]]))
    return out


def _crossings(keys: DataFrame, open_: list[tuple[int, _Splitter]], second: bool, done: int, shift: int) -> list[tuple[int, int, int, int, int]]:
    """For each open splitter the grid cell in which its target is reached: (splitter, cell, bytes, rows, bytes up to its end within the range)."""
    spark = keys.sparkSession
    ranges = sorted({(s.k1, s.k2) for _, s in open_})
    prefix = lambda key: (key[second]) >> (WIDTH - done)
    low = _values(spark, "part int, p1 long, prefix long", [(n, key[0], prefix(key)) for n, key in enumerate(ranges)])
    column = F.col("k2" if second else "k1")
    met = F.shiftright(column, WIDTH - done) == F.col("prefix")
    met = met & (F.col("k1") == F.col("p1")) if second else met
    cells = keys.join(F.broadcast(low), met).groupBy("part", F.shiftright(column, shift).alias("cell")).agg(F.sum("size").alias("held"), F.count("*").alias("n"))
    cells = cells.withColumn("run", F.sum("held").over(Window.partitionBy("part").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)))
    wanted = _values(spark, "i int, part int, need long", [(i, ranges.index((s.k1, s.k2)), s.target - s.below) for i, s in open_])
    first = F.min(F.struct("cell", "held", "n", "run")).alias("c")
    rows = cells.join(F.broadcast(wanted), "part").where("run >= need").groupBy("i").agg(first).select("i", "c.*").collect()
    return sorted(tuple(r) for r in rows)


def _values(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small table out of numbers of the driver."""
    names, kinds = zip(*[c.split() for c in schema.split(", ")], strict=True)
    rows_sql = ", ".join("(" + ", ".join(f"CAST({v} AS {kind})" for v, kind in zip(r, kinds, strict=True)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {rows_sql} AS t({', '.join(names)})")


def shard_of(k1: Column, k2: Column, splitters: list[tuple[int, int]]) -> Column:
    """The number of splitters at or below a key."""
    own = F.lit(0)
    for s1, s2 in splitters:
        if s1 < 1 << WIDTH:
            own = own + ((k1 > F.lit(s1)) | ((k1 == F.lit(s1)) & (k2 >= F.lit(s2)))).cast("int")
    return own


def shard(docs: DataFrame, shards: int = 16, tolerance: float = 0.001) -> DataFrame:
    """All columns of ``docs`` with ``size``, ``shard`` and the gapless ``slot`` (columns of these
    names in the input are replaced). The keys are kept as a small table, so that the
    rounds don't read or hash the texts again."""
    docs = docs.drop("size", "shard", "slot")
    k1, k2, size = keys_of(F.col("doc_id"), F.col("text"))
    keys = cut(docs.select(k1.alias("k1"), k2.alias("k2"), size.alias("size")), "shard-keys")
    splitters = find_splitters(keys, shards, tolerance)
    total = keys.agg(F.sum("size")).first()[0] or 1
    unit = min(CELL_BYTES, max(total // 256, 1))
    bits = math.ceil(math.log2(max(total / unit, 1)))
    cell = F.shiftright("k1", WIDTH - bits).cast("int") if bits else F.lit(0)
    keys = keys.select("*", shard_of(F.col("k1"), F.col("k2"), splitters).alias("shard"), cell.alias("cell"))
    cells = cut(keys.groupBy("shard", "cell").agg(F.count("*").alias("n"), F.sum("size").alias("held")), "shard-cells")
    large = cells.where(F.col("held") > TOO_LARGE * unit).select("shard", "cell", F.ceil(F.log2(F.col("held") / unit)).cast("int").alias("deep"))
    parts = cells.select("shard", "cell", F.lit(0).cast("long").alias("sub"), "n")
    some = large.limit(1).count() > 0
    salts = 1
    sub_of = lambda second: F.when(F.col("deep").isNull(), 0).otherwise(F.call_function("shiftright", second, WIDTH - F.col("deep"))).cast("long")
    if some:  # cells of frequent texts are cut by the id hash
        joined = keys.join(_side(large), ["shard", "cell"], "left").withColumn("sub", sub_of(F.col("k2")))
        sized = cut(joined.groupBy("shard", "cell", "sub").agg(F.count("*").alias("n"), F.sum("size").alias("held")), "shard-parts")
        worst = sized.agg(F.max("held")).first()[0]
        salts = math.ceil(worst / unit) if worst > TOO_LARGE * TOO_LARGE * unit else 1
        parts = sized.select("shard", "cell", "sub", "n")

    m1, m2, m_size, m_shard, m_cell, m_sub, m_salt, m_at, m_tie, m_deep, m_before = unused(
        [*docs.columns, "size", "shard", "slot"], "_k1", "_k2", "_size", "_shard", "_cell", "_sub", "_salt", "_at", "_tie", "_deep", "_before"
    )
    k1, k2, size = keys_of(F.col("doc_id"), F.col("text"))
    rest = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind and "variant" not in kind]
    placed = docs.withColumns({m1: k1, m2: k2, m_size: size, m_tie: F.xxhash64(*rest) if rest else F.lit(0), m_salt: F.floor(F.rand(7) * salts).cast("int") if salts > 1 else F.lit(0)})
    placed = placed.withColumns({m_shard: shard_of(F.col(m1), F.col(m2), splitters), m_cell: F.shiftright(F.col(m1), WIDTH - bits).cast("int") if bits else F.lit(0)})
    if some:
        deep = large.select(F.col("shard").alias(m_shard), F.col("cell").alias(m_cell), F.col("deep").alias(m_deep))
        placed = placed.join(_side(deep), [m_shard, m_cell], "left")
        placed = placed.withColumn(m_sub, F.when(F.col(m_deep).isNull(), 0).otherwise(F.call_function("shiftright", F.col(m2), WIDTH - F.col(m_deep))).cast("long"))
    else:
        placed = placed.withColumn(m_sub, F.lit(0).cast("long"))
    by = [m_shard, m_cell, m_sub, m_salt]
    if salts > 1:  # the salt must be the same when rows are counted and numbered
        placed = cut(placed, "salted")
        parts = placed.groupBy(*[F.col(c).alias(n) for c, n in zip(by, ("shard", "cell", "sub", "salt"), strict=True)]).agg(F.count("*").alias("n"))
    else:
        parts = parts.withColumn("salt", F.lit(0))
    earlier = Window.partitionBy("shard").orderBy("cell", "sub", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*[F.col(n).alias(c) for c, n in zip(by, ("shard", "cell", "sub", "salt"), strict=True)], F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(m_before))
    within = Window.partitionBy(*by).orderBy(m1, m2, m_tie)
    numbered = placed.withColumn(m_at, F.row_number().over(within))
    out = numbered.join(_side(offsets), by)
    return out.select(*docs.columns, F.col(m_size).alias("size"), F.col(m_shard).alias("shard"), (F.col(m_before) + F.col(m_at) - 1).cast("long").alias("slot"))


def _side(few: DataFrame) -> DataFrame:
    """A table of cells: broadcast if it is small."""
    return F.broadcast(few) if few.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS else few


def query(docs: DataFrame) -> DataFrame:
    slim = docs.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    return shard(slim).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
