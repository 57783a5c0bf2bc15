"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

Each source s gets the rate  rate_s = weight_s * budget / size_s  (how often its bytes
have to be repeated to fill its share of the budget). Each document draws its number of
copies from a Poisson distribution with that mean by inverting the distribution
function at a hash-seeded uniform number, is exploded by that count, and the copies
are dealt out globally by a hash. Sizes are summed exactly over all rows, with partial
sums before the exchange; a hot source is never gathered.

The inversion is a lookup: for each source the probabilities of the counts within ten standard deviations
(and 24) of the rate are laid out in closed form, so that no rate underflows, summed up, and cut into
CELLS equal cells of the uniform number. A document meets the one interval that holds its number. The table has
a few dozen rows a source and grows with the root of the rate; it is broadcast if it is small, and its size is checked.

Defined cases: a null source is a source of its own; a null or empty text counts one byte
(size is the bytes plus one); a null doc_id is drawn as the empty id, and repeated rows
draw the same count; an empty table gives an empty result; other columns pass through, whatever they are
called. ``copy``, ``rate``, ``n_copies`` and ``mix_key`` are the columns added; columns of these names
in the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, unused

#: An interval table up to this many rows (60 bytes each) is broadcast; beyond it, the join is shuffled by source and cell.
BROADCAST_INTERVALS = 1_000_000
CELLS = 64
ADDED = ("copy", "rate", "n_copies", "mix_key")


def uniform(*parts: Column | str) -> Column:
    """52 hash bits of the joined parts as a number in (0, 1)."""
    text = F.concat_ws(":", *[F.coalesce(F.col(p).cast("string"), F.lit("")) if isinstance(p, str) else p for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def poisson(k: Column, rate: Column) -> Column:
    """The probability of ``k`` at a mean of ``rate``. Above 20, the deviance form with Stirling's series: both stay accurate at any rate."""
    x = k.cast("double")
    small = F.exp(x * F.log(rate) - rate - F.log(F.factorial(F.least(k, F.lit(20)).cast("int")).cast("double")))
    stirling = 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    deviance = rate - x - x * F.log1p((rate - x) / x)
    large = F.exp(-deviance - stirling) / F.sqrt(x * F.lit(6.283185307179586))
    return F.when(k == 0, F.exp(-rate)).when(k <= 20, small).otherwise(large)


def intervals(rates: DataFrame) -> DataFrame:
    """(source, cell, low, high, k, rate): a uniform number u of a cell with low < u <= high draws k."""
    reach = 10 * F.sqrt("rate") + 24
    counts = F.sequence(F.greatest(F.floor(F.col("rate") - reach), F.lit(0)).cast("long"), F.ceil(F.col("rate") + reach).cast("long"))
    p = rates.where("rate > 0").select("source", "rate", F.explode(counts).alias("k")).withColumn("p", poisson(F.col("k"), F.col("rate")))
    own = Window.partitionBy("source")
    upto = own.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumns({"high": F.sum("p").over(upto), "last": F.max("k").over(own)})
    p = p.withColumn("low", F.lag("high", 1, 0.0).over(own.orderBy("k"))).withColumn("high", F.when(F.col("k") == F.col("last"), 1.0).otherwise(F.least("high", F.lit(1.0))))
    cells = F.sequence(F.floor(F.col("low") * CELLS).cast("int"), F.floor(F.least(F.col("high") * CELLS, F.lit(CELLS - 1.0))).cast("int"))
    return p.where("low < high").select("source", F.explode(cells).alias("cell"), "low", "high", "k", "rate")


def source_rates(docs: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, rate) of all sources. ``weights``: (source, weight), summing to anything;
    without it the weight of a source is its size to the power ``alpha``."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    sizes = docs.groupBy("source").agg(F.sum(size).alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(alpha)))
    else:
        w = weights.groupBy(F.col("source").alias("named")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        sizes = sizes.join(w, F.col("source").eqNullSafe(F.col("named")), "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    sizes = cut(sizes.select("source", "size", "weight"), "source-sizes")
    budget, weight = sizes.agg(F.sum("size"), F.sum("weight")).first()
    rate = F.col("weight") / F.lit(float(weight)) * F.lit(float(budget)) * F.lit(epochs) / F.col("size") if weight else F.lit(0.0)
    return sizes.select("source", rate.alias("rate"))


def mix_sources(
    docs: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: str = "mix", partitions: int | None = None
) -> DataFrame:
    """All columns of ``docs`` once per drawn copy, with ``copy`` (from 0), ``rate``, ``n_copies``
    and ``mix_key``, dealt out and sorted by the hash ``mix_key`` within partitions."""
    docs = docs.drop(*ADDED)
    m_u, m_cell, m_source, m_at, m_low, m_high, m_k, m_rate = unused([*docs.columns, *ADDED], "_u", "_cell", "_source", "_at", "_low", "_high", "_k", "_rate")
    rates = source_rates(docs, weights, alpha, epochs)
    table = cut(intervals(rates), "intervals")
    few = table.limit(BROADCAST_INTERVALS + 1).count() <= BROADCAST_INTERVALS
    table = table.select(*[F.col(a).alias(b) for a, b in zip(table.columns, (m_source, m_at, m_low, m_high, m_k, m_rate), strict=True)])
    drawn = docs.withColumn(m_u, uniform(F.lit(seed), "doc_id")).withColumn(m_cell, F.floor(F.col(m_u) * CELLS).cast("int"))
    own = F.col("source").eqNullSafe(F.col(m_source)) & (F.col(m_cell) == F.col(m_at)) & (F.col(m_u) > F.col(m_low)) & (F.col(m_u) <= F.col(m_high))
    drawn = drawn.join(F.broadcast(table) if few else table, own).where(F.col(m_k) > 0)
    copies = drawn.select(*docs.columns, F.col(m_rate).alias("rate"), F.col(m_k).cast("long").alias("n_copies"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(m_k) - 1)).alias("copy"))
    copies = copies.withColumn("mix_key", F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "copy")), 1, 16))
    deal = [partitions] if partitions else []
    return copies.repartition(*deal, "mix_key").sortWithinPartitions("mix_key")


def query(docs: DataFrame) -> DataFrame:
    return mix_sources(docs).select("doc_id", "source", "copy", "n_copies", F.round("rate", 6).alias("rate"), "mix_key", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("text_bytes"))


ORACLE_SQL = """
WITH sizes AS (
  SELECT source, sum(coalesce(strlen(text), 0) + 1)::BIGINT AS size FROM documents GROUP BY source
), weighted AS (
  SELECT source, size, pow(size::DOUBLE, 0.5) AS weight FROM sizes
), total AS (SELECT sum(size)::DOUBLE AS budget, sum(weight) AS weights FROM weighted),
rates AS (SELECT source, weight / weights * budget * 1.0 / size AS rate FROM weighted, total),
cdf AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS c
  FROM (SELECT source, k, CASE WHEN k = 0 THEN exp(-rate) ELSE exp(k * ln(rate) - rate - lgamma(k + 1)) END AS p
    FROM (SELECT source, rate, unnest(range(greatest(floor(rate - 12 * sqrt(rate) - 40), 0)::BIGINT, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT)) AS k FROM rates))
), lowest AS (SELECT source, min(k) AS k0 FROM cdf GROUP BY source),
drawn AS (
  SELECT d.doc_id, d.source, r.rate, l.k0, d.text, (('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source JOIN lowest l ON d.source IS NOT DISTINCT FROM l.source
), counted AS (
  SELECT d.doc_id, d.source, d.rate, d.text, d.k0 + count(c.k) AS n_copies
  FROM drawn d LEFT JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND c.c < d.u
  GROUP BY d.doc_id, d.source, d.rate, d.k0, d.text
), copies AS (
  SELECT *, unnest(range(0, n_copies)) AS copy FROM counted
)
SELECT doc_id, source, copy::BIGINT AS copy, n_copies::BIGINT AS n_copies, round(rate, 6) AS rate,
  substr(md5('mix-order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), 1, 16) AS mix_key,
  coalesce(strlen(text), 0)::BIGINT AS text_bytes
FROM copies
"""
