"""Connected components of a link table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component): for every id in ``links`` (a, b), the smallest id reachable.

    Alternates large-star (every larger neighbour is hung on the smallest one) and small-star
    (every smaller one likewise) until nothing changes: a logarithmic number of rounds. A
    hub's links are only reduced to a minimum and joined, never collected.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    edges, state = _kept(edges, name)
    while True:
        both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).withColumn("m", F.least("m", "v"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.where("v <> u").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(least, "v")
        small = joined.select("v", F.col("m").alias("u")).union(joined.select(F.col("u").alias("v"), F.col("m").alias("u")))
        after, new = _kept(small.where("v <> u").distinct(), name)
        drop_cut(edges)
        edges = after
        if new == state:
            break
        state = new
    roots = edges.select(F.col("u").alias("id")).distinct()
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component")).union(roots.select("id", F.col("id").alias("component")))


def _kept(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number and hash sum: equal only if nothing has changed."""
    edges = cut(edges, name)
    return edges, tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
