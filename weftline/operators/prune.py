"""Pruning a graph around root queries.

Descendants and ancestors are searched separately from the roots, and united. Boundary hints
are taken from edges that leave the kept nodes, before containers are added back; an ``out`` hint
has no label, the labels of ``in`` hints are split, united and sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reach import pairs, search


def kept_ids(roots: DataFrame, edges: DataFrame, descendants: int, ancestors: int) -> DataFrame:
    steps = pairs(edges)
    down, up = search(roots, steps, descendants), search(roots, steps, ancestors, forward=False)
    return down.select("id").union(up.select("id")).distinct()


def inner_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    return edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi")


def boundary(edges: DataFrame, kept: DataFrame, descendants: int, ancestors: int) -> DataFrame:
    """(inside, direction, label)"""
    src, dst = (kept.select(F.col("id").alias(c)) for c in ("src", "dst"))
    out = edges.join(src, "src", "left_semi").join(dst, "dst", "left_anti").select(F.col("src").alias("inside")).distinct()
    out = out.select("inside", F.lit("out").alias("direction"), F.lit(None).cast("string").alias("label"))
    into = edges.join(dst, "dst", "left_semi").join(src, "src", "left_anti").select(F.col("dst").alias("inside"), F.explode(F.split("label", ",")).alias("part"))
    into = into.distinct().groupBy("inside").agg(F.array_join(F.array_sort(F.collect_set("part")), ",").alias("label"))
    into = into.select("inside", F.lit("in").alias("direction"), "label")
    return out.where(F.lit(descendants > 0)).unionByName(into.where(F.lit(ancestors > 0)))
