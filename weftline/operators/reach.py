"""Reachability over an edge table: level by level, with the visited nodes taken out before each step.

The edges are written once as pairs, so that no level reads or shuffles their source again. A frontier of up to
BROADCAST_IDS is broadcast, and only the ids that it finds are exchanged; a larger one is joined by a shuffle, asked for by a
hint: estimates of checkpoints over exploded arrays are far too small, and Spark would broadcast either side. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import settled

#: Radii beyond a signed 32-bit number act as 0.
MOST = 2**31 - 1
#: So many ids of a frontier, or of the visited nodes, are broadcast.
BROADCAST_IDS = 200_000


def pairs(edges: DataFrame) -> DataFrame:
    """The ends of the edges, written once for any number of searches."""
    return settled(edges.select("src", "dst"))


def bfs(seeds: DataFrame, edges: DataFrame, radius: int | None, forward: bool = True) -> DataFrame:
    """(id, depth): everything within ``radius`` steps of the seeds (id), seeds at 0; no bound if ``radius`` is None."""
    return search(seeds, pairs(edges), radius, forward)


def search(seeds: DataFrame, steps: DataFrame, radius: int | None, forward: bool = True) -> DataFrame:
    """``bfs`` over the pairs of ``pairs``."""
    if radius is not None and radius > MOST:
        radius = 0
    near, far = ("src", "dst") if forward else ("dst", "src")
    steps = steps.select(F.col(near).alias("id"), F.col(far).alias("next"))
    seen = frontier = settled(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    new = visited = frontier.count()
    depth = 0
    while new and (radius is None or depth < radius):
        depth += 1
        found = steps.join(_side(frontier.select("id"), new), "id").select(F.col("next").alias("id")).distinct()
        found = found.join(_side(seen.select("id"), visited), "id", "left_anti")
        frontier = settled(found.withColumn("depth", F.lit(depth)))
        new = frontier.count()
        visited += new
        seen = seen.unionByName(frontier)
    return seen


def _side(ids: DataFrame, n: int) -> DataFrame:
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids.hint("merge")


def between(left: DataFrame, right: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids on a path from left to right or from right to left."""
    steps = pairs(edges)
    reach = lambda seeds, forward: search(seeds, steps, None, forward).select("id")
    both = lambda start, end: reach(start, True).join(reach(end, False).hint("merge"), "id", "left_semi")
    return both(left, right).union(both(right, left)).distinct()


def closure(nodes: DataFrame) -> DataFrame:
    """(id, anc_id, distance) of a tree given by parent_id, self at 0; doubles the distance each round."""
    jumps = nodes.select("id", F.col("parent_id").alias("anc_id")).where("anc_id IS NOT NULL").withColumn("distance", F.lit(1))
    out = nodes.select("id", F.col("id").alias("anc_id"), F.lit(0).alias("distance"))
    span = jumps
    while True:
        reached = out.join(span.select(F.col("id").alias("anc_id"), F.col("anc_id").alias("top"), F.col("distance").alias("more")), "anc_id")
        out = settled(out.unionByName(reached.select("id", F.col("top").alias("anc_id"), (F.col("distance") + F.col("more")).alias("distance"))))
        span = settled(span.join(span.select(F.col("id").alias("anc_id"), F.col("anc_id").alias("top"), F.col("distance").alias("more")), "anc_id").select("id", F.col("top").alias("anc_id"), (F.col("distance") + F.col("more")).alias("distance")))
        if span.isEmpty():
            return out
