"""Operators over the graphs of many files at once: ids are made unique by their path, so one search serves all files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.queries import Direction, Endpoint, Path, ends, highlight_queries, resolved, root_queries
from ..plans.lineage import settled
from ..sources import code
from . import prune, reach

#: node kinds that a bare name doesn't select: they are uses, not declarations
USES = ("WriteReference", "ReturnArgumentReference", "ThrowArgumentReference")


def key(id: Column) -> Column:
    return F.concat_ws("\n", "path", id)


def keyed_nodes(graph: DataFrame) -> DataFrame:
    """path, node (the id within the file), id (unique), kind, name, line, end_line"""
    return code.graph_rows(graph, "nodes").select("path", F.col("id").alias("node"), key(F.col("id")).alias("id"), "kind", "name", "line", "end_line")


def keyed_edges(graph: DataFrame) -> DataFrame:
    rows = code.graph_rows(graph, "edges")
    return rows.select(key(F.col("src")).alias("src"), key(F.col("dst")).alias("dst"), "label", "ord")


def selected(query: Endpoint) -> Column:
    bare = query.name is not None and query.low is None
    return query.matches() & ~F.col("kind").isin(*USES) if bare else query.matches()


def roots(nodes: DataFrame, text: str) -> DataFrame:
    """The nodes of every file that a root query selects."""
    own = F.lit(False)
    queries = root_queries(text)
    nodes = with_names(nodes, queries)
    for query in queries:
        own = own | taken(query, selected)
    return nodes.where(own).select("id")


def with_names(nodes: DataFrame, queries: list[Endpoint]) -> DataFrame:
    """The nodes with a column for each ambiguous name: whether a node of their file has it."""
    for query in {q.name: q for q in queries if q.ambiguous}.values():
        having = nodes.where(F.col("name") == query.name).select("path").distinct().withColumn(f"has_{query.name}", F.lit(True))
        nodes = nodes.join(having.hint("merge"), "path", "left")
    return nodes


def taken(query: Endpoint, to: Callable[[Endpoint], Column]) -> Column:
    """The predicate ``to`` of a query over ``with_names``: an ambiguous one is a name in the files that have it, else a line."""
    if not query.ambiguous:
        return to(query)
    return F.when(F.col(f"has_{query.name}").isNotNull(), to(resolved(query, True))).otherwise(to(resolved(query, False)))


def highlighted(nodes: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    """(id, point) of the nodes of every file that highlight queries mark; all edges of a point are marked, of the others
    those between two. Paths and directions are searched in all files at once."""
    queries = [q for _, q in highlight_queries(text)]
    nodes = settled(with_names(nodes, [e for q in queries for e in ends(q)]))
    steps = reach.pairs(edges)
    pick = lambda e: nodes.where(taken(e, Endpoint.matches)).select("id")
    out = nodes.select("id", F.lit(False).alias("point")).limit(0)
    for q in queries:
        if isinstance(q, Path):
            out = out.union(reach.between(pick(q.left), pick(q.right), edges).withColumn("point", F.lit(False)))
        elif isinstance(q, Direction):
            for forward in ([True] if q.way in "ac" else []) + ([False] if q.way in "bc" else []):
                out = out.union(reach.search(pick(q.start), steps, None, forward).select("id", F.lit(False)))
        else:
            out = out.union(pick(q).withColumn("point", F.lit(True)))
    return out.groupBy("id").agg(F.max("point").alias("point"))


def marked_edges(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """The edges of points, and those between two nodes of ``highlighted``, by merge joins as in ``with_degrees``."""
    for end in ("src", "dst"):
        edges = edges.join(marks.select(F.col("id").alias(end), F.col("point").alias(f"_{end}")).hint("merge"), end, "left")
    return edges.where("_src OR _dst OR (_src IS NOT NULL AND _dst IS NOT NULL)").drop("_src", "_dst")


def pruned(nodes: DataFrame, edges: DataFrame, text: str, descendants: int, ancestors: int) -> DataFrame:
    """The nodes near the roots. Give tables that are written or cached: each step of the search reads the edges."""
    return nodes.join(prune.kept_ids(roots(nodes, text), edges, descendants, ancestors), "id", "left_semi")


def degrees(graph: DataFrame) -> DataFrame:
    """(path, id, out_degree, in_degree) of every end of an edge: one count over both ends."""
    ends = code.graph_rows(graph, "edges").select("path", F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("path", "e.id").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def with_degrees(rows: DataFrame, graph: DataFrame) -> DataFrame:
    """``rows`` (path, id and others) with the degrees of their nodes, 0 without an edge. A merge join: Spark's estimate counts
    one element for an array of any length, so that it would broadcast the degrees of millions of nodes."""
    return rows.join(degrees(graph).hint("merge"), ["path", "id"], "left").fillna(0, ["out_degree", "in_degree"])


def stats(graph: DataFrame) -> DataFrame:
    """(path, line, label, out_degree, in_degree) of every node. Give graphs that are written or cached: they are read twice."""
    rows = with_degrees(code.graph_rows(graph, "nodes"), graph)
    label = F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.when(F.col("unused"), " unused ").otherwise(" "), F.col("name"))
    return rows.select("path", "line", label.alias("label"), "out_degree", "in_degree")
