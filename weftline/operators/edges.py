"""Edge tables: labels, first-wins duplicates, degrees, unused targets, redirects, line output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst, label): the one with the least ord. A minimum, so it is combined before the exchange."""
    return edges.groupBy("src", "dst", "label").agg(F.min("ord").alias("ord"))


def label_of(read: Column, write: Column, call: Column) -> Column:
    """The label of a reference: its flags joined by commas in this order, ``ref`` if it has none."""
    named = F.concat_ws(",", F.when(read, "read"), F.when(write, "write"), F.when(call, "call"))
    return F.when(named == "", "ref").otherwise(named)


def degrees(nodes: DataFrame, edges: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    """(id, out_degree, in_degree): strings, ``?`` where a boundary hint stands on that side."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"))
    rows = nodes.join(out, "id", "left").join(into, "id", "left").fillna(0, ["n_out", "n_in"])
    if boundary is None:
        return rows.select(*nodes.columns, F.col("n_out").cast("string").alias("out_degree"), F.col("n_in").cast("string").alias("in_degree"))
    hints = boundary.groupBy(F.col("inside").alias("id")).agg(F.max(F.col("direction") == "out").alias("o"), F.max(F.col("direction") == "in").alias("i"))
    rows = rows.join(hints, "id", "left")
    side = lambda flag, n: F.when(F.col(flag), "?").otherwise(F.col(n).cast("string"))
    return rows.select(*nodes.columns, side("o", "n_out").alias("out_degree"), side("i", "n_in").alias("in_degree"))


def unused(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge from another node reads; a node used by itself alone counts as unused."""
    used = edges.where((F.col("src") != F.col("dst")) & ~F.col("label").isin("set", "write")).select(F.col("dst").alias("id")).distinct()
    return nodes.join(used, "id", "left_anti")


def redirect(edges: DataFrame, target: DataFrame) -> DataFrame:
    """Ends that ``target`` (id, to) maps go to their stand-in; loops that arise go, and the first of equal edges stays."""
    moved = edges
    for end in ("src", "dst"):
        to = target.select(F.col("id").alias(end), F.col("to").alias(f"{end}_to"))
        moved = moved.join(to, end, "left").withColumn(end, F.coalesce(f"{end}_to", end)).drop(f"{end}_to")
    return first_wins(moved.where("src <> dst").select("src", "dst", "label", "ord"))


def collapse(nodes: DataFrame, edges: DataFrame, ancestors: DataFrame, depth: int) -> DataFrame:
    """Edges after everything deeper than ``depth`` in the tree is folded into its ancestor at that depth. ``ancestors``: a closure."""
    deep = ancestors.groupBy("id").agg(F.max("distance").alias("own"))
    to = ancestors.join(deep, "id").where((F.col("own") > depth) & (F.col("own") - F.col("distance") == depth)).select("id", F.col("anc_id").alias("to"))
    return redirect(edges, to)


def previous_in_chain(events: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Each row beside the value before it in its group: the links of a chain of writes."""
    return events.withColumn("previous", F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))).where("previous IS NOT NULL")


def escaped(text: Column) -> Column:
    """HTML entities for & " < >, the ampersand first."""
    for mark, entity in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def sanitized(text: Column) -> Column:
    """An id: everything but ASCII letters, digits and _ becomes _, a UTF-16 unit at a time."""
    wide = F.regexp_replace(text, "[\\x{10000}-\\x{10FFFF}]", "__")
    return F.regexp_replace(wide, "[^A-Za-z0-9_]", "_")


def edge_lines(edges: DataFrame) -> DataFrame:
    """A flowchart line an edge: the text and the keys of its order."""
    text = F.format_string("  n%d -->|%s| n%d", F.col("src"), escaped(F.col("label")), F.col("dst"))
    return edges.select("src", "ord", text.alias("text"))
