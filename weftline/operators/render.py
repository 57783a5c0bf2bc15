"""Diagram text from node and edge tables: labels, arrows, numbered stubs, nesting slots, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import settled

#: Depth of nesting that needs no flag.
DEFAULT_DEPTH = 10


def line_range(line: Column, end: Column) -> Column:
    """``L1``, or ``L1-3`` where the end is known and another line."""
    at = F.concat(F.lit("L"), line.cast("string"))
    return F.when(end.isNotNull() & (end != line), F.concat(at, F.lit("-"), end.cast("string"))).otherwise(at)


def stat_label(path: Column, line: Column, name: Column, unused: Column) -> Column:
    """``path:line [unused ]name``."""
    return F.concat(path, F.lit(":"), line.cast("string"), F.when(unused, " unused ").otherwise(" "), name)


def nest_slot(depth: Column, palette: int) -> Column:
    """The palette place of a subgraph at ``depth`` (from 1)."""
    if palette < 1:
        raise ValueError("the palette is empty")
    return F.pmod(depth - 1, F.lit(palette))


def arrows(edges: DataFrame, stubs: DataFrame) -> DataFrame:
    """Edges with their line: dotted if either end is one of ``stubs`` (id).

    Two left joins; Spark broadcasts the stubs only if their size allows."""
    for end in ("src", "dst"):
        edges = edges.join(stubs.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")).distinct(), end, "left")
    arrow = F.when(F.coalesce("_src", "_dst", F.lit(False)), "-.->").otherwise("-->")
    return edges.withColumn("text", F.format_string("  n%d %s|%s| n%d", "src", arrow, "label", "dst")).drop("_src", "_dst")


def in_sections(edges: DataFrame, import_sources: DataFrame) -> DataFrame:
    """Edges with ``section``: 1, after all others, for those that start at an import's intermediate node; else 0."""
    last = import_sources.select(F.col("id").alias("src"), F.lit(1).alias("section")).distinct()
    return edges.join(last, "src", "left").fillna(0, ["section"])


def subgraph_ends(edges: DataFrame, subgraphs: DataFrame) -> DataFrame:
    """(id, role) of subgraphs at an end of an edge: ``target``, or ``source`` for those that are no target as well."""
    own = subgraphs.select("id").distinct()
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit("target").alias("role")), F.struct(F.col("src").alias("id"), F.lit("source").alias("role")))).alias("e")).select("e.*")
    return ends.join(own, "id", "left_semi").groupBy("id").agg(F.max("role").alias("role"))


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """``rows`` with their place in ``order``, from 1, without bringing them into one task.

    Ranges are sorted apart and checkpointed, so that a lost executor can't deal them anew; only a
    count per partition is summed in one place."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    dealt = settled(dealt.select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(2**33 - 1).alias("_at")).drop("_id"))
    before = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = before.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return dealt.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def boundary_stubs(boundary: DataFrame) -> DataFrame:
    """(number, stub, text): the two lines of each hint of a pruned graph, by (inside, direction)."""
    rows = numbered(boundary, ["inside", "direction"])
    stub = F.concat(F.lit("boundary_stub_"), F.col("number").cast("string"))
    inside = F.concat(F.lit("n"), F.col("inside").cast("string"))
    edge = F.when(F.col("direction") == "out", F.concat(F.lit("  "), inside, F.lit(" -.-> "), stub)).otherwise(
        F.concat(F.lit("  "), stub, F.lit(" -.->|"), F.coalesce("label", F.lit("")), F.lit("| "), inside)
    )
    return rows.select("number", stub.alias("stub"), F.concat(F.lit("  "), stub, F.lit("((...))\n"), edge).alias("text"))


def pruning_text(roots: list[str], descendants: int, ancestors: int) -> str:
    """The flags that ask for this pruning; one flag if both radii are equal."""
    radius = f"-C {descendants}" if descendants == ancestors else f"-A {descendants} -B {ancestors}"
    return f"-r {','.join(roots)} {radius}"


def depth_text(function: int, block: int, default: int = DEFAULT_DEPTH) -> str | None:
    """The shortest flags for these depths of functions and of blocks; None where both are the default."""
    if function == block:
        return None if function == default else f"--depth {function}"
    named = [("function", function), ("block", block)]
    return " ".join(f"--depth-{kind} {depth}" for kind, depth in named if depth != default)
