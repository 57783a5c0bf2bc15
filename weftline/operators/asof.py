"""As-of joins and range lookups, as windows over a union: one exchange by key, no range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_write(reads: DataFrame, writes: DataFrame, keys: list[str], at: str, value: str, inclusive: bool) -> DataFrame:
    """``reads`` with ``last_value``: the value of the last write before (or, ``inclusive``, at) each read, null if none.

    ``writes`` holds the keys, ``at`` and ``value``; of writes at one moment the largest value counts."""
    w = writes.select(*keys, at, F.col(value).alias("_v"), F.lit(0 if inclusive else 1).alias("_side"))
    r = reads.withColumns({"_v": F.lit(None).cast(writes.schema[value].dataType), "_side": F.lit(1 if inclusive else 0)})
    both = r.withColumn("_read", F.lit(True)).unionByName(w.withColumn("_read", F.lit(False)), allowMissingColumns=True)
    seen = Window.partitionBy(*keys).orderBy(at, "_side", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("last_value", F.last("_v", ignorenulls=True).over(seen))
    return out.where("_read").drop("_v", "_side", "_read")


def islands(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, value, island, first, n): runs of rows with one value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    marked = rows.withColumn("_c", changed).withColumn("island", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*keys, value, "island").agg(F.min(order[0]).alias("first"), F.count("*").alias("n"))


def innermost(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, cell: int) -> DataFrame:
    """The narrowest range (low, high, rid) that holds each point (the half-open test low <= at < high).

    Ranges are spread over cells of width ``cell`` and points meet only those of their own cell."""
    spread = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell))))
    met = points.withColumn("_cell", F.floor(F.col(at) / cell)).join(spread, [*keys, "_cell"]).where(f"low <= {at} AND {at} < high")
    return met.groupBy(*points.columns).agg(F.min_by("rid", F.struct(F.col("high") - F.col("low"), F.col("rid"))).alias("rid"))


def line_starts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, start): 1-based lines with the UTF-16 offset at which each begins."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "body"))
    units = F.char_length("body") + F.char_length(F.regexp_replace("body", "[^\\x{10000}-\\x{10FFFF}]", ""))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(units + 1).over(before), F.lit(0)).cast("long")
    return lines.select(key, (F.col("pos") + 1).cast("long").alias("line"), start.alias("start"))
