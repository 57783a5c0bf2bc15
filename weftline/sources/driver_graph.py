"""The driver tables as a graph of entities and references.

Nodes: id, kind, name, line, end_line, parent_id. Edges: src, dst, label, ord. An id is
the kind's number times 10**12 plus the key, so ids stay LONG and joins need no strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"region": 1, "nation": 2, "customer": 3, "order": 4, "part": 5, "supplier": 6}
STEP = 10**12


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(kind: str, key: str) -> Column:
    return (F.lit(KINDS[kind] * STEP) + F.col(key).cast("long")).cast("long")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [
        ("region", "region", "r_regionkey", None),
        ("nation", "nation", "n_nationkey", ("region", "n_regionkey")),
        ("customer", "customer", "c_custkey", ("nation", "c_nationkey")),
        ("order", "orders", "o_orderkey", ("customer", "o_custkey")),
        ("part", "part", "p_partkey", None),
        ("supplier", "supplier", "s_suppkey", ("nation", "s_nationkey")),
    ]
    out = None
    for kind, table, key, up in tables:
        parent = node_id(*up) if up else F.lit(None).cast("long")
        own = read(spark, sf_dir, table).select(
            node_id(kind, key).alias("id"), F.lit(kind).alias("kind"), F.concat(F.lit(f"{kind}_"), F.col(key).cast("string")).alias("name"),
            F.col(key).cast("long").alias("line"), F.col(key).cast("long").alias("end_line"), parent.alias("parent_id"),
        )
        out = own if out is None else out.unionByName(own)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = read(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_returnflag") == "R", "write").when(F.col("l_returnflag") == "A", "read,call").otherwise("read")
    uses = item.select(node_id("order", "l_orderkey").alias("src"), node_id("part", "l_partkey").alias("dst"), label.alias("label"), F.col("l_linenumber").cast("long").alias("ord"))
    owners = read(spark, sf_dir, "orders").select(node_id("order", "o_orderkey").alias("src"), node_id("customer", "o_custkey").alias("dst"), F.lit("ref").alias("label"), F.lit(0).cast("long").alias("ord"))
    places = read(spark, sf_dir, "customer").select(node_id("customer", "c_custkey").alias("src"), node_id("nation", "c_nationkey").alias("dst"), F.lit("ref").alias("label"), F.lit(0).cast("long").alias("ord"))
    return uses.unionByName(owners).unionByName(places)


GRAPH_SQL = f"""
nodes AS (
  SELECT {1 * STEP} + r_regionkey AS id, 'region' AS kind, 'region_' || r_regionkey AS name, r_regionkey::BIGINT AS line, NULL::BIGINT AS parent_id FROM region
  UNION ALL SELECT {2 * STEP} + n_nationkey, 'nation', 'nation_' || n_nationkey, n_nationkey, {1 * STEP} + n_regionkey FROM nation
  UNION ALL SELECT {3 * STEP} + c_custkey, 'customer', 'customer_' || c_custkey, c_custkey, {2 * STEP} + c_nationkey FROM customer
  UNION ALL SELECT {4 * STEP} + o_orderkey, 'order', 'order_' || o_orderkey, o_orderkey, {3 * STEP} + o_custkey FROM orders
  UNION ALL SELECT {5 * STEP} + p_partkey, 'part', 'part_' || p_partkey, p_partkey, NULL FROM part
  UNION ALL SELECT {6 * STEP} + s_suppkey, 'supplier', 'supplier_' || s_suppkey, s_suppkey, {2 * STEP} + s_nationkey FROM supplier
), edges AS (
  SELECT {4 * STEP} + l_orderkey AS src, {5 * STEP} + l_partkey AS dst, CASE l_returnflag WHEN 'R' THEN 'write' WHEN 'A' THEN 'read,call' ELSE 'read' END AS label, l_linenumber::BIGINT AS ord FROM lineitem
  UNION ALL SELECT {4 * STEP} + o_orderkey, {3 * STEP} + o_custkey, 'ref', 0 FROM orders
  UNION ALL SELECT {3 * STEP} + c_custkey, {2 * STEP} + c_nationkey, 'ref', 0 FROM customer
)"""
