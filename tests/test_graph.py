"""Every graph query against its SQL, and the parts against hand-made cases."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.functions.queries import Direction, Endpoint, Path, endpoint, highlight_query, resolved, root_queries
from weftline.operators import asof, edges, prune, reach, render
from weftline.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(str(v) for v in r) for r in frame.where(frame.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    ours, theirs = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def graph(spark, pairs):
    return spark.createDataFrame([(a, b, label, k) for k, (a, b, label) in enumerate(pairs)], "src long, dst long, label string, ord long")


def ids(df):
    return {r[0] for r in df.select("id").collect()}


def test_cycles_end_and_paths_run_both_ways(spark):
    e = graph(spark, [(1, 2, "read"), (2, 3, "read"), (3, 1, "read"), (3, 4, "read")])
    seed = spark.createDataFrame([(1,)], "id long")
    assert ids(reach.bfs(seed, e, None)) == {1, 2, 3, 4}
    assert ids(reach.bfs(seed, e, 0)) == {1}
    assert ids(reach.bfs(seed, e, 2**31)) == {1}
    assert ids(reach.between(seed, spark.createDataFrame([(3,)], "id long"), e)) == {1, 2, 3}


def test_boundary_hints(spark):
    e = graph(spark, [(1, 2, "read"), (2, 3, "read,call"), (9, 2, "write"), (8, 2, "call")])
    kept = spark.createDataFrame([(1,), (2,)], "id long")
    assert {tuple(r) for r in prune.boundary(e, kept, 1, 1).collect()} == {(2, "out", None), (2, "in", "call,write")}
    assert prune.boundary(e, kept, 1, 0).count() == 1


def test_self_use_is_unused_and_collapse_drops_loops(spark):
    n = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None)], "id long, parent_id long")
    e = graph(spark, [(2, 2, "read"), (3, 2, "read"), (3, 4, "read"), (3, 4, "read")])
    assert ids(edges.unused(n, e)) == {1, 3}
    assert {tuple(r)[:2] for r in edges.collapse(n, e, reach.closure(n), 1).collect()} == {(2, 4)}


def test_text_operators(spark):
    df = spark.createDataFrame([("a\U0001f600-b", '<"&>')], "t string, u string")
    assert tuple(df.select(edges.sanitized(F.col("t")), edges.escaped(F.col("u"))).first()) == ("a___b", "&lt;&quot;&amp;&gt;")
    lines = asof.line_starts(spark.createDataFrame([(1, "\U0001f600x\ny")], "k int, t string"), "k", "t").collect()
    assert {(r["line"], r["start"]) for r in lines} == {(1, 0), (2, 4)}


def test_rendered_flags():
    assert render.pruning_text(["a", "L3"], 1, 1) == "-r a,L3 -C 1" and render.pruning_text(["b"], 2, 0) == "-r b -A 2 -B 0"
    texts = [render.depth_text(*x) for x in ((10, 10), (3, 3), (10, 4), (4, 10), (1, 2))]
    assert texts == [None, "--depth 3", "--depth-block 4", "--depth-function 4", "--depth-function 1 --depth-block 2"]
    with pytest.raises(ValueError):
        render.nest_slot(F.lit(1), 0)


def test_numbers_have_no_gaps(spark):
    rows = render.numbered(spark.range(1000).select((F.col("id") * 37 % 1000).alias("id")).repartition(7), ["id"]).collect()
    assert sorted((r["number"], r["id"]) for r in rows) == [(k + 1, k) for k in range(1000)]
    assert render.numbered(spark.range(0), ["id"]).count() == 0


def test_labels_of_missing_ends_and_unknown_edges(spark):
    df = spark.createDataFrame([(1, None), (1, 1), (1, 3)], "a int, b int")
    assert [r[0] for r in df.select(render.line_range(F.col("a"), F.col("b"))).collect()] == ["L1", "L1", "L1-3"]
    e = graph(spark, [(1, 2, "read"), (2, 3, "call")])
    one = spark.createDataFrame([(1,), (1,)], "id long")
    assert {r["text"] for r in render.arrows(e, one).collect()} == {"  n1 -.->|read| n2", "  n2 -->|call| n3"}
    assert {tuple(r) for r in render.subgraph_ends(e, spark.createDataFrame([(1,), (2,)], "id long")).collect()} == {(1, "source"), (2, "target")}


def test_query_grammar():
    assert endpoint("3-9") == Endpoint(3, 9) and endpoint("3:ab") == Endpoint(3, 3, "ab") and endpoint("L3-4") == Endpoint(3, 4)
    assert endpoint("L12").ambiguous and resolved(endpoint("L12"), True) == Endpoint(name="L12") and resolved(endpoint("L12"), False) == Endpoint(12, 12)
    assert isinstance(highlight_query("a..b"), Path) and highlight_query("a..+c") == Direction(Endpoint(name="a"), "c")
    for bad in ("0", "9-3", "é", "99999999999"):
        with pytest.raises(ValueError):
            endpoint(bad)
    for bad in ("a..b..c",):
        with pytest.raises(ValueError):
            highlight_query(bad)
    with pytest.raises(ValueError):
        root_queries("a,,b")
