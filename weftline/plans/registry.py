"""The graph operators over the driver tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import offsets
from ..functions.queries import endpoint, root_queries
from ..operators import asof, edges, files, prune, reach, render
from ..sources import code
from ..sources import driver_graph as g
from ..sources.script.flow import ceiling
from .forms import FORMS
from .lineage import settled

Query = Callable[[SparkSession, str], DataFrame]
S = g.STEP
ROOTS = "5:customer_5, 7:order_7"
ROOT_SQL = f"roots AS (SELECT id FROM nodes WHERE (line = 5 AND name = 'customer_5') OR (line = 7 AND name = 'order_7'))"
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__], ORACLE_SQL[fn.__name__] = fn, sql
        return fn

    return add


def _roots(spark: SparkSession, d: str) -> DataFrame:
    found = None
    for q in root_queries(ROOTS):
        own = g.nodes(spark, d).where(q.matches()).select("id")
        found = own if found is None else found.union(own)
    return found.distinct()


WALK = """down AS (SELECT id, 0 AS depth FROM roots UNION SELECT e.dst, w.depth + 1 FROM down w JOIN edges e ON e.src = w.id WHERE w.depth < {down}),
up AS (SELECT id, 0 AS depth FROM roots UNION SELECT e.src, w.depth + 1 FROM up w JOIN edges e ON e.dst = w.id WHERE w.depth < {up})"""
KEPT = f"WITH RECURSIVE {g.GRAPH_SQL}, {ROOT_SQL}, {WALK.format(down=2, up=1)}, kept AS (SELECT id FROM down UNION SELECT id FROM up)"


@query(f"{KEPT} SELECT n.id, n.kind, n.name FROM nodes n JOIN kept USING (id)")
def prune_nodes(spark: SparkSession, d: str) -> DataFrame:
    kept = prune.kept_ids(_roots(spark, d), g.edges(spark, d), 2, 1)
    return g.nodes(spark, d).join(kept, "id", "left_semi").select("id", "kind", "name")


@query(f"WITH {g.GRAPH_SQL} SELECT src, dst, label, min(ord) AS ord FROM edges GROUP BY src, dst, label")
def edge_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return edges.first_wins(g.edges(spark, d))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN array_to_string(f, ',') = '' THEN 'ref' ELSE array_to_string(f, ',') END AS label FROM (
  SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN l_quantity > 25 THEN 'read' END, CASE WHEN l_returnflag = 'R' THEN 'write' END, CASE WHEN l_linestatus = 'F' THEN 'call' END], lambda x: x IS NOT NULL) AS f FROM lineitem)""")
def edge_labels(spark: SparkSession, d: str) -> DataFrame:
    label = edges.label_of(F.col("l_quantity") > 25, F.col("l_returnflag") == "R", F.col("l_linestatus") == "F")
    return g.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", label.alias("label"))


@query(f"WITH {g.GRAPH_SQL} SELECT DISTINCT src, dst FROM edges")
def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return g.edges(spark, d).select("src", "dst").distinct()


@query(f"WITH RECURSIVE {g.GRAPH_SQL}, {ROOT_SQL}, {WALK.format(down=2, up=0)} SELECT id, min(depth)::INT AS depth FROM down GROUP BY id")
def bfs_desc_r2(spark: SparkSession, d: str) -> DataFrame:
    return reach.bfs(_roots(spark, d), g.edges(spark, d), 2)


@query(f"WITH RECURSIVE {g.GRAPH_SQL}, {ROOT_SQL}, {WALK.format(down=0, up=2)} SELECT id, min(depth)::INT AS depth FROM up GROUP BY id")
def bfs_anc_r2(spark: SparkSession, d: str) -> DataFrame:
    return reach.bfs(_roots(spark, d), g.edges(spark, d), 2, forward=False)


REACH = "{name} AS (SELECT id FROM {seed} UNION SELECT e.{far} FROM {name} w JOIN edges e ON e.{near} = w.id)"


@query(f"WITH RECURSIVE {g.GRAPH_SQL}, {ROOT_SQL}, {REACH.format(name='r', seed='roots', near='src', far='dst')} SELECT id FROM r")
def reach_all(spark: SparkSession, d: str) -> DataFrame:
    return reach.bfs(_roots(spark, d), g.edges(spark, d), None).select("id")


@query(
    f"WITH RECURSIVE {g.GRAPH_SQL}, a AS (SELECT id FROM nodes WHERE name = 'order_7'), b AS (SELECT id FROM nodes WHERE kind = 'nation'),"
    + ", ".join(REACH.format(name=n, seed=s, near=x, far=y) for n, s, x, y in (("fa", "a", "src", "dst"), ("bb", "b", "dst", "src"), ("fb", "b", "src", "dst"), ("ba", "a", "dst", "src")))
    + " (SELECT id FROM fa INTERSECT SELECT id FROM bb) UNION (SELECT id FROM fb INTERSECT SELECT id FROM ba)"
)
def path_between(spark: SparkSession, d: str) -> DataFrame:
    n = g.nodes(spark, d)
    return reach.between(n.where(endpoint("order_7").matches()).select("id"), n.where("kind = 'nation'").select("id"), g.edges(spark, d))


@query(f"{KEPT} SELECT e.src, e.dst, e.label, e.ord FROM edges e WHERE e.src IN (SELECT id FROM kept) AND e.dst IN (SELECT id FROM kept)")
def prune_edges(spark: SparkSession, d: str) -> DataFrame:
    e = g.edges(spark, d)
    return prune.inner_edges(e, prune.kept_ids(_roots(spark, d), e, 2, 1)).select("src", "dst", "label", "ord")


@query(f"""{KEPT}, o AS (SELECT DISTINCT src AS inside FROM edges WHERE src IN (SELECT id FROM kept) AND dst NOT IN (SELECT id FROM kept)),
i AS (SELECT DISTINCT dst AS inside, unnest(string_split(label, ',')) AS part FROM edges WHERE dst IN (SELECT id FROM kept) AND src NOT IN (SELECT id FROM kept))
SELECT inside, 'out' AS direction, NULL::VARCHAR AS label FROM o UNION ALL SELECT inside, 'in', string_agg(part, ',' ORDER BY part) FROM i GROUP BY inside""")
def prune_boundary(spark: SparkSession, d: str) -> DataFrame:
    e = g.edges(spark, d)
    return prune.boundary(e, prune.kept_ids(_roots(spark, d), e, 2, 1), 2, 1)


DEGREE = f"""WITH {g.GRAPH_SQL}, o AS (SELECT src AS id, count(*) AS n FROM edges GROUP BY src), i AS (SELECT dst AS id, count(*) AS n FROM edges GROUP BY dst),
deg AS (SELECT nodes.id, kind, coalesce(o.n, 0)::BIGINT AS n_out, coalesce(i.n, 0)::BIGINT AS n_in FROM nodes LEFT JOIN o USING (id) LEFT JOIN i USING (id))"""


@query(f"{DEGREE} SELECT id, kind, n_out::VARCHAR AS out_degree, n_in::VARCHAR AS in_degree FROM deg")
def degree_stats(spark: SparkSession, d: str) -> DataFrame:
    return edges.degrees(g.nodes(spark, d).select("id", "kind"), g.edges(spark, d))


@query(f"{DEGREE} SELECT kind, sum(n_out)::BIGINT AS n_out, sum(n_in)::BIGINT AS n_in FROM deg GROUP BY ROLLUP (kind)")
def degree_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = edges.degrees(g.nodes(spark, d).select("id", "kind"), g.edges(spark, d))
    return rows.rollup("kind").agg(F.sum(F.col("out_degree").cast("long")).alias("n_out"), F.sum(F.col("in_degree").cast("long")).alias("n_in"))


ASOF = """SELECT r.event_id, r.user_id, w.v AS last_value FROM (SELECT * FROM events WHERE event_type = 'view') r
ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) w ON r.user_id = w.user_id AND r.ts {op} w.ts"""


def _asof(spark: SparkSession, d: str, inclusive: bool) -> DataFrame:
    e = g.read(spark, d, "events")
    views = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    return asof.last_write(views, e.where("event_type = 'purchase'"), ["user_id"], "ts", "value", inclusive).select("event_id", "user_id", "last_value")


@query(ASOF.format(op=">"))
def asof_strict(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, False)


@query(ASOF.format(op=">="))
def asof_inclusive(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, True)


@query("SELECT * FROM (SELECT event_id, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events WHERE event_type = 'purchase') WHERE previous IS NOT NULL")
def set_chain(spark: SparkSession, d: str) -> DataFrame:
    writes = g.read(spark, d, "events").where("event_type = 'purchase'")
    return edges.previous_in_chain(writes, ["user_id"], ["ts", "event_id"], "event_id").select("event_id", "user_id", "previous")


@query("""SELECT user_id, event_type, island::BIGINT AS island, min(ts) AS first, count(*) AS n FROM (
  SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS c FROM events))
GROUP BY user_id, event_type, island""")
def gaps_islands(spark: SparkSession, d: str) -> DataFrame:
    return asof.islands(g.read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").withColumn("island", F.col("island").cast("long"))


@query(f"WITH {g.GRAPH_SQL} SELECT id, kind FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst = n.id AND e.src <> e.dst AND e.label NOT IN ('set', 'write'))")
def unused_bindings(spark: SparkSession, d: str) -> DataFrame:
    return edges.unused(g.nodes(spark, d).select("id", "kind"), g.edges(spark, d))


CLOSURE = f"WITH RECURSIVE {g.GRAPH_SQL}, cl AS (SELECT id, id AS anc_id, 0 AS distance FROM nodes UNION ALL SELECT cl.id, n.parent_id, distance + 1 FROM cl JOIN nodes n ON n.id = cl.anc_id WHERE n.parent_id IS NOT NULL)"


@query(f"{CLOSURE} SELECT id, max(distance)::INT AS depth FROM cl GROUP BY id")
def closure_depth(spark: SparkSession, d: str) -> DataFrame:
    return reach.closure(g.nodes(spark, d)).groupBy("id").agg(F.max("distance").alias("depth"))


@query(f"{CLOSURE} SELECT cl.id, arg_min(n.name, cl.distance) AS scope FROM cl JOIN nodes n ON n.id = cl.anc_id WHERE n.line % 3 = 0 AND n.kind <> 'order' GROUP BY cl.id")
def scope_resolve(spark: SparkSession, d: str) -> DataFrame:
    n = g.nodes(spark, d)
    declared = n.where("line % 3 = 0 AND kind <> 'order'").select(F.col("id").alias("anc_id"), "name")
    return reach.closure(n).join(declared, "anc_id").groupBy("id").agg(F.min_by("name", "distance").alias("scope"))


@query(f"""{CLOSURE}, dep AS (SELECT id, max(distance) AS own FROM cl GROUP BY id),
m AS (SELECT cl.id, cl.anc_id AS t FROM cl JOIN dep USING (id) WHERE own > 1 AND own - distance = 1),
x AS (SELECT coalesce(a.t, e.src) AS src, coalesce(b.t, e.dst) AS dst, label, ord FROM edges e LEFT JOIN m a ON a.id = e.src LEFT JOIN m b ON b.id = e.dst)
SELECT src, dst, label, min(ord) AS ord FROM x WHERE src <> dst GROUP BY src, dst, label""")
def collapse_redirect(spark: SparkSession, d: str) -> DataFrame:
    n = g.nodes(spark, d)
    return edges.collapse(n, g.edges(spark, d), reach.closure(n), 1)


@query("""WITH r AS (SELECT n_regionkey AS k, n_nationkey AS rid, n_nationkey * 10 AS low, n_nationkey * 10 + 40 + n_nationkey AS high FROM nation),
p AS (SELECT c_custkey, n_regionkey AS k, c_custkey % 300 AS pos FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, p.k, p.pos, arg_min(rid, (high - low) * 1000 + rid)::INT AS rid FROM p JOIN r ON p.k = r.k AND low <= pos AND pos < high GROUP BY c_custkey, p.k, p.pos""")
def innermost_range(spark: SparkSession, d: str) -> DataFrame:
    nation = g.read(spark, d, "nation")
    ranges = nation.selectExpr("n_regionkey AS k", "n_nationkey AS rid", "n_nationkey * 10 AS low", "n_nationkey * 10 + 40 + n_nationkey AS high")
    points = g.read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("c_custkey", "n_regionkey AS k", "c_custkey % 300 AS pos")
    return asof.innermost(points, ranges, ["k"], "pos", 32)


@query("""SELECT doc_id, i::BIGINT AS line, coalesce(sum(len(b) + len(regexp_replace(b, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS b, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""")
def line_of_offset(spark: SparkSession, d: str) -> DataFrame:
    return asof.line_starts(g.read(spark, d, "documents"), "doc_id", "text")


@query("SELECT p_partkey, regexp_replace(p_name || '-' || p_brand, '[^A-Za-z0-9_]', '_', 'g') AS ident FROM part")
def sanitize_ids(spark: SparkSession, d: str) -> DataFrame:
    return g.read(spark, d, "part").select("p_partkey", edges.sanitized(F.concat_ws("-", "p_name", "p_brand")).alias("ident"))


@query("""SELECT event_id, replace(replace(replace(replace(props, '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;') AS label FROM events""")
def escape_labels(spark: SparkSession, d: str) -> DataFrame:
    return g.read(spark, d, "events").select("event_id", edges.escaped(F.col("props")).alias("label"))


@query(f"WITH {g.GRAPH_SQL} SELECT id FROM nodes WHERE line BETWEEN 3 AND 9 OR name = 'part_12' OR (line = 5 AND name = 'customer_5')")
def query_predicates(spark: SparkSession, d: str) -> DataFrame:
    own = F.lit(False)
    for q in root_queries("3-9, part_12, 5:customer_5"):
        own = own | q.matches()
    return g.nodes(spark, d).where(own).select("id")


@query("SELECT page_id, unnest(regexp_extract_all(html, '<script>([^<]*(?:<[^/][^<]*|</[^s][^<]*)*)</script>', 1)) AS script FROM pages")
def inline_scripts(spark: SparkSession, d: str) -> DataFrame:
    found = F.expr(r"regexp_extract_all(html, '<script>([^<]*(?:<[^/][^<]*|</[^s][^<]*)*)</script>', 1)")
    return g.read(spark, d, "pages").select("page_id", F.explode(found).alias("script"))


@query(f"WITH {g.GRAPH_SQL} SELECT src, ord, '  n' || src || ' -->|' || label || '| n' || dst AS text FROM edges")
def flow_lines(spark: SparkSession, d: str) -> DataFrame:
    return edges.edge_lines(g.edges(spark, d))


@query("SELECT n_nationkey, 'L' || n_nationkey || CASE WHEN n_regionkey <> 0 THEN '-' || (n_nationkey + n_regionkey) ELSE '' END AS label FROM nation")
def line_ranges(spark: SparkSession, d: str) -> DataFrame:
    n = g.read(spark, d, "nation")
    return n.select("n_nationkey", render.line_range(F.col("n_nationkey"), F.col("n_nationkey") + F.col("n_regionkey")).alias("label"))


@query(f"{CLOSURE} SELECT id, (max(distance) % 3)::INT AS slot FROM cl GROUP BY id")
def nest_slots(spark: SparkSession, d: str) -> DataFrame:
    depth = reach.closure(g.nodes(spark, d)).groupBy("id").agg((F.max("distance") + 1).alias("depth"))
    return depth.select("id", render.nest_slot(F.col("depth"), 3).cast("int").alias("slot"))


STUBS = f"stubs AS (SELECT {5 * S} + p_partkey AS id FROM part WHERE p_size >= 40)"


def _stubs(spark: SparkSession, d: str) -> DataFrame:
    return g.read(spark, d, "part").where("p_size >= 40").select(g.node_id("part", "p_partkey").alias("id"))


@query(f"""WITH {g.GRAPH_SQL}, {STUBS} SELECT src, dst, label, ord, '  n' || src || CASE WHEN src IN (SELECT id FROM stubs) OR dst IN (SELECT id FROM stubs) THEN ' -.->|' ELSE ' -->|' END || label || '| n' || dst AS text FROM edges""")
def edge_arrows(spark: SparkSession, d: str) -> DataFrame:
    return render.arrows(g.edges(spark, d), _stubs(spark, d)).select("src", "dst", "label", "ord", "text")


@query(f"WITH {g.GRAPH_SQL} SELECT src, dst, label, ord, (src IN (SELECT id FROM nodes WHERE kind = 'customer'))::INT AS section FROM edges")
def edge_sections(spark: SparkSession, d: str) -> DataFrame:
    sources = g.nodes(spark, d).where("kind = 'customer'")
    return render.in_sections(g.edges(spark, d), sources).select("src", "dst", "label", "ord", "section")


@query(f"""WITH {g.GRAPH_SQL}, sub AS (SELECT id FROM nodes WHERE kind IN ('region', 'nation', 'customer'))
SELECT id, CASE WHEN id IN (SELECT dst FROM edges) THEN 'target' ELSE 'source' END AS role FROM sub WHERE id IN (SELECT dst FROM edges) OR id IN (SELECT src FROM edges)""")
def subgraph_roles(spark: SparkSession, d: str) -> DataFrame:
    return render.subgraph_ends(g.edges(spark, d), g.nodes(spark, d).where("kind IN ('region', 'nation', 'customer')"))


@query(ORACLE_SQL["prune_boundary"].replace("SELECT inside, 'out'", ", b AS (SELECT inside, 'out'", 1) + """), k AS (SELECT *, row_number() OVER (ORDER BY inside, direction) AS number FROM b)
SELECT number, 'boundary_stub_' || number AS stub, '  boundary_stub_' || number || '((...))' || chr(10) || CASE direction WHEN 'out' THEN '  n' || inside || ' -.-> boundary_stub_' || number
ELSE '  boundary_stub_' || number || ' -.->|' || coalesce(label, '') || '| n' || inside END AS text FROM k""")
def boundary_stubs(spark: SparkSession, d: str) -> DataFrame:
    return render.boundary_stubs(prune_boundary(spark, d))


@query(f"""{DEGREE}, un AS (SELECT id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst = n.id AND e.src <> e.dst AND e.label NOT IN ('set', 'write')))
SELECT d.id, n_out::VARCHAR AS out_degree, n_in::VARCHAR AS in_degree, 'graph:' || line || CASE WHEN d.id IN (SELECT id FROM un) THEN ' unused ' ELSE ' ' END || name AS label FROM deg d JOIN nodes USING (id)""")
def stat_rows(spark: SparkSession, d: str) -> DataFrame:
    n, e = g.nodes(spark, d), g.edges(spark, d)
    rows = edges.degrees(n.select("id", "line", "name"), e)
    unused = edges.unused(n.select("id"), e).withColumn("unused", F.lit(True))
    rows = rows.join(unused, "id", "left").withColumn("unused", F.coalesce("unused", F.lit(False)))
    return rows.select("id", "out_degree", "in_degree", render.stat_label(F.lit("graph"), F.col("line"), F.col("name"), F.col("unused")).alias("label"))


# The texts of the driver hold no character beyond 16 bits, so that SQL may count code points.
OFFSETS_SQL = "t AS (SELECT doc_id, text, 3 + doc_id % 50 AS a, 3 + doc_id % 50 + doc_id % 9 AS b FROM documents WHERE text IS NOT NULL)"


@query(f"""WITH {OFFSETS_SQL} SELECT doc_id, substring(text, a + 1, b - a) AS part, strlen(substring(text, 1, b)) AS at_byte, 1 + len(substring(text, 1, b)) - len(replace(substring(text, 1, b), chr(10), '')) AS line,
  len(string_split(substring(text, 1, b), chr(10))[-1]) AS col, least(b, len(text)) AS pos FROM t""")
def text_offsets(spark: SparkSession, d: str) -> DataFrame:
    t, a = F.col("text"), (3 + F.col("doc_id") % 50).cast("int")
    b = a + (F.col("doc_id") % 9).cast("int")
    rows = g.read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text", offsets.slice_units(t, a, b).alias("part"), offsets.unit_to_byte(t, b).alias("at_byte"))
    span = offsets.span_of_byte(t, F.col("at_byte"))
    return rows.select("doc_id", "part", "at_byte", span["line"].alias("line"), span["column"].alias("col"), span["offset"].alias("pos"))


# Script sources. Every customer makes one program out of its row, and every page holds an inline script; the SQL states
# what their tables and graphs must be without parsing anything.
HAS_ELSE = "c_acctbal < 5000"


def _programs(spark: SparkSession, d: str) -> DataFrame:
    own = F.concat(F.lit("a"), F.col("c_custkey").cast("string"))
    text = F.concat(
        F.lit("let "), own, F.lit(" = 1;\nif ("), own, F.lit(") {\n  "), own, F.lit(" = 2;\n}"),
        F.when(F.expr(HAS_ELSE), F.concat(F.lit(" else {\n  "), own, F.lit(" = 3;\n}"))).otherwise(""),
        F.lit("\nconst total = "), own, F.lit(";\nfunction show(x) {\n  return x;\n}\nshow(total);\n"),
    )
    path = F.concat(F.lit("customer/"), F.col("c_custkey").cast("string"), F.lit(".ts"))
    return g.read(spark, d, "customer").select(path.alias("path"), text.alias("text"))


def _program_ir(spark: SparkSession, d: str) -> DataFrame:
    return code.analysed(_programs(spark, d))


#: the programs again, with the offsets of what they declare
PROGRAMS_SQL = f"""b AS (SELECT 'customer/' || c_custkey || '.ts' AS path, 'a' || c_custkey AS a, {HAS_ELSE} AS two FROM customer),
t AS (SELECT *, 'let ' || a || ' = 1;' || chr(10) || 'if (' || a || ') {{' || chr(10) || '  ' || a || ' = 2;' || chr(10) || '}}' || CASE WHEN two THEN ' else {{' || chr(10) || '  ' || a || ' = 3;' || chr(10) || '}}' ELSE '' END
  || chr(10) || 'const total = ' || a || ';' || chr(10) || 'function show(x) {{' || chr(10) || '  return x;' || chr(10) || '}}' || chr(10) || 'show(total);' || chr(10) AS text FROM b),
p AS (SELECT *, 'n_scope_0_' || a || '_4' AS va, strpos(text, 'total =') - 1 AS at_total, strpos(text, 'show(x)') - 1 AS at_show, strpos(text, 'if (') - 1 AS at_if, strpos(text, 'return x') - 1 AS at_return,
  strpos(text, 'show(total)') - 1 AS at_call, CASE WHEN two THEN 3 ELSE 2 END AS fn FROM t)"""


@query(f"""WITH {PROGRAMS_SQL} SELECT path, a AS name, 'scope#0' AS scope, CASE WHEN two THEN 5 ELSE 4 END AS n_references, false AS unused FROM p
UNION ALL SELECT path, 'total', 'scope#0', 2, false FROM p UNION ALL SELECT path, 'show', 'scope#0', 1, false FROM p UNION ALL SELECT path, 'x', 'scope#' || fn, 1, false FROM p""")
def script_variables(spark: SparkSession, d: str) -> DataFrame:
    return code.exploded(_program_ir(spark, d), "variables").select("path", "name", "scope", F.size("references").alias("n_references"), "unused")


@query(f"""WITH {PROGRAMS_SQL} SELECT path, 'scope#0' AS id, 'module' AS type, NULL::VARCHAR AS upper, 0::BIGINT AS depth_if FROM p
UNION ALL SELECT path, 'scope#' || k, 'block', 'scope#0', 1 FROM p, range(1, 3) r(k) WHERE k = 1 OR two UNION ALL SELECT path, 'scope#' || fn, 'function', 'scope#0', 0 FROM p""")
def script_scopes(spark: SparkSession, d: str) -> DataFrame:
    return code.exploded(_program_ir(spark, d), "scopes").select("path", "id", "type", "upper", F.col("depths.if").alias("depth_if"))


@query(f"""WITH {PROGRAMS_SQL}, r AS (SELECT path, 4 AS pos, a AS name, 'write' AS how, true AS init FROM p UNION ALL SELECT path, at_if + 4, a, 'read', false FROM p
UNION ALL SELECT path, strpos(text, a || ' = 2') - 1, a, 'write', false FROM p UNION ALL SELECT path, strpos(text, a || ' = 3') - 1, a, 'write', false FROM p WHERE two
UNION ALL SELECT path, at_total, 'total', 'write', true FROM p UNION ALL SELECT path, at_total + 8, a, 'read', true FROM p UNION ALL SELECT path, at_return + 7, 'x', 'read', false FROM p
UNION ALL SELECT path, at_call, 'show', 'read,call', false FROM p UNION ALL SELECT path, at_call + 5, 'total', 'read', false FROM p)
SELECT path, pos, name, how, init, 'ref#' || (row_number() OVER (PARTITION BY path ORDER BY pos) - 1) AS id FROM r""")
def script_references(spark: SparkSession, d: str) -> DataFrame:
    rows = code.exploded(_program_ir(spark, d), "references")
    return rows.select("path", F.col("at.offset").alias("pos"), "name", edges.label_of(F.col("read"), F.col("write"), F.col("call")).alias("how"), "init", "id")


GRAPH_EDGES = f"""WITH {PROGRAMS_SQL}, e AS (SELECT path, va AS src, 'wr_ref_2' AS dst, 'set' AS label FROM p UNION ALL SELECT path, va, 'wr_ref_3', 'set' FROM p WHERE two
UNION ALL SELECT path, va, 'if_test_scope_0_' || at_if, 'read' FROM p UNION ALL SELECT path, 'wr_ref_2', 'n_scope_0_total_' || at_total, 'read' FROM p
UNION ALL SELECT path, CASE WHEN two THEN 'wr_ref_3' ELSE va END, 'n_scope_0_total_' || at_total, 'read' FROM p
UNION ALL SELECT path, 'n_scope_' || fn || '_x_' || (at_show + 5), 'ret_use_ref_' || CASE WHEN two THEN 6 ELSE 5 END, 'read' FROM p
UNION ALL SELECT path, 'n_scope_0_show_' || at_show, 'expr_stmt_' || at_call, 'read,call' FROM p UNION ALL SELECT path, 'n_scope_0_total_' || at_total, 'expr_stmt_' || at_call, 'read' FROM p)"""


@query(f"{GRAPH_EDGES} SELECT path, src, dst, label FROM e")
def script_edges(spark: SparkSession, d: str) -> DataFrame:
    return code.graph_rows(code.file_graphs(_programs(spark, d)), "edges").select("path", "src", "dst", "label")


@query(f"""{GRAPH_EDGES}, n AS (SELECT path, unnest([va, 'n_scope_0_total_' || at_total, 'n_scope_0_show_' || at_show, 'if_test_scope_0_' || at_if, 'wr_ref_2', 'n_scope_' || fn || '_x_' || (at_show + 5),
  'ret_use_ref_' || CASE WHEN two THEN 6 ELSE 5 END, 'expr_stmt_' || at_call, CASE WHEN two THEN 'wr_ref_3' END]) AS id FROM p)
SELECT path, id, (SELECT count(*) FROM e WHERE e.path = n.path AND e.src = n.id) AS n_out, (SELECT count(*) FROM e WHERE e.path = n.path AND e.dst = n.id) AS n_in FROM n WHERE id IS NOT NULL""")
def script_degrees(spark: SparkSession, d: str) -> DataFrame:
    graph = settled(code.file_graphs(_programs(spark, d)).select("path", "nodes", "edges"))
    rows = files.with_degrees(graph.select("path", F.explode("nodes.id").alias("id")), graph)
    return rows.select("path", "id", F.col("out_degree").alias("n_out"), F.col("in_degree").alias("n_in"))


@query(r"""WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '<script>([^<]*(?:<[^/][^<]*|</[^s][^<]*)*)</script>', 1)) AS script FROM pages)
SELECT page_id, 't' AS name, false AS is_global, count(*) AS n FROM s GROUP BY page_id UNION ALL SELECT page_id, 'track', true, count(*) FROM s GROUP BY page_id""")
def page_script_names(spark: SparkSession, d: str) -> DataFrame:
    scripts = inline_scripts(spark, d).select(F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit(".js")).alias("path"), F.col("script").alias("text"))
    rows = code.exploded(code.analysed(scripts), "variables")
    page = F.regexp_extract("path", r"page/(\d+)", 1).cast("long").alias("page_id")
    is_global = F.exists("defs", lambda x: x["type"] == "ImplicitGlobalVariable").alias("is_global")
    return rows.groupBy(page, "name", is_global).agg(F.count("*").alias("n"))


@query(f"""{GRAPH_EDGES}, r AS (SELECT path, 'n_scope_0_total_' || at_total AS id FROM p)
SELECT path, id AS node FROM r UNION SELECT e.path, e.dst FROM e JOIN r ON e.path = r.path AND e.src = r.id UNION SELECT e.path, e.src FROM e JOIN r ON e.path = r.path AND e.dst = r.id""")
def script_prune(spark: SparkSession, d: str) -> DataFrame:
    graph = settled(code.file_graphs(_programs(spark, d)).drop("diagram"))
    return files.pruned(files.keyed_nodes(graph), files.keyed_edges(graph), "total", 1, 1).select("path", "node")


@query(f"""{GRAPH_EDGES}, n AS (SELECT path, va AS id, 1 AS line, a AS name FROM p UNION ALL SELECT path, 'wr_ref_2', 3, a FROM p UNION ALL SELECT path, 'wr_ref_3', 5, a FROM p WHERE two
UNION ALL SELECT path, 'if_test_scope_0_' || at_if, 2, 'if ()' FROM p UNION ALL SELECT path, 'n_scope_0_total_' || at_total, CASE WHEN two THEN 7 ELSE 5 END, 'total' FROM p UNION ALL SELECT path, 'n_scope_0_show_' || at_show, CASE WHEN two THEN 8 ELSE 6 END, 'show' FROM p
UNION ALL SELECT path, 'n_scope_' || fn || '_x_' || (at_show + 5), CASE WHEN two THEN 8 ELSE 6 END, 'x' FROM p UNION ALL SELECT path, 'ret_use_ref_' || CASE WHEN two THEN 6 ELSE 5 END, CASE WHEN two THEN 9 ELSE 7 END, 'x' FROM p
UNION ALL SELECT path, 'expr_stmt_' || at_call, CASE WHEN two THEN 11 ELSE 9 END, 'show()' FROM p)
SELECT path, line, path || ':' || line || ' ' || name AS label, (SELECT count(*) FROM e WHERE e.path = n.path AND e.src = n.id) AS out_degree, (SELECT count(*) FROM e WHERE e.path = n.path AND e.dst = n.id) AS in_degree FROM n""")
def script_stats(spark: SparkSession, d: str) -> DataFrame:
    return files.stats(settled(code.file_graphs(_programs(spark, d)).select("path", "nodes", "edges")))


@query(f"""WITH {PROGRAMS_SQL}, q AS (SELECT *, CASE WHEN two THEN '  ' ELSE '' END AS pad, CASE WHEN two THEN 8 ELSE 6 END AS l, 's_scope_' || fn AS box, 's_return_scope_0_show_' || at_show || '_' || at_return || '_' || (at_return + 9) AS ret,
  'n_scope_0_total_' || at_total AS total, 'n_scope_0_show_' || at_show AS fshow, 'n_scope_' || fn || '_x_' || (at_show + 5) AS x, 'ret_use_ref_' || CASE WHEN two THEN 6 ELSE 5 END AS used, 'if_test_scope_0_' || at_if AS test, 'expr_stmt_' || at_call AS stmt, 'cont_if_scope_0_' || at_if AS cont FROM p)
SELECT path, concat_ws(chr(10), '%%{{init: {{"flowchart": {{"defaultRenderer": "elk"}}}}}}%%', 'flowchart RL', '  ' || va || '["let ' || a || '<br/>L1"]', '  ' || total || '["total<br/>L' || (l - 1) || '"]',
  CASE WHEN two THEN '  subgraph ' || cont || '["if-else L2-6"]' || chr(10) || '    direction RL' END,
  pad || '  subgraph s_scope_1["if L2-4"]', pad || '    direction RL', pad || '    ' || test || '{{"if ()<br/>L2"}}', pad || '    wr_ref_2(["let ' || a || '<br/>L3"])', pad || '  end',
  CASE WHEN two THEN concat_ws(chr(10), '    subgraph s_scope_2["else L4-6"]', '      direction RL', '      wr_ref_3(["let ' || a || '<br/>L5"])', '    end', '  end') END,
  '  subgraph wrap_' || box || '[" "]', '    direction TB', '    ' || fshow || '["show()<br/>L' || l || '"]', '    subgraph ' || box || '["show()<br/>L' || l || '-' || (l + 2) || '"]', '      direction RL', '      ' || x || '["x<br/>L' || l || '"]',
  '      subgraph ' || ret || '["return L' || (l + 1) || '"]', '        direction RL', '        ' || used || '["x<br/>L' || (l + 1) || '"]', '      end', '    end', '  end',
  '  ' || va || ' -->|set| wr_ref_2', CASE WHEN two THEN '  ' || va || ' -->|set| wr_ref_3' END, '  ' || va || ' -->|read| ' || test, CASE WHEN NOT two THEN '  ' || va || ' -->|read| ' || total END, '  wr_ref_2 -->|read| ' || total, CASE WHEN two THEN '  wr_ref_3 -->|read| ' || total END,
  '  ' || x || ' -->|read| ' || used, '  ' || fshow || ' -->|read,call| ' || stmt, '  ' || total || ' -->|read| ' || stmt, '  ' || stmt || '["show()<br/>L' || (l + 3) || '"]',
  '  classDef nestL1 fill:#11192a,stroke:transparent;', '  class ' || CASE WHEN two THEN cont ELSE 's_scope_1' END || ' nestL1;', '  class wrap_' || box || ' nestL1;', '  classDef nestL2 fill:#1a2538,stroke:transparent;',
  CASE WHEN two THEN '  class s_scope_1 nestL2;' || chr(10) || '  class s_scope_2 nestL2;' END, '  class ' || box || ' nestL2;', '  classDef nestL3 fill:#243047,stroke:transparent;', '  class ' || ret || ' nestL3;', '') AS diagram FROM q""")
def script_diagrams(spark: SparkSession, d: str) -> DataFrame:
    """The diagram text of every program."""
    return code.file_graphs(_programs(spark, d)).select("path", "diagram")


@query(f"""WITH {PROGRAMS_SQL} SELECT path, va AS src, 'read' AS label, 'module_root' AS dst FROM p UNION ALL SELECT path, va, 'read', 'n_scope_0_total_' || at_total FROM p WHERE NOT two
UNION ALL SELECT path, 'n_scope_0_show_' || at_show, 'read,call', 'expr_stmt_' || at_call FROM p UNION ALL SELECT path, 'n_scope_0_total_' || at_total, 'read', 'expr_stmt_' || at_call FROM p""")
def script_depth(spark: SparkSession, d: str) -> DataFrame:
    """The edges with nothing nested: blocks are gone and functions are their node."""
    return code.graph_rows(code.file_graphs(_programs(spark, d), limits=ceiling(0, 0)), "edges").select("path", "src", "label", "dst")


#: what the queries "total" and "show..+a" mark
MARKS_SQL = """m AS (SELECT path, 'n_scope_0_total_' || at_total AS id, true AS point FROM p UNION ALL SELECT path, 'n_scope_0_show_' || at_show, false FROM p UNION ALL SELECT path, 'expr_stmt_' || at_call, false FROM p)"""


def _marks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    graph = settled(code.file_graphs(_programs(spark, d)).drop("diagram"))
    links = files.keyed_edges(graph)
    return links, files.highlighted(files.keyed_nodes(graph), links, "total,show..+a")


@query(f"{GRAPH_EDGES}, {MARKS_SQL} SELECT path || chr(10) || id AS id, point FROM m")
def script_highlight(spark: SparkSession, d: str) -> DataFrame:
    return _marks(spark, d)[1]


@query(f"""{GRAPH_EDGES}, {MARKS_SQL} SELECT e.path || chr(10) || src AS src, e.path || chr(10) || dst AS dst, label FROM e LEFT JOIN m a ON a.path = e.path AND a.id = e.src LEFT JOIN m b ON b.path = e.path AND b.id = e.dst
WHERE a.point OR b.point OR (a.id IS NOT NULL AND b.id IS NOT NULL)""")
def script_marked_edges(spark: SparkSession, d: str) -> DataFrame:
    links, marks = _marks(spark, d)
    return files.marked_edges(links, marks).select("src", "dst", "label")


# One query for each form of statement, over a program for each supplier.
def _form_sql(form: dict) -> str:
    rows = ", ".join(f"({kind!r}, {text!r})" for kind in ("edges", "nodes") for text in form[kind])
    return f"WITH x(item, text) AS (VALUES {rows}) SELECT s_suppkey, item, replace(text, '@', s_suppkey::VARCHAR) AS text, count(*) AS n FROM supplier, x GROUP BY ALL"


def _form(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        key = F.col("s_suppkey").cast("string")
        path = F.concat(key, F.lit(".tsx" if name == "jsx" else ".ts"))
        graph = code.file_graphs(g.read(spark, d, "supplier").select(path.alias("path"), F.replace(F.lit(FORMS[name]["text"]), F.lit("@"), key).alias("text")))
        labelled = F.concat(F.transform("nodes", lambda n: F.struct(n["id"].alias("id"), F.concat_ws(" ", n["kind"], n["name"]).alias("t"))), F.transform("subgraphs", lambda s: F.struct(s["id"].alias("id"), F.concat_ws(" ", F.lit("subgraph"), s["kind"]).alias("t"))))
        graph = graph.withColumn("names", F.map_from_entries(labelled))
        edges = F.transform("edges", lambda e: F.struct(F.lit("edges").alias("item"), F.concat_ws(" | ", F.element_at("names", e["src"]), e["label"], F.element_at("names", e["dst"])).alias("text")))
        nodes = F.transform("nodes", lambda n: F.struct(F.lit("nodes").alias("item"), F.concat_ws(" | ", n["kind"], n["name"], n["line"].cast("string"), F.when(n["unused"], "unused")).alias("text")))
        rows = graph.select(F.split("path", r"\.")[0].cast("long").alias("s_suppkey"), F.explode(F.concat(edges, nodes)).alias("x"))
        return rows.groupBy("s_suppkey", "x.item", "x.text").agg(F.count("*").alias("n"))

    return run


for _name in FORMS:
    QUERIES[f"form_{_name}"], ORACLE_SQL[f"form_{_name}"] = _form(_name), _form_sql(FORMS[_name])
