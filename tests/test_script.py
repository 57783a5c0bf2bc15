"""Script sources on small texts whose tables are known by hand."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.__main__ import main
from weftline.functions import naming, offsets
from weftline.functions.queries import highlight_queries, root_queries
from weftline.operators import files, reach
from weftline.sources import code
from weftline.sources.script import plugins
from weftline.sources.script.bind import analyse
from weftline.sources.script.flow import Graph, around, border, ceiling, diagram, highlight, part, tree
from weftline.sources.script.syntax import SyntaxFault, parse
from weftline.streaming import ingest


def ir(text, language="ts", module=True):
    return analyse(text, language, module)


def edge_list(text, language="ts"):
    return [(e["src"], e["label"], e["dst"]) for e in Graph(ir(text, language)).tables()["edges"]]


def names(text, language="ts"):
    return {(v["name"], v["scope"]) for v in ir(text, language)["variables"]}


@pytest.mark.parametrize(
    "text",
    [
        "a = b / c / d; x = /[/]\\/(?:)/g.test(y)",
        "for (;;) { break }\nouter: for (const x in y) continue outer",
        "let {a, b: [c, ...d], ...e} = f, g = async x => await x, h = async (i) => {}",
        "class A extends (B) { static #x = 1; static { this.y } get z() { return #x in this } async *[k]() { yield* 1 } }",
        "`a${`b${c}`}d` ; tag`x${y}`; a?.b?.[c]?.(d) ?? e; new a.b(c)(d); new new A()();",
        "if (a) b\nelse c\ndo x++; while (y) z",
        "import a, * as b from 'm'; export * as c from 'n'; export default function () {}",
        "({a, b = 1, [c]: d} = e); [x, , y] = z; ({async a() {}, get b() { return 1 }, async, get})",
        "var let_ = 0, of, async; async(1); x = a ? (b) : c => d",
    ],
)
def test_plain_scripts_parse(text):
    assert parse(text, "js").type == "Program"


@pytest.mark.parametrize(
    "text",
    [
        "interface A<T> extends B { x: T; y?(): void }\ntype C = { [K in keyof A]?: A[K] } | ((x: number) => string)",
        "function f<T extends object>(this: X, a?: T, ...b: Array<Map<string, T>>): a is T { return a as unknown as T }",
        "const g = <T,>(x: T): T => x; let u = a! + b!.c<D>(e); abstract class K { abstract m(): void; declare z: string }",
        "declare module 'x' { const y: number }\nenum E { A = 1 }\nexport type { A } from './a'; import type B from 'b'",
        "class P { constructor(private readonly a: string, public b = 1) {} [key: string]: any }",
    ],
)
def test_types_are_skipped(text):
    assert parse(text, "ts").type == "Program"


def test_jsx_names_are_references():
    t = ir("const A = () => <B.C x={y} {...z}>text {w} <></><div/></B.C>;", "jsx")
    assert [r["name"] for r in t["references"]] == ["A", "B", "y", "z", "w", "div"]


@pytest.mark.parametrize("text", ["let (", "a b", "'open", "`open", "if (x", "}", "(" * 5000])
def test_faults_are_reported(text):
    with pytest.raises(SyntaxFault):
        parse(text, "ts")


def test_offsets_are_utf16_units():
    (v,) = ir("/*\U0001f600*/ let é = 1")["variables"]
    assert v["id"] == "scope#0:é@11" and v["defs"][0]["name"]["column"] == 11


def test_scopes_hoist_and_shadow():
    text = "f(); function f(a) { if (a) { var b = 1; let c; { let c } } return b } try { } catch (e) { let e2 = e } class K { m() {} }"
    assert names(text) == {("f", "scope#0"), ("K", "scope#0"), ("a", "scope#1"), ("b", "scope#1"), ("c", "scope#2"), ("c", "scope#3"), ("e", "scope#5"), ("e2", "scope#5"), ("K", "scope#6")}


def test_unused_counts_reads_outside_the_own_body():
    flags = {v["name"]: v["unused"] for v in ir("function f() { f() } function g() {} g(); let a = 1; a = 2; let b = 1; b++; const h = () => h; missing;")["variables"] if v["scope"] == "scope#0"}
    assert flags == {"f": True, "g": False, "a": True, "b": False, "h": True, "missing": False}


def test_flags_owners_and_tests():
    refs = {(r["name"], r["at"]["offset"]): r for r in ir("const a = b.c(d); if (a) a2 = e; x += y;")["references"]}
    assert refs["b", 10]["receiver"] and refs["b", 10]["owners"] == ["scope#0:a@6"] and not refs["b", 10]["call"]
    assert refs["a", 22]["predicate_type"] == "IfStatement" and refs["x", 33]["read"] and refs["x", 33]["write"]


def test_var_gives_a_warning_and_no_edges():
    t = ir("var a = 1; let b = a;")
    assert [d["kind"] for d in t["diagnostics"]] == ["var-detected"] and edge_list("var a = 1; let b = a;") == []


def test_reads_after_branches_merge_the_writes():
    both = edge_list("let a = 0; if (c) { a = 1 } else { a = 2 } f(a);")
    one = edge_list("let a = 0; if (c) { a = 1 } f(a);")
    assert ("wr_ref_2", "read", "expr_stmt_43") in both and ("wr_ref_3", "read", "expr_stmt_43") in both and ("n_scope_0_a_4", "read", "expr_stmt_43") not in both
    assert ("wr_ref_2", "read", "expr_stmt_28") in one and ("n_scope_0_a_4", "read", "expr_stmt_28") in one


def test_switch_falls_through():
    text = "let a = 0; switch (k) { case 1: a = 1; case 2: a = 2; break; case 3: return_(); default: a = 4 } f(a);"
    found = edge_list(text)
    assert ("wr_ref_2", "fallthrough", "wr_ref_3") in found
    assert ("n_scope_0_a_4", "fallthrough", "wr_ref_5") in found  # the case before falls through without a write
    reads = {s for s, label, d in found if d == f"expr_stmt_{text.rindex('f(a)')}" and not s.startswith("n_scope_0_f")}
    assert reads == {"wr_ref_3", "wr_ref_5"}


def test_try_without_and_with_a_handler():
    assert ("n_scope_0_a_4", "read", "expr_stmt_43") not in edge_list("let a = 0; try { a = 1 } catch { a = 2 }   f(a);")
    assert ("n_scope_0_a_4", "read", "expr_stmt_41") in edge_list("let a = 0; try { a = 1 } finally { x() } f(a);")


def test_values_go_to_returns_throws_and_the_module():
    found = edge_list("function f(x) { if (x) { throw x } return x + f } export { f };")
    assert {d.split("_ref")[0] for _, _, d in found} == {"if_test_scope_1_16", "throw_use", "ret_use", "module_root"}


def test_renamed_imports_read_a_shared_node():
    text = "import { a as b } from 'm'; import { a as c } from 'm'; export { b, c };"
    found = edge_list(text)
    assert ("import_m__a", "read", "n_scope_0_b_14") in found and ("import_m__a", "read", "n_scope_0_c_42") in found


def test_diagram_wraps_owned_functions():
    text = diagram(Graph(ir("const f = (x) => { return x };\nf(1);\n")).tables(), False)
    assert text == """flowchart RL
  subgraph wrap_s_scope_1[" "]
    direction TB
    n_scope_0_f_6["f()<br/>L1"]
    subgraph s_scope_1["f()<br/>L1"]
      direction RL
      n_scope_1_x_11["x<br/>L1"]
      subgraph s_return_scope_0_f_6_19_27["return L1"]
        direction RL
        ret_use_ref_1["x<br/>L1"]
      end
    end
  end
  n_scope_1_x_11 -->|read| ret_use_ref_1
  n_scope_0_f_6 -->|read,call| expr_stmt_31
  expr_stmt_31["f()<br/>L2"]
  classDef nestL1 fill:#11192a,stroke:transparent;
  class wrap_s_scope_1 nestL1;
  classDef nestL2 fill:#1a2538,stroke:transparent;
  class s_scope_1 nestL2;
  classDef nestL3 fill:#243047,stroke:transparent;
  class s_return_scope_0_f_6_19_27 nestL3;
"""


def test_files_to_tables(spark, tmp_path):
    for name, text in {"a.ts": "const a = 1;\na;", "b.mjs": "x", "c.cjs": "y", "d.txt": "no", "e.js": "let (", "f.tsx": ""}.items():
        (tmp_path / name).write_text(text)
    table = code.analysed(code.read_files(spark, str(tmp_path))).cache()
    kinds = {r["path"].rsplit("/")[-1]: r["k"] for r in table.selectExpr("path", "get(scopes, 0).type AS k").collect()}
    assert kinds == {"a.ts": "module", "b.mjs": "module", "c.cjs": "global", "e.js": None}  # an empty file gives no row
    assert code.failures(table).count() == 1 and code.unused(table).count() == 0
    assert {r["id"] for r in code.graph_rows(code.graphs(table), "nodes").collect()} == {"n_scope_0_a_6", "expr_stmt_13", "n_scope_0_x_0", "n_scope_0_y_0", "expr_stmt_0"}
    assert '"error":null' in code.ir_json(table).where("path LIKE '%a.ts'").first()["json"]


def test_null_text_and_unknown_extension(spark):
    rows = spark.createDataFrame([("a.ts", None), ("b", "x"), (None, "x")], "path string, text string")
    found = {r["path"]: (r["error"] is None, len(r["scopes"])) for r in code.analysed(rows).collect()}
    assert found == {"a.ts": (True, 1), "b": (False, 0), None: (False, 0)}
    assert code.graphs(code.analysed(rows.limit(0))).count() == 0 == code.file_graphs(rows.limit(0)).count()


def test_one_pass_gives_the_same_graphs(spark):
    rows = spark.createDataFrame([("a.tsx", HOOKED), ("b.ts", "let (")], "path string, text string")
    steps = code.graphs(code.with_plugins(code.analysed(rows), ["react"])).orderBy("path").collect()
    assert code.file_graphs(rows, ["react"]).orderBy("path").collect() == steps


HOOKED = """import { useCallback, useMemo } from "react";
import { useState } from "react";
function App() {
  const [n, set] = useState(0);
  const inc = useCallback(() => set(n), [n]);
  const two = useMemo(() => n * 2, [n]);
  return inc(two);
}
"""


def test_react_plugin_takes_hooks_out():
    t = plugins.react(ir(HOOKED))
    assert {v["name"] for v in t["variables"] if v["scope"] == "scope#0"} == {"useState", "App"}
    (inc,) = [v for v in t["variables"] if v["name"] == "inc"]
    assert inc["defs"][0]["init_type"] == "ArrowFunctionExpression"
    assert not [r for r in t["references"] if r["name"] in plugins.HOOKS]
    assert [r["name"] for r in t["references"]].count("n") == 2  # the uses inside the functions; the lists of what they depend on are gone
    plain = ir("import { useMemo } from 'other'; const a = useMemo(() => 1);")
    assert plugins.react(plain) is plain


def test_plugins_by_name(spark):
    table = code.analysed(spark.createDataFrame([("a.tsx", HOOKED)], "path string, text string"))
    assert "inc()" in code.graphs(code.with_plugins(table, ["react"])).first()["diagram"]
    with pytest.raises(ValueError, match="nope"):
        code.with_plugins(table, ["react", "nope"])


def test_names_of_outputs():
    found = [naming.token(q) for q in root_queries("3, 3-9, 3:x, 3-9:x, L4, L4-6, y")]
    assert found == ["l3", "l3-9", "l3-x", "l3-9-x", "l4", "l4-6", "y"]
    assert naming.basename(root_queries("a, 7"), None, 1, 2, "x/y.ts") == "a+l7-b1-c2"
    assert naming.basename([], 1, 2, 3, "x/y.test.ts") == "y.test" and naming.radius(1, 2, 3) == "-a1-b2"
    assert naming.query_flags("a", 2, 2, None) == "-r a -C 2" and naming.query_flags(None, None, None, "") == "-H"


def test_bare_names_select_declarations(spark):
    rows = spark.createDataFrame([("a.ts", "let x = 1;\nx = 2;\nconst y = x;"), ("b.ts", "const x = 1;")], "path string, text string")
    nodes = files.keyed_nodes(code.graphs(code.analysed(rows)))
    ids = lambda text: {r["id"] for r in files.roots(nodes, text).collect()}
    assert ids("x") == {"a.ts\nn_scope_0_x_4", "b.ts\nn_scope_0_x_6"}
    assert ids("2") == {"a.ts\nwr_ref_1"}


def test_streamed_files_give_the_same_graphs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for k in range(2):  # the second run takes only what is new
        (tmp_path / "in" / f"{k}.ts").write_text(f"const a{k} = 1;")
        query = ingest.analyse_stream(spark, str(tmp_path / "in"), out, state)
        assert query.awaitTermination(60)
    found = code.graph_rows(spark.read.parquet(out), "nodes").select("name").collect()
    assert sorted(r["name"] for r in found) == ["a0", "a1"]


@pytest.mark.parametrize(
    ("text", "proxy", "found"),
    [
        ("const b = a.map((v) => v);", "call_proxy_10", [("call_proxy_10", "read", "n_scope_0_b_6"), ("n_scope_0_a_10", "read", "call_proxy_10")]),
        ("let b; b = a.map((v) => v);", "call_proxy_11", [("call_proxy_11", "read", "wr_ref_0"), ("n_scope_0_a_11", "read", "call_proxy_11")]),
        ("function f(a) { return a.map((v) => v) }", "call_proxy_16", [("n_scope_1_a_11", "read", "call_proxy_16")]),
        ("a.map((v) => v);", "expr_stmt_0", [("n_scope_0_a_0", "read", "expr_stmt_0")]),
        ("const b = f(a.map((v) => { const w = v; return w }));", "call_proxy_10", [("call_proxy_10", "read", "n_scope_0_b_6"), ("n_scope_1_v_19", "read", "n_scope_1_w_33")]),
    ],
)
def test_calls_around_function_arguments_stand_for_their_value(text, proxy, found):
    t = Graph(ir(text)).tables()
    held = {s["id"]: s for s in t["subgraphs"]}
    inner = next(s for s in t["subgraphs"] if s["argument"] is not None)
    assert inner["parent"] == proxy and inner["name"] == "a.map" and held[proxy]["kind"] == "call-proxy"
    assert set(found) <= {(e["src"], e["label"], e["dst"]) for e in t["edges"]}


def test_values_that_nothing_takes_have_no_proxy():
    t = Graph(ir("const {b} = a.map((v) => v); function f() { class K { x = a.map((w) => w) } }")).tables()
    assert [s["kind"] for s in t["subgraphs"] if s["kind"] == "call-proxy"] == []


def test_command_line(tmp_path, capsys):
    source = tmp_path / "a.ts"
    source.write_text("const a = 1;\nconst b = a;\nconst c = b;\nconst d = c;\nvar e;\n")
    run = lambda *args: (main([*args, str(source)]), capsys.readouterr())
    code_, out = run("-f", "stats", "-r", "b", "-A", "1")
    assert code_ == 0 and out.out.splitlines() == [f"1\t0\t{source}:2 b", f"0\t1\t{source}:3 c", "1\t1\t2 total"] and "L5:0" in out.err
    assert [e["src"] for e in json.loads(run("-f", "json")[1].out)["edges"]] == ["n_scope_0_a_6", "n_scope_0_b_19", "n_scope_0_c_32"]
    assert run("-r", "c", "-C", "0", "--mermaid-renderer", "dagre")[1].out == 'flowchart RL\n  %% pruning roots c=1 ancestors=0 descendants=0\n  n_scope_0_c_32["c<br/>L3"]\n'
    assert "## Query\n\n```\n-r b -C 10\n```" in run("-f", "markdown", "-r", "b")[1].out
    assert run("--out-dir", str(tmp_path / "x"), "-r", "b", "-B", "2")[0] == 0 and (tmp_path / "x" / "b-b2.mmd").exists()
    assert json.loads(run("-f", "ir", "-r", "b")[1].out)["variables"][0]["name"] == "a"
    assert main([str(tmp_path / "none.ts")]) == 1 and main([str(tmp_path / "a.txt")]) == 1
    for wrong in (["-r", "", str(source)], [], ["--plugin", "none", str(source)], ["-A", "-1", str(source)], ["-o", "x", "--out-dir", "y", str(source)]):
        with pytest.raises(SystemExit) as stop:
            main(wrong)
        assert stop.value.code == 2


def test_a_part_keeps_the_subgraphs_of_its_nodes():
    t = Graph(ir("function f(x) { return x } function g() {}")).tables()
    own = part(t, around(t, {"n_scope_1_x_11"}, 1, 0))
    assert [s["kind"] for s in own["subgraphs"]] == ["function", "return"] and [e["label"] for e in own["edges"]] == ["read"]
    assert tree(own)[0]["elements"][1]["elements"][0]["kind"] == "ReturnArgumentReference"


def test_deep_files_give_tables(spark):
    """Long sums and call chains, deep arrays and else-ifs are analysed; what fails in any other way gives a row with an error."""
    from weftline.sources import code

    texts = {
        "sum": "const s = " + " + ".join(f'"a{i}"' for i in range(10000)) + ";", "chain": "x" + ".a()" * 5000 + ";",
        "arrays": "const a = " + "[" * 2000 + "]" * 2000 + ";", "ifs": "let v = 1;\n" + " else ".join(f"if (v === {i}) {{ f({i}); }}" for i in range(600)), "bad": "const = ;",
    }
    rows = spark.createDataFrame([(f"{k}.ts", t) for k, t in texts.items()], "path string, text string")
    out = {r["path"]: r for r in code.analysed(rows).select("path", "error", "scopes.id").collect()}
    assert out["bad.ts"]["error"] and all(out[f"{k}.ts"]["error"] is None and out[f"{k}.ts"]["id"] for k in texts if k != "bad")
    got = {r["path"]: r for r in code.file_graphs(rows.where("path <> 'ifs.ts'")).collect()}
    assert len(got) == 4 and len(got["chain.ts"]["edges"]) == 1


def test_a_failing_file_fails_no_job(monkeypatch):
    from weftline.sources import code
    from weftline.sources.script import bind

    monkeypatch.setattr(bind, "analyse", lambda *a: 1 / 0)
    row = code._analyse({"path": "a.ts", "language": "ts", "module": True, "text": "x"})
    assert "ZeroDivisionError" in row["error"] and row["scopes"] == []


def test_empty_subgraphs_have_a_stand_in():
    t = Graph(ir("const f = () => {};\n")).tables()
    plain, layered = diagram(t, False).split("\n"), diagram(t).split("\n")
    (empty,) = [s["id"] for s in t["subgraphs"] if s["kind"] == "function"]
    assert plain[0] == "flowchart RL" and layered[1] == "flowchart RL" and layered[0].startswith("%%{init")
    added = [line.strip() for line in layered if line not in plain]
    assert added[1:] == [f'elk_empty_{empty}["No nodes"]', "classDef elkEmptyPlaceholder fill:transparent,stroke:transparent;", f"class elk_empty_{empty} elkEmptyPlaceholder;"]
    assert [line for line in layered if line not in added and line.strip() not in added] == plain


def limited(text, function, block):
    return Graph(ir(text), ceiling(function, block)).tables()


NESTED_IFS = "const a = 1, b = 2, c = 3;\nif (a) {\n  let v = b;\n  if (b) {\n    v = c;\n    g(v);\n  }\n  h(v);\n}\n"


def test_depth_limits_put_a_stub_in_the_nearest_subgraph():
    t = limited(NESTED_IFS, 10, 1)
    stub = "beyond_depth_s_scope_1"
    assert [n["parent"] for n in t["nodes"] if n["id"] == stub] == ["s_scope_1"]
    assert not any(n["id"].startswith("wr_") or n["parent"] == "s_scope_2" for n in t["nodes"])
    name = {n["id"]: n["name"] for n in t["nodes"]}
    into = {name[e["src"]] for e in t["edges"] if e["dst"] == stub}
    assert into == {"b", "c", "g", "v"} and {name[e["dst"]] for e in t["edges"] if e["src"] == stub} == {"h()"}
    text = diagram(t).splitlines()
    assert f"    {stub}((...))" in text and f"  class {stub} boundaryStub;" in text
    assert all(("-.->" in line) == (stub in line) for line in text if "->|" in line)
    assert limited(NESTED_IFS, 10, 2) == limited(NESTED_IFS, 0, 9) == Graph(ir(NESTED_IFS)).tables()


def test_depth_limits_at_the_top_leave_nothing_to_stand_in():
    t = limited(NESTED_IFS, 10, 0)
    assert [s["id"] for s in t["subgraphs"]] == []
    assert [(e["src"], e["dst"]) for e in t["edges"]] == [("n_scope_0_a_6", "module_root")]


def test_a_function_beyond_the_limit_is_its_node():
    t = limited("const k = 1;\nfunction f(x) {\n  return x + k;\n}\nf(k);\n", 0, 10)
    assert {(e["src"].split("_")[3], e["dst"].split("_")[0]) for e in t["edges"]} == {("k", "n"), ("f", "expr"), ("k", "expr")}
    assert t["subgraphs"] == []


@pytest.mark.parametrize("text, taker", [("const r = xs.map(i => i + k);", "n_scope_1_r_"), ("let r; r = xs.map(i => i + k);", "wr_ref_"), ("xs.forEach(i => g(i + k));", None), ("return xs.map(i => i + k);", None)])
def test_calls_of_functions_beyond_the_limit_are_the_stub(text, taker):
    t = limited("const k = 1, xs = [];\nfunction outer() {\n  " + text + "\n}\n", 1, 10)
    stub = "beyond_depth_s_scope_1"
    assert not [s for s in t["subgraphs"] if s["kind"] == "call-proxy"] and not [n for n in t["nodes"] if n["kind"] == "SyntheticExpressionStatement"]
    assert {e["src"].split("_")[3] for e in t["edges"] if e["dst"] == stub and e["src"].startswith("n_scope_0")} >= {"k", "xs"}
    assert [e["dst"].startswith(taker) for e in t["edges"] if e["src"] == stub] == ([True] if taker else [])


@pytest.mark.parametrize("text, inside", [("for (const x of y) { x; }", "for"), ("switch (y) { case 1: { y; } }", "switch"), ("try { y } catch (e) { e }", "catch"), ("while (y) { y }", "while")])
def test_a_statement_of_two_scopes_counts_once(text, inside):
    t = limited("function f(y) {\n" + text + "\n}\n", 10, 1)
    assert inside in {s["kind"] for s in t["subgraphs"]} and not [n for n in t["nodes"] if n["kind"] == "SyntheticBeyondDepth" and inside != "switch"]
    assert [n["parent"] for n in limited("function f(y) {\n" + text + "\n}\n", 10, 0)["nodes"] if n["kind"] == "SyntheticBeyondDepth"]


CHAIN = "const a = 1;\nconst b = a;\nconst c = b;\nconst d = a;\nfunction f(x) {\n  return x;\n}\n"


def test_highlights():
    t = Graph(ir(CHAIN)).tables()
    id = {n["name"]: n["id"] for n in t["nodes"] if n["id"].startswith("n_")}
    path = highlight(t, [("path", "c..a", {id["c"]}, {id["a"]})])
    assert path == {"ids": [id["a"], id["b"], id["c"]], "points": [], "warnings": []}
    for way, found in (("a", "bc"), ("b", "ab"), ("c", "abc")):
        assert highlight(t, [(way, "", {id["b"]}, set())])["ids"] == [id[k] for k in found]
    none = highlight(t, [("path", "c..d", {id["c"]}, {id["d"]}), ("path", "c..z", {id["c"]}, set()), ("a", "z..+a", set(), set()), ("point", "z", set(), set())])
    assert none == {"ids": [], "points": [], "warnings": ["no path for the highlight c..d", "no node matches the highlight c..z", "no node matches the highlight z..+a"]}
    text = diagram(t, marked=highlight(t, [("point", "b", {id["b"]}, set()), ("point", "", {"s_scope_1"}, set())]))
    assert f"  style {id['b']} fill:#facc15,stroke:#facc15,color:#0a0a0a;\n  linkStyle 0,1 stroke:#facc15,stroke-width:2px;\n" in text
    assert "  class s_scope_1 highlightSubgraph;\n" in text and "style" not in diagram(t, marked=highlight(t, []))


def test_styles_follow_depth_and_ends():
    t = Graph(ir("var v = 1;\nfunction f() {\n  [1].map(i => { return i; });\n}\n")).tables()
    text = diagram(t, theme="light")
    assert "  classDef varNode stroke-dasharray:5 5;\n  class n_scope_0_v_4 varNode;\n" in text
    assert "  classDef nestL1 fill:#f4f7fb,stroke:transparent;\n  class wrap_s_scope_1 nestL1;\n  classDef nestL2 fill:#e8eff7,stroke:transparent;\n  class s_scope_1 nestL2;\n" in text
    ends = {"nodes": [], "subgraphs": t["subgraphs"], "edges": [{"src": "s_scope_1", "dst": "s_scope_2", "label": "read"}, {"src": "s_scope_2", "dst": "x", "label": "read"}]}
    assert "  classDef edgeTargetSubgraph stroke:#888;\n  class s_scope_2 edgeTargetSubgraph;\n  classDef edgeSourceSubgraph stroke:#888;\n  class s_scope_1 edgeSourceSubgraph;\n" in diagram(ends)


def test_the_border_of_a_part():
    t = Graph(ir(CHAIN)).tables()
    b = next(n["id"] for n in t["nodes"] if n["name"] == "b")
    hints = border(t, {b}, 1, 1)
    assert [(h["inside"], h["direction"], h["label"]) for h in hints] == [(b, "out", ""), (b, "in", "read")]
    assert border(t, {b}, 0, 0) == [] and "  boundary_stub_2 -.->|read| " + b in diagram(part(t, {b}) | {"boundary": hints})


def test_command_line_depth_highlight_and_notices(tmp_path, capsys):
    source = tmp_path / "a.ts"
    source.write_text(CHAIN + "if (a) {\n  if (b) {\n    f(c);\n  }\n}\n")
    run = lambda *args: (main([*args, str(source)]), capsys.readouterr())
    assert "beyond_depth" not in run()[1].out and "beyond_depth" in run("--depth", "1")[1].out
    assert "beyond_depth" in run("--depth", "1", "--depth-function", "5")[1].out and "beyond_depth" not in run("--depth", "1", "--depth-block", "2")[1].out
    assert run("-r", "b", "-C", "1", "-H")[1].out.count("  style ") == 1 and "linkStyle 0,1,2 " in run("-r", "b", "-C", "1", "--highlight")[1].out
    _, out = run("-Hc..d,none..+a,L2")
    assert "no path for the highlight c..d" in out.err and "no node matches the highlight none..+a" in out.err and "'L2' is ambiguous" in out.err and "ask for '2'" in out.err
    assert "#fde047" in run("--highlight=a", "--color-theme", "light")[1].out
    assert "is taken as a folder" in run("--out-dir", str(tmp_path / "x.mmd"))[1].err and "written: " in run("-v")[1].err
    assert "-r b -C 10 -H --depth-block 1" in run("-f", "markdown", "-r", "b", "-H", "--depth-block", "1")[1].out
    for wrong in (["-Ha..b..c"], ["-H,"], ["--depth", "x"]):
        with pytest.raises(SystemExit):
            main([*wrong, str(source)])


def test_highlights_and_ambiguous_roots_over_many_files(spark):
    rows = spark.createDataFrame([("a.ts", "const a = 1;\nconst L1 = a;\nconst c = L1;"), ("b.ts", "const a = 1;\nconst c = a;")], "path string, text string")
    graph = code.file_graphs(rows).persist()
    nodes, edges = files.keyed_nodes(graph), files.keyed_edges(graph)
    short = lambda rows: {tuple(r["id"].split("\n")[:1]) + (r["id"].split("_")[3],) for r in rows}
    assert short(files.roots(nodes, "L1").collect()) == {("a.ts", "L1"), ("b.ts", "a")}
    marks = files.highlighted(nodes, edges, "c..a").persist()
    assert short(marks.collect()) == {("a.ts", "a"), ("a.ts", "L1"), ("a.ts", "c"), ("b.ts", "a"), ("b.ts", "c")} and files.marked_edges(edges, marks).count() == 3
    marks = files.highlighted(nodes, edges, "L1,c..+b")
    assert {r["point"] for r in marks.collect() if "L1" in r["id"]} == {True} and marks.where("point").count() == 2
    assert [q for q, _ in highlight_queries("a,b..c")] == ["a", "b..c"]


def broadcasts(df):
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


def test_degrees_are_joined_without_a_broadcast(spark, sf):
    from weftline.plans.registry import QUERIES

    assert not broadcasts(QUERIES["script_degrees"](spark, sf))


def test_statistics_are_joined_without_a_broadcast(spark, sf):
    from weftline.plans.registry import QUERIES

    assert not broadcasts(QUERIES["script_stats"](spark, sf))
    rows = spark.createDataFrame([("a.ts", "const a = 1;\nconst b = a;")], "path string, text string")
    assert {tuple(r)[2:] for r in files.stats(code.file_graphs(rows)).collect()} == {("a.ts:2 unused b", 0, 1), ("a.ts:1 a", 1, 0)}


def test_large_highlights_are_searched_without_a_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([("a.ts", "const a = 1;\nconst L1 = a;\nconst c = L1;"), ("b.ts", "const a = 1;\nconst c = a;")], "path string, text string")
    graph = code.file_graphs(rows).persist()
    plans = []
    for module in (files, reach):
        monkeypatch.setattr(module, "settled", lambda df, f=module.settled: (plans.append(broadcasts(df)), f(df))[1])
    monkeypatch.setattr(reach, "BROADCAST_IDS", 0)
    marks = files.highlighted(files.keyed_nodes(graph), files.keyed_edges(graph), "L1,c..a,c..+b")
    assert len(plans) > 10 and not any(plans) and not broadcasts(marks) and marks.count() == 5
    end = spark.createDataFrame([(1,)], "id long")
    assert not broadcasts(reach.between(end, end, spark.createDataFrame([(2, 3)], "src long, dst long")))


def test_edges_of_points_are_marked_without_a_broadcast(spark):
    rows = spark.createDataFrame([("a.ts", "const a = 1;\nconst b = a;\nconst c = b;\nconst d = c;")], "path string, text string")
    graph = code.file_graphs(rows).persist()
    edges = files.keyed_edges(graph)
    found = files.marked_edges(edges, files.highlighted(files.keyed_nodes(graph), edges, "b"))
    assert not broadcasts(found) and found.count() == 2


@pytest.mark.parametrize("text, host, taker", [("const r = xs.map(f => f + 1).filter(g => g);", "call_proxy_", "n_scope_0_r_"), ("let r; r = xs.map(f => f + 1).filter(g => g);", "call_proxy_", "wr_ref_"), ("xs.map(f => f + 1).filter(g => g);", "expr_stmt_", None)])
def test_each_call_of_a_chain_has_its_own_subgraph(text, host, taker):
    t = Graph(ir("const xs = [];\n" + text)).tables()
    name = {s["id"]: s["name"] for s in t["subgraphs"] if s["kind"] == "call-proxy"}
    outer, inner = (next(i for i, n in name.items() if n == head) for head in ("xs.map().filter()", "xs.map()"))
    assert len(name) == 2 and outer.startswith(host) and inner.startswith("call_proxy_") and inner.count("_") == 3
    assert {s["name"]: s["parent"] for s in t["subgraphs"] if s["kind"] == "function"} == {"xs.map": inner, "xs.map().filter": outer}
    reads = [(e["src"], e["dst"]) for e in t["edges"]]
    assert (inner, outer) in reads and ("n_scope_0_xs_6", inner) in reads and ("n_scope_0_xs_6", outer) not in reads
    assert [d.startswith(taker) for s, d in reads if s == outer] == ([True] if taker else [])


def test_calls_without_functions_have_no_subgraph_of_their_own():
    t = Graph(ir("const xs = [];\nconst r = xs.slice(1).map(f => f).join();\nconst s = go(xs.map(g => g));")).tables()
    assert sorted(s["name"] for s in t["subgraphs"] if s["kind"] == "call-proxy") == ["go()", "xs.slice().map()", "xs.slice().map().join()"]


def test_the_test_of_a_ternary_stands_in_its_first_arm():
    t = Graph(ir("const c = 1, a = 2;\nconst r = c ? a : c;")).tables()
    (test,) = [n for n in t["nodes"] if n["kind"] == "SyntheticConditionalTest"]
    assert next(s for s in t["subgraphs"] if s["id"] == test["parent"])["kind"] == "consequent"


def test_values_of_a_bare_ternary_have_no_edges_but_into_calls_around_functions():
    reads = lambda text: {(e["src"].split("_")[3], e["dst"].split("_")[0]) for e in Graph(ir("const c = 1, a = 2, b = 3;\n" + text)).tables()["edges"] if e["src"].startswith("n_scope_0")}
    assert reads("c ? a() : b;") == reads("(c ? a : b());") == {("c", "ternary")}
    assert reads("go(c ? a : b);") == {("c", "ternary"), ("a", "expr"), ("b", "expr"), ("go", "expr")}
    assert ("a", "expr") in reads("c ? a.map(x => x) : b;") and ("b", "expr") not in reads("c ? a.map(x => x) : b;")


@pytest.mark.parametrize(
    "text, language, globals",
    [
        ("function f() { const x = new.target; return x; }", "ts", {"new", "target"}), ("const m = import.meta;", "ts", {"import", "meta"}),
        ("import x from 'y' with { type: 'json', 'quoted': 'a' };", "ts", {"type"}), ("export * as all from 'y';", "ts", {"all"}), ("export * from 'y';", "ts", set()),
        ("const x = <svg:rect />;", "jsx", {"svg", "rect"}), ("const x = <a.b />;", "jsx", {"a"}),
    ],
)
def test_names_that_bind_to_nothing_are_globals(text, language, globals):
    assert {v["name"] for v in ir(text, language)["variables"] if v["defs"][0]["type"] == "ImplicitGlobalVariable"} == globals


@pytest.mark.parametrize("text", ["const x = 1;\nexport = x;", "import x = require('y');", "import x = A.B;", "export as namespace N;", "type T = import('y');", "type T = import('y').Z<number>[];", "type T = ?number;", "type T = !number;"])
def test_typed_forms_without_values_have_no_edges(text):
    t = Graph(ir(text)).tables()
    assert t["edges"] == [] and {n["name"] for n in t["nodes"]} <= {"x"}


def test_values_with_type_arguments_and_with_statements():
    assert [e[:2] for e in edge_list("const f = 1;\nconst g = f<string>;\nconst h = [f<A, B<C>>, f<D>];")] == [("n_scope_0_f_6", "read")] * 2
    assert [e[0] for e in edge_list("const a = 1, b = 2;\nconst c = a < b;\nconst d = (a < b, b > a);")] == ["n_scope_0_a_6", "n_scope_0_b_13"] * 2
    t = Graph(ir("with (a) {\n  b;\n}\n", "js", False)).tables()
    assert [(e["src"], e["dst"]) for e in t["edges"]] == [("n_scope_0_a_6", "module_root"), ("n_scope_0_b_13", "expr_stmt_13")]
    assert [(s["kind"], s["line"], s["end_line"]) for s in t["subgraphs"]] == [("block", 1, 3)]


def test_offsets_in_units_and_bytes(spark):
    text = "aé\n😀b\nç😀"
    wide = text.encode("utf-16-be")
    n = len(wide) // 2
    cases = [(a, b) for a in range(n + 2) for b in range(n + 3)]
    down = lambda k: k - (k in (4, 9))  # noqa: E731  inside a character
    rows = spark.createDataFrame([(text, a, b) for a, b in cases], "t string, a int, b int")
    t, a, b = F.col("t"), F.col("a"), F.col("b")
    for r in rows.select("a", "b", offsets.slice_units(t, a, b).alias("part"), offsets.unit_to_byte(t, b).alias("byte")).collect():
        assert r["part"] == wide[2 * down(r["a"]) : max(2 * down(r["a"]), 2 * down(r["b"]))].decode("utf-16-be")
        assert r["byte"] == len(wide[: 2 * down(r["b"])].decode("utf-16-be").encode())
    whole = range(len(text.encode()) + 4)
    for r in spark.createDataFrame([(text, x) for x in whole], "t string, x int").select("x", offsets.span_of_byte(t, F.col("x")).alias("s")).collect():
        before, more = text.encode()[: r["x"]].decode(errors="ignore"), max(r["x"] - len(text.encode()), 0)
        units = lambda s: len(s.encode("utf-16-be")) // 2
        assert tuple(r["s"]) == (1 + before.count("\n"), units(before.rsplit("\n", 1)[-1]) + more, units(before) + more)
