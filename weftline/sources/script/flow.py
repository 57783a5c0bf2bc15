"""The reference graph of one analysed file: nodes, subgraphs and edges, and their diagram text.

A write is a node of its own; a read goes from the writes that can reach it (merged over the arms of a branch) to what takes
the value: the owner's latest write, a test, a return, throw or statement node, or else the module. ``var`` variables are
nodes without edges. Edge order is production order; an edge seen before is left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

FUNCTION_TYPES = {"FunctionExpression", "ArrowFunctionExpression"}
#: declaration kind or definition type to node kind: fixed values
KINDS = {"let": "LetBinding", "const": "ConstBinding", "var": "VarBinding", "using": "UsingBinding", "FunctionName": "FunctionDeclaration", "ClassName": "ClassDeclaration", "Parameter": "FormalParameter",
         "CatchClause": "CatchParameter", "ImplicitGlobalVariable": "SyntheticImplicitGlobal", "default": "DefaultImportBinding", "namespace": "NamespaceImportBinding", "named": "NamedImportBinding"}
#: statement type to anchor (id prefix, node kind, name): fixed values
ANCHORS = {"ForStatement": ("for_test", "SyntheticForStatementHeader", "for ()"), "ForOfStatement": ("for_test", "SyntheticForOfStatementHeader", "for ()"), "ForInStatement": ("for_test", "SyntheticForInStatementHeader", "for ()"),
           "WhileStatement": ("while_test", "SyntheticWhileStatementTest", "while ()"), "DoWhileStatement": ("do_while_test", "SyntheticDoWhileStatementTest", "do while ()"),
           "IfStatement": ("if_test", "SyntheticIfStatementTest", "if ()"), "SwitchStatement": ("switch_discriminant", "SyntheticSwitchStatementDiscriminant", "switch ()"),
           "ConditionalExpression": ("ternary_test", "SyntheticConditionalTest", "ternary ?:")}


def plain(name: str) -> str:
    """Each UTF-16 unit outside [A-Za-z0-9_] becomes one underscore."""
    return re.sub("[^A-Za-z0-9_]", lambda m: "_" * (1 + (ord(m.group()) > 0xFFFF)), name)


def control_kind(s: dict) -> str:
    if s["type"] != "block":
        return s["type"]
    p, k = s["parent_type"], s["key"]
    if p == "TryStatement":
        return "try" if k == "block" else "finally"
    if p == "IfStatement":
        return "if" if k == "consequent" else "else"
    if p == "ConditionalExpression":
        return k
    return {("SwitchStatement", "cases"): "case", ("WhileStatement", "body"): "while", ("DoWhileStatement", "body"): "do-while"}.get((p, k), "block")


def container(s: dict) -> str | None:
    """The key that the arms of one branching statement share."""
    p, k = s["parent_type"], s["key"]
    if s["block_type"] == "SwitchCase":
        return f"switch:{s['upper']}:{s['parent_offset']}"
    if p == "IfStatement" and k in ("consequent", "alternate"):
        root = s["chain_root_offset"]
        return f"if:{s['upper']}:{s['parent_offset'] if root is None else root}"
    if p == "ConditionalExpression" and k != "test":
        return f"ternary:{s['upper']}:{s['parent_offset']}"
    return f"try:{s['upper']}:{s['parent_offset']}" if p == "TryStatement" and k in ("block", "handler") else None


#: what a block counts as by its statement, for depth limits: fixed values
NESTING = {"IfStatement": "if", "ForStatement": "for", "ForInStatement": "for", "ForOfStatement": "for", "WhileStatement": "while", "DoWhileStatement": "while",
           "TryStatement": "try-catch-finally", "CatchClause": "try-catch-finally", "SwitchStatement": "switch"}
NESTED = ("function", "if", "for", "while", "switch", "try-catch-finally", "block")


def ceiling(function: int, block: int) -> dict[str, int]:
    """Depth limits by kind: one for functions, one for all kinds of blocks."""
    return {kind: function if kind == "function" else block for kind in NESTED}


def nesting(s: dict) -> str | None:
    """The kind of nesting that a scope counts as, if any."""
    if s["type"] == "block":
        return NESTING.get(s["parent_type"], "block")
    return {"function": "function", "for": "for", "switch": "switch", "catch": "try-catch-finally"}.get(s["type"])


def collapsed(scopes: list[dict], limits: dict[str, int]) -> dict[str, str]:
    """For each scope that a limit leaves out, the outermost one left out around it.

    A statement that makes two scopes counts once: ``for`` and ``catch`` by their body, ``switch`` by itself and not by its cases."""
    depth: dict[str | None, dict[str, int]] = {None: dict.fromkeys(NESTED, 0)}
    out: dict[str, str] = {}
    for s in scopes:  # pre-order: a parent comes first
        kind, own = nesting(s), depth[s["upper"]]
        if kind and s["upper"] and s["type"] not in ("for", "catch") and s["block_type"] != "SwitchCase":
            own = own | {kind: own[kind] + 1}
        depth[s["id"]] = own
        if s["upper"] in out:
            out[s["id"]] = out[s["upper"]]
        elif kind and own[kind] > limits[kind]:
            out[s["id"]] = s["id"]
    return out


class Graph:
    """``limits`` (see ``ceiling``) leaves out scopes that are nested deeper. What stands for such a scope is its function's
    node, else a stub in the nearest subgraph around it; at the top nothing does, and its edges go."""

    def __init__(self, ir: dict, limits: dict[str, int] | None = None) -> None:
        self.scopes = {s["id"]: s for s in ir["scopes"]}
        self.variables = {v["id"]: v for v in ir["variables"]}
        self.references = ir["references"]
        self.key = {i: container(s) for i, s in self.scopes.items()}
        self.arms: dict[str, list[dict]] = {}
        for i, k in self.key.items():
            if k:
                self.arms.setdefault(k, []).append(self.scopes[i])
        self.chain: dict[str, list[str]] = {}
        for i, s in self.scopes.items():  # pre-order: a parent comes first
            self.chain[i] = [i, *(self.chain[s["upper"]] if s["upper"] else [])]
        self.writes: dict[str, list[dict]] = {}
        for r in self.references:
            if r["write"] and not r["init"] and r["resolved"] in self.variables:
                self.writes.setdefault(r["resolved"], []).append(r)
        self.at = {v: [r["at"]["offset"] for r in w] for v, w in self.writes.items()}
        self.do_bodies = {s["parent_offset"]: s for s in self.scopes.values() if s["parent_type"] == "DoWhileStatement" and s["key"] == "body"}
        firsts = ((v["id"], v["defs"][0]) for v in self.variables.values())
        self.declared_at = {d["name"]["offset"]: i for i, d in firsts if d["type"] == "Variable" and d["declaration_kind"] != "var"}
        self.write_at = {r["at"]["offset"]: r for w in self.writes.values() for r in w}
        self.owner = self.function_owners()
        self.nodes: dict[str, dict] = {}
        self.subgraphs: dict[str, dict] = {}
        self.edges: dict[tuple[str, str, str], None] = {}
        self.anchors: dict[tuple[str, int], str] = {}
        self.proxies: dict[str, list[tuple[int, int, str, str | None]]] = {"owner": [], "return": []}
        self.hidden = collapsed(ir["scopes"], limits) if limits else {}
        self.stand_ins: dict[str, str | None] = {}
        self.hidden_tests: dict[int, str] = {}
        self.statement_nodes: dict[int, str] = {}
        self.innermost: dict[str, tuple[int, str]] = {}
        arms = (self.scopes[s["upper"]] for s in self.scopes.values() if s["callback"] and s["callback"]["kind"] == "statement" and s["upper"])
        self.calling_arms = {(s["block"]["offset"], s["end"]) for s in arms if s["parent_type"] == "ConditionalExpression" and s["key"] in ("consequent", "alternate")}
        self.called = {r["statement_at"]["offset"] for r in self.references if r["statement_at"] and self.to_statement(r)}
        self.place_scopes()
        self.set_edges()
        self.read_edges()
        self.import_nodes()

    # elements ---------------------------------------------------------------------------------------------------
    def function_owners(self) -> dict[str, dict]:
        bodies = {s["block"]["offset"]: s["id"] for s in self.scopes.values() if s["type"] == "function"}
        out = {}
        for v in self.variables.values():
            for d in v["defs"]:
                at = d["node"]["offset"] if d["type"] == "FunctionName" else d["init_offset"] if d["init_type"] in FUNCTION_TYPES else None
                if at in bodies:
                    out.setdefault(bodies[at], v)
        return out

    def node(self, id: str, kind: str, name: str, line: int, parent: str | None, end_line: int | None = None, unused: bool = False, **more) -> str:
        row = {"id": id, "kind": kind, "name": name, "line": line, "end_line": end_line if end_line != line else None, "parent": parent, "unused": unused, "declaration_kind": None, "init_is_function": False, "imported_name": None, "jsx": False}
        self.nodes.setdefault(id, row | more)
        return id

    def subgraph(self, id: str, kind: str, line: int, end_line: int, parent: str | None, **more) -> str:
        row = {"id": id, "kind": kind, "line": line, "end_line": end_line, "parent": parent, "owner": None, "name": None, "case_test": None, "has_else": False, "argument": None}
        self.subgraphs.setdefault(id, row | more)
        return id

    def home(self, scope: str) -> str | None:
        return "s_" + plain(scope) if self.scopes[scope]["upper"] else None

    def place_scopes(self) -> None:
        for s in self.scopes.values():
            if s["id"] in self.hidden:
                if self.hidden[s["id"]] == s["id"]:
                    self.stand_in(s)
                continue
            if s["upper"]:
                self.place(s)
            for test in (s["parent_type"] if s["type"] == "block" else None, s["block_type"]):
                if test in ANCHORS and (test in ("SwitchStatement",) and s["type"] == "switch" or s["type"] == "for" and test == s["block_type"] or s["type"] == "block" and test == s["parent_type"] and test in ("WhileStatement", "DoWhileStatement")):
                    loop = s["type"] != "block"
                    line = s["block"]["line"] if loop else s["parent_end_line"] if test == "DoWhileStatement" else s["parent_line"]
                    if test != "DoWhileStatement":
                        self.anchor(test, s["upper"], s["block"]["offset"] if loop else s["parent_offset"], line, self.home(s["id"]))
            if s["type"] == "block" and s["parent_type"] == "IfStatement" and s["key"] == "consequent":
                self.anchor("IfStatement", s["upper"], s["parent_offset"], s["parent_line"], self.home(s["id"]))
            for v in s["variables"]:
                self.variable_node(self.variables[v], self.home(s["id"]))
        for v, writes in self.writes.items():
            d = self.variables[v]["defs"][0]
            if d["declaration_kind"] != "var":
                for r in (r for r in writes if r["scope"] not in self.hidden):
                    self.node("wr_" + plain(r["id"]), "WriteReference", r["name"], r["at"]["line"], self.home(r["scope"]), declaration_kind=d["declaration_kind"])
        for s in (s for s in self.scopes.values() if s["id"] not in self.hidden):
            for j in s["abrupt"]:
                name = " ".join(filter(None, (j["type"], j["target"])))
                self.node(f"bc_{j['type']}_{j['offset']}", f"Synthetic{j['type'].capitalize()}Statement", name, j["line"], self.home(s["id"]))

    def stand_in(self, s: dict) -> None:
        """What edges into a scope beyond the limit end at; a call around it takes it for its value."""
        around = next((i for i in self.chain[s["id"]][1:] if i not in self.hidden and self.home(i)), None)
        if s["id"] in self.owner:
            own = "n_" + plain(self.owner[s["id"]]["id"])
        elif around is None:
            own = None
        else:
            box = self.subgraphs[self.home(around)]
            own = self.node(f"beyond_depth_{plain(box['id'])}", "SyntheticBeyondDepth", "...", box["line"], box["id"], box["end_line"])
        self.stand_ins[s["id"]] = own
        if own is None:
            return
        if s["type"] == "block" and s["parent_offset"] is not None:
            self.hidden_tests[s["parent_offset"]] = own
        c = s["callback"]
        if c and c["kind"] == "statement":
            self.statement_nodes[c["target_offset"]] = own
        elif c:
            self.stands_for(c, own)

    def anchor(self, test: str, upper: str, offset: int, line: int, parent: str | None) -> None:
        prefix, kind, name = ANCHORS[test]
        self.anchors[test, offset] = self.node(f"{prefix}_{plain(upper)}_{offset}", kind, name, line, parent)

    def place(self, s: dict) -> None:
        parent, key, kind = self.home(s["upper"]), self.key[s["id"]], control_kind(s)
        if key and key.split(":")[0] in ("if", "ternary"):
            arms = self.arms[key]
            ternary = key.startswith("ternary")
            if ternary or len(arms) > 1:
                offset = key.rsplit(":", 1)[1]
                name = f"cont_{'ternary' if ternary else 'if'}_{plain(s['upper'])}_{offset}"
                first = arms[0]
                if name not in self.subgraphs:
                    line = min(a["parent_line"] for a in arms)
                    parent = self.subgraph(name, "conditional-container" if ternary else "if-else-container", line, max(a["end_line"] for a in arms), parent, has_else=any(a["key"] == "alternate" for a in arms))
                    if ternary:
                        self.anchor("ConditionalExpression", s["upper"], first["parent_offset"], first["parent_line"], self.home(next((a for a in arms if a["key"] == "consequent"), first)["id"]))
                parent = name
        line, owner, name, c = s["block"]["line"], None, None, s["callback"]
        if c:
            name = c["callee"]
            host = self.proxy(c, parent)
            parent = self.of_chain(c, host, parent) if host else parent
        if kind == "function" and s["id"] in self.owner:
            v = self.owner[s["id"]]
            owner, name, line = "n_" + plain(v["id"]), v["name"], v["defs"][0]["name"]["line"]
        if kind == "class":
            held = next((v for v in (self.variables[x] for x in s["variables"]) if v["defs"][0]["type"] == "ClassName"), None)
            name = held["name"] if held else None
        if kind == "if":
            line = s["parent_line"]
        self.subgraph(self.home(s["id"]), kind, line, s["end_line"], parent, owner=owner, name=name, case_test=s["case_test"], argument=c["index"] if c else None)

    def to_statement(self, r: dict) -> bool:
        """Whether a read ends in the node of its statement."""
        v = self.variables.get(r["resolved"])
        return bool(v and v["defs"][0]["declaration_kind"] != "var" and not r["write"] and not r["owners"] and not r["predicate_type"] and r["completion"] != "return")

    def proxy(self, c: dict, parent: str | None) -> str | None:
        """The subgraph of a call around its function arguments: it stands for the value that the call gives."""
        kind, value = c["kind"], c["value"]
        if kind == "statement":
            if c["target_offset"] not in self.called:
                return None
            return self.subgraph(f"expr_stmt_{c['target_offset']}", "call-proxy", value["line"], c["end_line"], parent, name=c["head"])
        target, known = self.result_of(c)
        if not known:
            return None
        id = self.subgraph(f"call_proxy_{c['host_offset']}", "call-proxy", value["line"], c["end_line"], parent, name=c["head"])
        self.stands_for(c, id)
        return id

    def of_chain(self, c: dict, host: str, parent: str | None) -> str:
        """The subgraph of the call that a function is an argument of. Each call of a chain before the last one has its own beside the
        host, which reads it; what the chain starts from is read by the innermost."""
        at = host
        for call in c["chain"]:
            inner = self.subgraph(f"call_proxy_{call['offset']}_{call['end']}", "call-proxy", call["line"], call["end_line"], parent, name=call["head"])
            self.edge(inner, at, "read")
            self.innermost[host] = min(self.innermost.get(host, (call["end"], inner)), (call["end"], inner))
            at = inner
        if c["kind"] == "statement" and host in self.innermost:
            self.statement_nodes[c["target_offset"]] = self.innermost[host][1]
        return host if c["inner_end"] is None else f"call_proxy_{c['inner_offset']}_{c['inner_end']}"

    def result_of(self, c: dict) -> tuple[str | None, bool]:
        """The node that takes the value of a call around a function argument, and whether the call is known to have a taker."""
        kind, at, target = c["kind"], c["target_offset"], None
        if kind == "declarator" and at in self.declared_at:
            target = "n_" + plain(self.declared_at[at])
        if kind == "assignment" and at in self.write_at:
            target = "wr_" + plain(self.write_at[at]["id"])
        return target, target is not None or kind == "return"

    def stands_for(self, c: dict, id: str) -> None:
        """Reads inside the call go to ``id``, and ``id`` to what takes the call's value."""
        target, known = self.result_of(c)
        if not known:
            return
        span = (c["value"]["offset"], c["end"], id, target)
        held = self.proxies["return" if c["kind"] == "return" else "owner"]
        if span not in held:
            held.append(span)
        if target:
            self.edge(id, target, "read")

    def proxy_of(self, kind: str, r: dict, target: str | None = None) -> str | None:
        """The innermost proxy for ``target`` whose call a reference lies in."""
        at = r["at"]["offset"]
        found = [(b - a, id) for a, b, id, t in self.proxies[kind] if a <= at < b and t == target]
        host = min(found)[1] if found else None
        return self.innermost[host][1] if host in self.innermost else host

    def variable_node(self, v: dict, parent: str | None) -> None:
        d = v["defs"][0]
        kind = KINDS.get(d["import_kind"] or d["declaration_kind"] or d["type"], "AwaitUsingBinding")
        line = 0 if d["type"] == "ImplicitGlobalVariable" else d["name"]["line"]
        function = d["init_type"] in FUNCTION_TYPES
        if d["type"] == "ImportBinding":
            parent = self.subgraph("sg_" + plain(d["import_source"]), "module", 0, 0, None, name=d["import_source"])
            if d["imported_name"] and d["imported_name"] != v["name"]:
                self.node(self.import_id(d), "SyntheticImportIntermediate", d["imported_name"], d["name"]["line"], parent)
        unused = v["unused"] and d["declaration_kind"] != "var"
        self.node("n_" + plain(v["id"]), kind, v["name"], line, parent, unused=unused, declaration_kind=d["declaration_kind"], init_is_function=function, imported_name=d["imported_name"])

    # edges ------------------------------------------------------------------------------------------------------
    def edge(self, src: str, dst: str, label: str) -> None:
        self.edges.setdefault((src, label, dst))

    def id_of(self, v: str, write: dict | None) -> str:
        return "wr_" + plain(write["id"]) if write else "n_" + plain(v)

    def last(self, v: str, offset: int, inclusive: bool = False) -> dict | None:
        n = (bisect_right if inclusive else bisect_left)(self.at.get(v, []), offset)
        return self.writes[v][n - 1] if n else None

    def under(self, scope: str, top: str) -> bool:
        return top in self.chain[scope]

    def predecessor(self, v: str, r: dict) -> dict | None:
        """The latest earlier write in a scope around the write."""
        n = bisect_left(self.at[v], r["at"]["offset"])
        return next((w for w in reversed(self.writes[v][:n]) if w["scope"] in self.chain[r["scope"]]), None)

    def set_edges(self) -> None:
        for v in self.variables:
            if self.variables[v]["defs"][0]["declaration_kind"] == "var":
                continue
            first: dict[str, dict] = {}
            lasts: dict[str, dict] = {}
            for r in self.writes.get(v, []):
                case = next((i for i in self.chain[r["scope"]] if self.scopes[i]["block_type"] == "SwitchCase"), None)
                if case and case not in first:
                    first[case] = r
                    arms = self.arms[self.key[case]]
                    at = next(k for k, a in enumerate(arms) if a["id"] == case)
                    falls = at > 0 and arms[at - 1]["falls_through"]
                    before = lasts.get(arms[at - 1]["id"]) if falls else None
                    self.edge(self.id_of(v, before), self.id_of(v, r), "fallthrough" if falls else "set")
                else:
                    self.edge(self.id_of(v, self.predecessor(v, r)), self.id_of(v, r), "set")
                if case:
                    lasts[case] = r

    def origins(self, v: str, r: dict) -> list[str]:
        offset, own = r["at"]["offset"], r["scope"]
        last = self.last(v, offset)
        if last is None or self.under(own, last["scope"]):
            return [self.id_of(v, last)]
        branch = next((i for i in self.chain[last["scope"]] if self.key[i]), None)
        if branch is None or self.under(own, branch):
            return [self.id_of(v, last)]
        found = self.merged(v, self.key[branch], offset)
        arms = self.arms[self.key[branch]]
        lacks = {"if": "alternate", "try": "handler"}.get(self.key[branch].split(":")[0])
        if lacks and not any(a["key"] == lacks for a in arms):
            start = int(self.key[branch].rsplit(":", 1)[1])
            found.insert(0, self.last(v, start))
        return list(dict.fromkeys(self.id_of(v, w) for w in found)) or [self.id_of(v, last)]

    def merged(self, v: str, key: str, offset: int) -> list[dict | None]:
        """The last writes of the arms that run on to what follows them."""
        out: list[dict | None] = []
        arms = self.arms[key]
        for k, arm in enumerate(arms):
            if not (arm["exits_function"] or arm["falls_through"] and k < len(arms) - 1):
                out += self.inside(v, arm["id"], offset)
        return out

    def inside(self, v: str, arm: str, offset: int) -> list[dict | None]:
        n = bisect_left(self.at[v], offset)
        last = next((w for w in reversed(self.writes[v][:n]) if self.under(w["scope"], arm)), None)
        if last is None:
            return []
        between = self.chain[last["scope"]]
        nested = [i for i in between[: between.index(arm)] if self.key[i]]
        if not nested:
            return [last]
        key = self.key[nested[-1]]
        out = self.merged(v, key, offset)
        lacks = {"if": "alternate", "try": "handler"}.get(key.split(":")[0])
        if lacks and not any(a["key"] == lacks for a in self.arms[key]):
            out += self.inside(v, arm, int(key.rsplit(":", 1)[1]))
        return out or [last]

    def read_edges(self) -> None:
        for r in self.references:
            v = r["resolved"]
            if v not in self.variables or self.variables[v]["defs"][0]["declaration_kind"] == "var":
                continue
            label = ",".join(k for k in ("read", "write", "call") if r[k]) or "ref"
            if r["scope"] in self.hidden:
                own = self.stand_ins[self.hidden[r["scope"]]]
                if own and not r["write"]:
                    for o in self.origins(v, r):
                        self.edge(o, own, label)
                continue
            if r["predicate_type"] and not r["write"]:
                anchor = self.anchors.get((r["predicate_type"], r["predicate_offset"]))
                if anchor is None and r["predicate_type"] == "DoWhileStatement":
                    anchor = self.late_anchor(r)
                anchor = anchor or self.hidden_tests.get(r["predicate_offset"])
                if anchor:
                    for o in self.origins(v, r):
                        self.edge(o, anchor, label)
                if anchor or not self.hidden:
                    continue
            owners = [self.id_of(o, self.last(o, r["at"]["offset"], inclusive=True)) for o in r["owners"] if o in self.variables and self.variables[o]["defs"][0]["declaration_kind"] != "var"]
            if r["write"]:
                own = self.id_of(v, None if r["init"] else r)
                if r["call"] or r["read"] and r["owners"]:
                    for o in owners:
                        if o != own:
                            self.edge(own, o, label)
                if r["read"] and not r["init"]:
                    skip = {own, self.id_of(v, self.predecessor(v, r))}
                    for o in self.origins(v, r):
                        if o not in skip:
                            self.edge(o, own, "read")
            elif r["owners"]:
                for o, target in zip((o for o in r["owners"] if o in self.variables and self.variables[o]["defs"][0]["declaration_kind"] != "var"), owners, strict=True):
                    if o != v:
                        for src in self.origins(v, r):
                            self.edge(src, self.proxy_of("owner", r, target) or target, label)
            elif not r["statement_ternary"] or any(a <= r["at"]["offset"] < b for a, b in self.calling_arms):  # a ternary's value that nothing takes
                sink = self.sink(r)
                for o in self.origins(v, r):
                    self.edge(o, sink, label)

    def late_anchor(self, r: dict) -> str | None:
        """A do-while test stands last in its body."""
        body = self.do_bodies.get(r["predicate_offset"])
        if body is None or body["id"] in self.hidden:
            return None
        self.anchor("DoWhileStatement", body["upper"], body["parent_offset"], body["parent_end_line"], self.home(body["id"]))
        return self.anchors["DoWhileStatement", r["predicate_offset"]]

    def sink(self, r: dict) -> str:
        way, at = r["completion"], r["completion_at"]
        if way == "return":
            proxy = self.proxy_of("return", r)
            if proxy and (proxy in self.nodes or self.subgraphs[proxy]["parent"] == self.home(r["scope"])):
                return proxy
            return self.use_node(r, "return", "ret", "ReturnArgumentReference")
        if r["statement_at"]:
            s = r["statement_at"]
            if s["offset"] in self.statement_nodes:
                return self.statement_nodes[s["offset"]]
            if f"expr_stmt_{s['offset']}" in self.subgraphs:
                return f"expr_stmt_{s['offset']}"
            return self.node(f"expr_stmt_{s['offset']}", "SyntheticExpressionStatement", r["statement_head"], s["line"], self.home(r["scope"]), r["statement_end_line"])
        if way == "throw" and at:
            return self.use_node(r, "throw", "throw", "ThrowArgumentReference")
        return self.node("module_root", "SyntheticModuleSink", "module", 0, None)

    def use_node(self, r: dict, kind: str, short: str, node_kind: str) -> str:
        at = r["completion_at"]
        holder = next((i for i in self.chain[r["scope"]] if i in self.owner), r["scope"])
        host = self.owner[holder]["id"] if holder in self.owner else holder
        box = self.subgraph(f"s_{kind}_{plain(host)}_{at['offset']}_{r['completion_end']}", kind, at["line"], r["completion_end_line"], self.home(r["scope"]))
        return self.node(f"{short}_use_{plain(r['id'])}", node_kind, r["name"], r["at"]["line"], box, jsx=r["jsx"])

    def import_nodes(self) -> None:
        """A named import under another name reads a node of the imported name, shared by its module."""
        for v in self.variables.values():
            d = v["defs"][0]
            if d["imported_name"] and d["imported_name"] != v["name"]:
                self.edge(self.import_id(d), "n_" + plain(v["id"]), "read")

    def import_id(self, d: dict) -> str:
        return f"import_{plain(d['import_source'] + '::' + d['imported_name'])}"

    def tables(self) -> dict:
        number = {"nodes": self.nodes, "subgraphs": self.subgraphs}
        out = {t: [{"ord": k, **row} for k, row in enumerate(rows.values())] for t, rows in number.items()}
        return out | {"edges": [{"ord": k, "src": a, "dst": b, "label": label} for k, (a, label, b) in enumerate(self.shown_edges())]}

    def shown_edges(self) -> dict[tuple[str, str, str], None]:
        """The edges, moved from what a limit leaves out to what stands for it; loops that come of it go."""
        if not self.hidden:
            return self.edges
        scope = {"n_" + plain(i): v["scope"] for i, v in self.variables.items()} | {"wr_" + plain(r["id"]): r["scope"] for w in self.writes.values() for r in w}
        at = lambda i: self.stand_ins[self.hidden[scope[i]]] if scope.get(i) in self.hidden else i
        moved = ((at(a), label, at(b)) for a, label, b in self.edges)
        return dict.fromkeys(e for e in moved if e[0] and e[2] and e[0] != e[2])


# text -----------------------------------------------------------------------------------------------------------
def escape(s: str) -> str:
    return s.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;")


def lines_of(row: dict) -> str:
    a, b = row["line"], row["end_line"]
    return f"L{a}" if b in (None, a) else f"L{a}-{b}"


#: words before a node's name by kind, and before a subgraph's lines: fixed values
HEADS = {"ClassDeclaration": "class ", "DefaultImportBinding": "import ", "NamespaceImportBinding": "import ", "CatchParameter": "catch ", "SyntheticImplicitGlobal": "global ", "SyntheticImportIntermediate": "import ",
         "VarBinding": "var ", "LetBinding": "let ", "UsingBinding": "using ", "AwaitUsingBinding": "await using "}
TITLES = {"consequent": "? then", "alternate": ": else", "conditional-container": "ternary ?:"}
LATE = {"SyntheticExpressionStatement", "SyntheticModuleSink"}


def node_text(n: dict) -> str:
    name = escape(n["name"])
    if n["jsx"]:
        head = f"&lt;{name}&gt;"
    elif n["init_is_function"] or n["kind"] == "FunctionDeclaration":
        head = f"{name}()"
    elif n["kind"] == "NamedImportBinding":
        head = name if n["imported_name"] != n["name"] else f"import {name}"
    elif n["kind"] == "SyntheticBeyondDepth":
        return f"{n['id']}((...))"
    elif n["kind"] == "WriteReference":
        head = ("let " if n["declaration_kind"] == "let" else "") + name
    else:
        head = HEADS.get(n["kind"], "") + name
    label = ("unused " if n["unused"] else "") + head + (f"<br/>{lines_of(n)}" if n["line"] else "")
    a, b = ('(["', '"])') if n["kind"] == "WriteReference" else ("((", "))") if n["kind"] == "SyntheticModuleSink" else ('{"', '"}') if n["kind"] in ("SyntheticIfStatementTest", "SyntheticSwitchStatementDiscriminant", "SyntheticConditionalTest") else ('["', '"]')
    return f"{n['id']}{a}{label}{b}"


def subgraph_text(s: dict) -> str:
    kind = s["kind"]
    if kind == "call-proxy":
        return f"{escape(s['name'])}<br/>{lines_of(s)}"
    if kind == "function" and s["argument"] is not None and not s["owner"]:
        return f"{escape(s['name'])}(args[{s['argument']}])<br/>{lines_of(s)}"
    if kind == "function":
        return f"{escape(s['name'])}()<br/>{lines_of(s)}" if s["owner"] else f"(anonymous)<br/>{lines_of(s)}"
    if kind == "class":
        return f"class {escape(s['name'] or '(anonymous)')}<br/>{lines_of(s)}"
    if kind == "module":
        return f"module {escape(s['name'])}"
    title = f"case {escape(s['case_test'])}" if s["case_test"] else "default" if kind == "case" else ("if-else" if s["has_else"] else "if") if kind == "if-else-container" else TITLES.get(kind, kind)
    return f"{title} {lines_of(s)}"


# fixed values of the layered renderer: the line before the chart, and the stand-in for a subgraph without nodes
LAYERED = '%%{init: {"flowchart": {"defaultRenderer": "elk"}}}%%'
EMPTY_ID, EMPTY_TEXT = "elk_empty_", "No nodes"
#: colours of the diagrams: fixed values
THEMES = {
    "dark": {"stub": "stroke:#888,stroke-dasharray:3 3,color:#888", "var": "stroke-dasharray:5 5", "empty": "fill:transparent,stroke:transparent", "end": "stroke:#888",
             "nest": ["#11192a", "#1a2538", "#243047", "#2d3b57", "#364666", "#3f5175"], "mark": "fill:#facc15,stroke:#facc15", "mark_text": "color:#0a0a0a", "mark_edge": "stroke:#facc15,stroke-width:2px"},
    "light": {"stub": "stroke:#555,stroke-dasharray:3 3,color:#555", "var": "stroke-dasharray:5 5", "empty": "fill:transparent,stroke:transparent", "end": "stroke:#555",
              "nest": ["#f4f7fb", "#e8eff7", "#dce6f3", "#d1ddef", "#c5d4eb", "#b9cbe7"], "mark": "fill:#fde047,stroke:#ca8a04", "mark_text": "color:#0a0a0a", "mark_edge": "stroke:#ca8a04,stroke-width:2px"},
}


def classed(name: str, style: str, ids: list[str]) -> list[str]:
    """The definition of a style class and its members; nothing without members."""
    return [f"  classDef {name} {style};", *(f"  class {i} {name};" for i in ids)] if ids else []


def diagram(t: dict, layered: bool = True, theme: str = "dark", marked: dict | None = None) -> str:
    """The flowchart of a graph's tables; nodes before subgraphs, late statement nodes and import edges at the end, then the
    hints of a part's border and the styles. ``marked`` is what ``highlight`` gives.

    The layered renderer can't draw a subgraph without nodes: such get a node that can't be seen."""
    nodes, groups, owned = {}, {}, {s["owner"] for s in t["subgraphs"] if s["owner"]}
    known = {n["id"]: n for n in t["nodes"]}
    for n in t["nodes"]:
        nodes.setdefault(n["parent"], []).append(n)
    for s in t["subgraphs"]:
        groups.setdefault(s["parent"], []).append(s)
    out = [LAYERED] * layered + ["flowchart RL", *(f"  %% {c}" for c in t.get("comments", []))]
    empty: list[str] = []
    look = THEMES[theme]
    slots: list[list[str]] = [[] for _ in look["nest"]]

    def inside(parent: str | None, depth: int, level: int) -> None:
        pad, before = "  " * depth, len(out)
        out.extend(pad + node_text(n) for n in nodes.get(parent, []) if n["id"] not in owned and not (parent is None and n["kind"] in LATE))
        for s in groups.get(parent, []):
            d, wrap = depth, s["owner"] in known
            if wrap:
                out.extend([pad + f'subgraph wrap_{s["id"]}[" "]', pad + "  direction TB", pad + "  " + node_text(known[s["owner"]])])
                slots[(level - 1) % len(slots)].append(f"wrap_{s['id']}")
                d += 1
            slots[(level - 1 + wrap) % len(slots)].append(s["id"])
            out.extend(["  " * d + f'subgraph {s["id"]}["{subgraph_text(s)}"]', "  " * d + "  direction RL"])
            inside(s["id"], d + 1, level + 1 + wrap)
            out.append("  " * d + "end")
            if wrap:
                out.append(pad + "end")
        if layered and parent is not None and len(out) == before:
            empty.append(f"{EMPTY_ID}{parent}")
            out.append(f'{pad}{empty[-1]}["{EMPTY_TEXT}"]')

    inside(None, 1, 1)
    of_kind = lambda kind: [n["id"] for n in t["nodes"] if n["kind"] == kind]
    imports, stubs = set(of_kind("SyntheticImportIntermediate")), of_kind("SyntheticBeyondDepth")
    ordered = [e for e in t["edges"] if e["src"] not in imports], [e for e in t["edges"] if e["src"] in imports]
    dotted = set(stubs)
    for rows, late in zip(ordered, (True, False), strict=True):
        out += [f"  {e['src']} {'-.->' if dotted & {e['src'], e['dst']} else '-->'}|{e['label']}| {e['dst']}" for e in rows]
        if late:
            out += ["  " + node_text(n) for n in nodes.get(None, []) if n["kind"] in LATE]
    border = [(f"boundary_stub_{k}", b) for k, b in enumerate(t.get("boundary", []), 1)]
    for stub, b in border:
        out += [f"  {stub}((...))", f"  {b['inside']} -.-> {stub}" if b["direction"] == "out" else f"  {stub} -.->|{b['label']}| {b['inside']}"]
    groups_of = {s["id"] for s in t["subgraphs"]}
    targets, sources = ({e[end] for e in t["edges"]} & groups_of for end in ("dst", "src"))
    drawn = [i for slot in slots for i in slot]
    out += classed("boundaryStub", look["stub"], [stub for stub, _ in border] + stubs) + classed("varNode", look["var"], of_kind("VarBinding"))
    for k, ids in enumerate(slots):
        out += classed(f"nestL{k + 1}", f"fill:{look['nest'][k]},stroke:transparent", ids)
    out += classed("edgeTargetSubgraph", look["end"], [i for i in drawn if i in targets])
    out += classed("edgeSourceSubgraph", look["end"], [i for i in drawn if i in sources - targets])
    if marked and marked["ids"]:
        ids, points = set(marked["ids"]), set(marked["points"])
        out += [f"  style {i} {look['mark']},{look['mark_text']};" for i in marked["ids"] if i not in groups_of]
        hit = [{e["src"], e["dst"]} <= ids or bool({e["src"], e["dst"]} & points) for rows in ordered for e in rows] + [b["inside"] in points for _, b in border]
        if any(hit):
            out.append(f"  linkStyle {','.join(str(k) for k, h in enumerate(hit) if h)} {look['mark_edge']};")
        out += classed("highlightSubgraph", look["mark"], [i for i in marked["ids"] if i in groups_of])
    return "\n".join(out + classed("elkEmptyPlaceholder", look["empty"], empty)) + "\n"


# part of a graph, other texts -----------------------------------------------------------------------------------
def around(t: dict, roots: set[str], descendants: int, ancestors: int) -> set[str]:
    """The ids within so many edges after or before the roots."""
    kept = set(roots)
    for near, far, most in (("src", "dst", descendants), ("dst", "src", ancestors)):
        links: dict[str, list[str]] = {}
        for e in t["edges"]:
            links.setdefault(e[near], []).append(e[far])
        level, seen = roots, set(roots)
        for _ in range(most):
            level = {x for i in level for x in links.get(i, ())} - seen
            if not level:
                break
            seen |= level
        kept |= seen
    return kept


def border(t: dict, kept: set[str], descendants: int, ancestors: int) -> list[dict]:
    """The hints of a part: kept ends of edges that leave it, then of those that come into it, with all their labels."""
    out: dict[tuple[str, str], set[str]] = {}
    for way, near, far, radius in (("out", "src", "dst", descendants), ("in", "dst", "src", ancestors)):
        for e in t["edges"]:
            if radius and e[near] in kept and e[far] not in kept:
                out.setdefault((e[near], way), set()).update(e["label"].split(",") if way == "in" else ())
    return [{"inside": i, "direction": way, "label": ",".join(sorted(labels))} for (i, way), labels in out.items()]


def highlight(t: dict, queries: list[tuple[str, str, set[str], set[str]]]) -> dict:
    """ids (nodes and subgraphs to be marked, in the order of their elements), points (those all of whose edges are marked) and
    warnings. ``queries``: (kind, text, left, right) with kind ``point``, ``path``, or a, b or c for a direction, and sets of ids."""
    links: dict[str, dict[str, list[str]]] = {"src": {}, "dst": {}}
    for e in t["edges"]:
        links["src"].setdefault(e["src"], []).append(e["dst"])
        links["dst"].setdefault(e["dst"], []).append(e["src"])

    def reach(seeds: set[str], near: str) -> set[str]:
        seen, todo = set(seeds), list(seeds)
        while todo:
            new = [x for x in links[near].get(todo.pop(), ()) if x not in seen]
            seen.update(new)
            todo += new
        return seen

    ids, points, warnings = set(), set(), []
    for kind, text, left, right in queries:
        if kind == "point":
            points |= left
            ids |= left
        elif not left or kind == "path" and not right:
            warnings.append(f"no node matches the highlight {text}")
        elif kind == "path":
            found = reach(left, "src") & reach(right, "dst") | reach(right, "src") & reach(left, "dst")
            ids |= found
            if not found:
                warnings.append(f"no path for the highlight {text}")
        else:
            ids |= (reach(left, "src") if kind in "ac" else set()) | (reach(left, "dst") if kind in "bc" else set())
    order: list[str] = []

    def walk(elements: list[dict]) -> None:
        for e in elements:
            if e["id"] in ids:
                order.append(e["id"])
            walk(e.get("elements", []))

    walk(tree(t))
    return {"ids": order, "points": [i for i in order if i in points], "warnings": warnings}


def part(t: dict, kept: set[str]) -> dict:
    """The tables of the kept nodes. A subgraph stays where a node in it stays, even if it isn't reached itself."""
    nodes = [n for n in t["nodes"] if n["id"] in kept]
    up = {s["id"]: s["parent"] for s in t["subgraphs"]}
    held: set[str] = set()
    for n in nodes:
        at = n["parent"]
        while at and at not in held:
            held.add(at)
            at = up.get(at)
    known = held | {n["id"] for n in nodes}
    ends = kept & known
    return {"nodes": nodes, "subgraphs": [s for s in t["subgraphs"] if s["id"] in held], "edges": [e for e in t["edges"] if e["src"] in ends and e["dst"] in ends]}


def tree(t: dict) -> list[dict]:
    """The nodes and subgraphs as nested elements: nodes before subgraphs, each in its order."""
    inside: dict[str | None, list[dict]] = {}
    for kind, rows in (("node", t["nodes"]), ("subgraph", t["subgraphs"])):
        for r in rows:
            own = {"type": kind, **{k: v for k, v in r.items() if k not in ("ord", "parent")}}
            inside.setdefault(r["parent"], []).append(own)
    for rows in list(inside.values()):
        for own in rows:
            if own["type"] == "subgraph":
                own["elements"] = inside.get(own["id"], [])
    return inside.get(None, [])


def statistics(t: dict, path: str) -> str:
    """Tab-separated out-degree, in-degree and label of the nodes by line, then their totals."""
    out: dict[str, int] = {}
    into: dict[str, int] = {}
    for e in t["edges"]:
        out[e["src"]] = out.get(e["src"], 0) + 1
        into[e["dst"]] = into.get(e["dst"], 0) + 1
    rows = sorted(t["nodes"], key=lambda n: n["line"])
    lines = [f"{out.get(n['id'], 0)}\t{into.get(n['id'], 0)}\t{path}:{n['line']} {'unused ' if n['unused'] else ''}{n['name']}" for n in rows]
    total = f"{sum(out.get(n['id'], 0) for n in rows)}\t{sum(into.get(n['id'], 0) for n in rows)}\t{len(rows)} total"
    return "\n".join([*lines, total]) + "\n"


def markdown(path: str, language: str, text: str, warnings: list[str], query: str | None, chart: str) -> str:
    """A page of one file: notices, the source, the query if there is one, and the diagram."""
    ticks = "```"
    out = [f"# {path}", ""]
    if warnings:
        out += ["## Notice", "", *[f"- {w}" for w in warnings], ""]
    out += ["## Input", "", ticks + language, text.rstrip("\n"), ticks, ""]
    if query:
        out += ["## Query", "", ticks, query, ticks, ""]
    return "\n".join([*out, "## Mermaid", "", ticks + "mermaid", chart.rstrip("\n"), ticks, ""])
