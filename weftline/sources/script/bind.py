"""Scopes, variables, definitions and references of one syntax tree, with their annotations.

A file is the unit of work: everything here is local to it, so the engine maps files without any exchange.
Ids: ``scope#i`` in pre-order, ``<scope>:<name>@<offset>``, ``ref#i`` by position. Offsets are UTF-16 units.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

from .syntax import Node, parse

FUNCTIONS = {"FunctionDeclaration", "FunctionExpression", "ArrowFunctionExpression"}
CLASSES = {"ClassDeclaration", "ClassExpression"}
LOOPS = {"ForStatement", "ForOfStatement", "ForInStatement"}
JUMPS = {"BreakStatement": "break", "ContinueStatement": "continue", "ReturnStatement": "return", "ThrowStatement": "throw"}
#: slots whose value decides a branch: fixed values
TESTS = {
    ("IfStatement", "test"), ("SwitchStatement", "discriminant"), ("WhileStatement", "test"), ("DoWhileStatement", "test"), ("ForStatement", "init"), ("ForStatement", "test"),
    ("ForStatement", "update"), ("ForOfStatement", "left"), ("ForOfStatement", "right"), ("ForInStatement", "left"), ("ForInStatement", "right"), ("ConditionalExpression", "test"),
}
NESTING = ("function", "if", "for", "while", "switch", "try-catch-finally", "block")


@dataclass(eq=False)
class Frame:
    node: Node
    key: str
    up: Frame | None
    index: int = 0


@dataclass(eq=False)
class Scope:
    type: str
    node: Node
    upper: Scope | None
    frame: Frame
    depths: dict[str, int]
    id: str = ""
    names: dict[str, Variable] = field(default_factory=dict)
    children: list[Scope] = field(default_factory=list)

    @property
    def var_scope(self) -> Scope:
        return self if self.upper is None or self.type == "function" else self.upper.var_scope

    def within(self, other: Scope) -> bool:
        s: Scope | None = self
        while s and s is not other:
            s = s.upper
        return s is other


@dataclass(eq=False)
class Variable:
    name: str
    scope: Scope
    at: int
    defs: list[dict] = field(default_factory=list)
    bodies: list[Node] = field(default_factory=list)
    refs: list[Reference] = field(default_factory=list)
    id: str = ""

    @property
    def declared(self) -> bool:
        return any(d["type"] != "ImplicitGlobalVariable" for d in self.defs)


@dataclass(eq=False)
class Reference:
    node: Node
    scope: Scope
    frame: Frame | None
    read: bool
    write: bool
    init: bool = False
    synthetic: bool = False
    variable: Variable | None = None
    id: str = ""


class Positions:
    """Code points of a text to UTF-16 offsets, lines (from 1) and columns (from 0)."""

    def __init__(self, text: str) -> None:
        self.lines = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]
        self.wide = [i for i, c in enumerate(text) if ord(c) > 0xFFFF] if not text.isascii() else []

    def offset(self, at: int) -> int:
        return at + bisect_right(self.wide, at - 1)

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def column(self, at: int) -> int:
        return self.offset(at) - self.offset(self.lines[self.line(at) - 1])


def binding_names(n: Node) -> list[Node]:
    """The identifiers that a pattern binds, in order."""
    if n.type == "Identifier":
        return [n]
    if n.type == "AssignmentPattern":
        return binding_names(n.kids[0][1])
    return [x for k, c in n.kids if k in ("elements", "properties", "argument", "value", "parameter") for x in binding_names(c)]


def assigned_names(n: Node) -> list[Node]:
    """The identifiers that an assignment target writes; members contribute none."""
    if n.type in ("ParenthesizedExpression", "TSAsExpression", "TSNonNullExpression"):
        return assigned_names(n.kids[0][1])
    return [] if n.type == "MemberExpression" else binding_names(n)


def exits(n: Node) -> set[str] | None:
    """The ways in which a statement always leaves its sequence; None if it may complete."""
    if n.type in JUMPS:
        return {JUMPS[n.type]}
    if n.type == "BlockStatement":
        return exits(n.kids[-1][1]) if n.kids else None
    if n.type == "IfStatement" and n.get("alternate"):
        a, b = exits(n.get("consequent")), exits(n.get("alternate"))
        return a | b if a and b else None
    if n.type == "LabeledStatement":
        out = exits(n.get("body"))
        jumps = {JUMPS[x.type] for x in n.walk() if x.type in ("BreakStatement", "ContinueStatement") and x.get("label") and x.get("label").name == n.get("label").name}
        return (out - jumps or None) if out else None
    return None


class Binder:
    def __init__(self, root: Node, module: bool) -> None:
        self.references: list[Reference] = []
        self.order: list[Scope] = []
        self.vars_warned: list[Node] = []
        frame = Frame(root, "", None)
        self.root = self.scope("module" if module else "global", root, None, frame, dict.fromkeys(NESTING, 0))
        self.hoist(root, self.root)
        self.kids(frame, self.root)
        self.resolve()

    # walking ----------------------------------------------------------------------------------------------------
    def scope(self, type: str, node: Node, upper: Scope | None, frame: Frame, depths: dict[str, int]) -> Scope:
        s = Scope(type, node, upper, frame, depths, f"scope#{len(self.order)}")
        self.order.append(s)
        if upper:
            upper.children.append(s)
        return s

    def nested(self, type: str, frame: Frame, upper: Scope, kind: str | None) -> Scope:
        depths = dict(upper.depths)
        if kind:
            depths[kind] += 1
        return self.scope(type, frame.node, upper, frame, depths)

    def hoist(self, node: Node, scope: Scope) -> None:
        """Declare what the statements directly in ``node`` bind in ``scope``."""
        for _, n in node.kids:
            if n.type in ("ExportNamedDeclaration", "ExportDefaultDeclaration"):
                n = n.get("declaration") or n
            while n.type == "LabeledStatement":
                n = n.get("body")
            own = n.get("id") if n.kids else None
            if n.type == "FunctionDeclaration" and own:
                self.declare(scope, own, "FunctionName", n, body=n)
            elif n.type == "ClassDeclaration" and own:
                self.declare(scope, own, "ClassName", n, body=n)
            elif n.type == "ImportDeclaration":
                for spec in n.all("specifiers"):
                    kind = {"ImportDefaultSpecifier": "default", "ImportNamespaceSpecifier": "namespace"}.get(spec.type, "named")
                    imported = spec.get("imported").name if kind == "named" else None
                    self.declare(scope, spec.get("local"), "ImportBinding", spec, import_kind=kind, imported_name=imported, import_source=n.get("source").name[1:-1])

    def declare(self, scope: Scope, ident: Node, type: str, node: Node, body: Node | None = None, **more) -> Variable:
        v = scope.names.get(ident.name)
        if v is None:
            v = scope.names[ident.name] = Variable(ident.name, scope, ident.start)
        v.defs.append({"type": type, "node": node, "ident": ident, **more})
        if body:
            v.bodies.append(body)
        return v

    def kids(self, frame: Frame, scope: Scope) -> None:
        seen: dict[str, int] = {}
        for key, n in frame.node.kids:
            i = seen[key] = seen.get(key, -1) + 1
            self.visit(Frame(n, key, frame, i), scope)

    def visit(self, f: Frame, scope: Scope) -> None:
        n, up = f.node, f.up.node
        if up.type == "ConditionalExpression" and f.key != "test":
            scope = self.nested("block", f, scope, "block")
        rule = getattr(self, "v_" + n.type, None)
        if n.type in FUNCTIONS:
            self.callable(f, scope)
        elif n.type in CLASSES:
            self.klass(f, scope)
        elif n.type in LOOPS:
            inner = self.nested("for", f, scope, None)
            self.kids(f, inner)
        elif rule:
            rule(f, scope)
        else:
            self.kids(f, scope)

    def callable(self, f: Frame, scope: Scope) -> None:
        own = self.nested("function", f, scope, "function")
        for i, p in enumerate(f.node.all("params")):
            for ident in binding_names(p):
                self.declare(own, ident, "Parameter", f.node)
            if p.type == "TSParameterProperty":
                self.refer(binding_names(p)[0], own, None, True, False, synthetic=True)
            self.pattern(Frame(p, "params", f, i), own)
        body = f.node.get("body")
        if body.type == "BlockStatement":
            self.hoist(body, own)
            self.kids(Frame(body, "body", f), own)
        else:
            self.visit(Frame(body, "body", f), own)

    def klass(self, f: Frame, scope: Scope) -> None:
        own = self.nested("class", f, scope, None)
        if f.node.get("id"):
            self.declare(own, f.node.get("id"), "ClassName", f.node, body=f.node)
        seen: dict[str, int] = {}
        for key, n in f.node.kids:
            i = seen[key] = seen.get(key, -1) + 1
            if key != "id":
                self.visit(Frame(n, key, f, i), own)

    def v_BlockStatement(self, f: Frame, scope: Scope) -> None:
        up = f.up.node.type
        if up not in ("CatchClause", "StaticBlock"):
            kind = "if" if up == "IfStatement" else "for" if up in LOOPS else "while" if up in ("WhileStatement", "DoWhileStatement") else "try-catch-finally" if up == "TryStatement" else "block"
            scope = self.nested("block", f, scope, kind)
        self.hoist(f.node, scope)
        self.kids(f, scope)

    def v_CatchClause(self, f: Frame, scope: Scope) -> None:
        own = self.nested("catch", f, scope, "try-catch-finally")
        p = f.node.get("param")
        if p:
            for ident in binding_names(p):
                self.declare(own, ident, "CatchClause", f.node)
            self.pattern(Frame(p, "param", f), own)
        self.visit(Frame(f.node.get("body"), "body", f), own)

    def v_SwitchStatement(self, f: Frame, scope: Scope) -> None:
        self.visit(Frame(f.node.get("discriminant"), "discriminant", f), scope)
        own = self.nested("switch", f, scope, "switch")
        for i, c in enumerate(f.node.all("cases")):
            frame = Frame(c, "cases", f, i)
            inner = self.nested("block", frame, own, None)
            self.hoist(c, inner)
            self.kids(frame, inner)

    def v_VariableDeclaration(self, f: Frame, scope: Scope) -> None:
        kind = f.node.kind
        if kind == "var":
            self.vars_warned.append(f.node)
        for i, d in enumerate(f.node.all("declarations")):
            target, init = d.get("id"), d.get("init")
            own = scope.var_scope if kind == "var" else scope
            body = init if init and init.type in FUNCTIONS | CLASSES and target.type == "Identifier" else None
            for ident in binding_names(target):
                self.declare(own, ident, "Variable", d, body=body, parent=f.node, init=init, declaration_kind=kind)
            frame = Frame(d, "declarations", f, i)
            self.pattern(Frame(target, "id", frame), scope)
            if init:
                if target.type == "Identifier":
                    self.refer(target, scope, None, False, True, init=True)
                self.visit(Frame(init, "init", frame), scope)

    def pattern(self, f: Frame, scope: Scope) -> None:
        """The expressions in a binding pattern: computed keys and defaults."""
        for key, n in f.node.kids:
            if key == "key" or f.node.type == "AssignmentPattern" and key == "right":
                self.visit(Frame(n, key, f), scope)
            else:
                self.pattern(Frame(n, key, f), scope)

    def v_Identifier(self, f: Frame, scope: Scope) -> None:
        self.refer(f.node, scope, f, True, False, init=f.key == "init" and f.up.node.type == "VariableDeclarator")

    def v_AssignmentExpression(self, f: Frame, scope: Scope) -> None:
        self.write(Frame(f.node.get("left"), "left", f), scope, f.node.name != "=")
        self.visit(Frame(f.node.get("right"), "right", f), scope)

    def v_UpdateExpression(self, f: Frame, scope: Scope) -> None:
        self.write(Frame(f.node.get("argument"), "argument", f), scope, True)

    def write(self, f: Frame, scope: Scope, read: bool) -> None:
        n = f.node
        if n.type == "Identifier":
            self.refer(n, scope, f, read, True)
        elif n.type == "MemberExpression":
            self.visit(f, scope)
        else:
            for key, c in n.kids:
                if key == "key" or n.type == "AssignmentPattern" and key == "right":
                    self.visit(Frame(c, key, f), scope)
                else:
                    self.write(Frame(c, key, f), scope, read)

    def v_ExportSpecifier(self, f: Frame, scope: Scope) -> None:
        local, exported = f.node.get("local"), f.node.get("exported")
        here = f.up.node.get("source") is None
        if local.type == "Identifier":
            self.refer(local, scope, Frame(local, "local", f), True, False, synthetic=not here)
        if exported and exported.type == "Identifier":
            self.refer(exported, scope, None, True, False, synthetic=True)

    def v_MetaProperty(self, f: Frame, scope: Scope) -> None:
        for key, c in f.node.kids:
            self.refer(c, scope, Frame(c, key, f), True, False, synthetic=True)

    def v_ImportDeclaration(self, f: Frame, scope: Scope) -> None:
        for a in f.node.all("attributes"):
            if a.get("key").type == "Identifier":
                self.refer(a.get("key"), scope, Frame(a.get("key"), "key", Frame(a, "attributes", f)), True, False, synthetic=True)

    def v_ExportAllDeclaration(self, f: Frame, scope: Scope) -> None:
        exported = f.node.get("exported")
        if exported and exported.type == "Identifier":
            self.refer(exported, scope, Frame(exported, "exported", f), True, False, synthetic=True)

    def v_JSXIdentifier(self, f: Frame, scope: Scope) -> None:
        up = f.up.node.type
        self.refer(f.node, scope, f, True, False, synthetic=up == "JSXNamespacedName" or not (up == "JSXMemberExpression" or f.node.name[:1].isupper() or f.node.name[:1] in "_$"))

    def skip(self, f: Frame, scope: Scope) -> None:
        """Labels and type-only declarations hold no references."""

    v_BreakStatement = v_ContinueStatement = v_TSEnumDeclaration = skip

    def v_LabeledStatement(self, f: Frame, scope: Scope) -> None:
        self.visit(Frame(f.node.get("body"), "body", f), scope)

    # references -------------------------------------------------------------------------------------------------
    def refer(self, n: Node, scope: Scope, f: Frame | None, read: bool, write: bool, init: bool = False, synthetic: bool = False) -> None:
        if f and f.up.node.type in ("ForOfStatement", "ForInStatement") and f.key in ("left", "right"):
            read, write = True, False
        self.references.append(Reference(n, scope, f, read, write, init, synthetic))

    def lookup(self, scope: Scope, name: str) -> Variable | None:
        s: Scope | None = scope
        while s:
            if name in s.names:
                return s.names[name]
            s = s.upper
        return None

    def resolve(self) -> None:
        self.references.sort(key=lambda r: (r.node.start, r.init and r.write))
        self.writes = {r.node.start: r for r in self.references if r.write and not r.init}
        self.by_node = {id(s.node): s for s in self.order if s.type in ("function", "class")}
        for i, r in enumerate(self.references):
            r.id = f"ref#{i}"
            v = None if r.synthetic else self.lookup(r.scope, r.node.name)
            if v is None and r.node.name == "arguments" and not r.synthetic:
                s: Scope | None = r.scope
                while s and not (s.type == "function" and s.node.type != "ArrowFunctionExpression"):
                    s = s.upper
                if s:
                    r.variable = Variable("arguments", s, s.node.start)  # bound, but without a definition: not shown
                    continue
            if v is None:
                v = self.root.names.get(r.node.name)
                if v is None or v.declared:
                    v = self.implicit(r)
            r.variable = v
            v.refs.append(r)
        for s in self.order:
            for v in s.names.values():
                v.id = f"{s.id}:{v.name}@{v.at}"

    def implicit(self, r: Reference) -> Variable:
        held = self.root.names.get(r.node.name)
        if held and held.declared:  # a synthetic use of a declared name keeps to itself
            key = f"{r.node.name} (implicit)"
            held = self.root.names.get(key)
            if held is None:
                held = self.root.names[key] = Variable(r.node.name, self.root, r.node.start)
                held.defs.append({"type": "ImplicitGlobalVariable", "node": r.node, "ident": r.node})
            return held
        v = self.root.names[r.node.name] = Variable(r.node.name, self.root, r.node.start)
        v.defs.append({"type": "ImplicitGlobalVariable", "node": r.node, "ident": r.node})
        return v

    def unused(self, v: Variable) -> bool:
        bodies = [self.by_node[id(b)] for b in v.bodies if id(b) in self.by_node]
        return v.declared and not any(r.read and not any(r.scope.within(b) for b in bodies) for r in v.refs)

    def owners(self, r: Reference) -> list[Variable]:
        """The variables that take the value of the nearest declarator or assignment around a reference."""
        f = r.frame
        while f and f.up:
            up = f.up.node
            if up.type == "VariableDeclarator":
                found = [self.lookup(r.scope, n.name) for n in binding_names(up.get("id"))]
                return list(dict.fromkeys(v for v in found if v))
            if up.type == "AssignmentExpression":
                found = [self.writes.get(n.start) for n in assigned_names(up.get("left"))]
                return list(dict.fromkeys(x.variable for x in found if x and x.variable.id))
            if up.type in FUNCTIONS | CLASSES | {"MethodDefinition", "PropertyDefinition"}:
                return []
            f = f.up
        return []


def predicate(f: Frame | None) -> Node | None:
    while f and f.up:
        if (f.up.node.type, f.key) in TESTS:
            return f.up.node
        f = f.up
    return None


def completion(f: Frame | None) -> tuple[str, Node | None]:
    while f and f.up:
        up = f.up.node
        if up.type in ("ReturnStatement", "ThrowStatement"):
            return JUMPS[up.type], up
        if up.type == "ArrowFunctionExpression" and up.kind == "expression" and f.key == "body":
            return "return", f.node
        if up.type in FUNCTIONS | CLASSES:
            break
        f = f.up
    return "normal", None


def statement(f: Frame | None) -> Node | None:
    while f:
        if f.node.type == "ExpressionStatement":
            return f.node
        f = f.up
    return None


def chain_root(f: Frame) -> Node | None:
    """The first ``if`` of the else-if chain that holds an arm; None if not chained."""
    if f.up is None or f.up.node.type != "IfStatement" or f.key not in ("consequent", "alternate"):
        return None
    top = f.up
    while top.key == "alternate" and top.up and top.up.node.type == "IfStatement":
        top = top.up
    return top.node if top is not f.up else None


def jumps(n: Node) -> list[Node]:
    """break and continue directly in a scope: through ``if`` and labels, not through nested scopes."""
    out = []
    for key, c in n.kids:
        if c.type in ("BreakStatement", "ContinueStatement"):
            out.append(c)
        elif c.type in ("IfStatement", "LabeledStatement"):
            out += jumps(c)
    return out


def case_text(test: Node | None, text: str) -> str | None:
    if test is None:
        return None
    if test.type in ("Identifier", "Literal") and test.kind != "regex":
        return f'"{test.name[1:-1]}"' if test.kind == "string" else test.name
    return "<expr>"


def head_text(n: Node, text: str) -> str:
    """A short label of an expression: calls without arguments; what has no head is its source."""
    if n.type in ("ParenthesizedExpression", "TSAsExpression", "TSNonNullExpression"):
        return head_text(n.kids[0][1], text)
    if n.type in ("Identifier", "PrivateIdentifier"):
        return n.name
    if n.type == "MemberExpression" and n.kind != "computed":
        return f"{head_text(n.get('object'), text)}.{n.name}"
    if n.type in ("CallExpression", "NewExpression"):
        return ("new " if n.type == "NewExpression" else "") + head_text(n.get("callee"), text) + "()"
    if n.type == "AwaitExpression":
        return "await " + head_text(n.kids[0][1], text)
    return text[n.start : n.end]


def bare(n: Node) -> Node:
    while n.type == "ParenthesizedExpression":
        n = n.kids[0][1]
    return n


def receivers(n: Node) -> list[Node]:
    """The calls of a method chain, the outermost first: each is called on a member of the next one's value."""
    out = []
    while n.type in ("CallExpression", "NewExpression"):
        out.append(n)
        callee = bare(n.get("callee"))
        if callee.type != "MemberExpression":
            break
        n = bare(callee.get("object"))
    return out


def callback(f: Frame) -> tuple[str, Node, Node, Node | None] | None:
    """What takes the value of the call that a function is an argument of: (kind, host, value, target); None where nothing does.

    Of a ternary value, the part with the call counts. Functions and classes end the search."""
    call = f.up
    g = call
    while g and g.up:
        up = g.up.node
        kind = (
            "statement" if up.type == "ExpressionStatement" else "declarator" if up.type == "VariableDeclarator" and g.key == "init"
            else "return" if up.type == "ReturnStatement" or up.type == "ArrowFunctionExpression" and g.key == "body" and up.kind == "expression"
            else "assignment" if up.type == "AssignmentExpression" and g.key == "right" else None
        )
        if kind:
            value = g.node
            while value.type in ("ConditionalExpression", "ParenthesizedExpression"):
                value = next(k for _, k in value.kids if k.start <= call.node.start and call.node.end <= k.end)
            return kind, up if up.type == "ReturnStatement" else g.node, value, up if kind == "statement" else up.get("left" if kind == "assignment" else "id")
        if up.type in FUNCTIONS | CLASSES:
            break
        g = g.up
    return None


def analyse(text: str, language: str, module: bool) -> dict:
    """The tables of one file as lists of dictionaries. Raises ``SyntaxFault`` where the text doesn't parse."""
    tree = parse(text, language)
    b, p = Binder(tree, module), Positions(text)
    off = p.offset

    def span(n: Node) -> dict:
        return {"line": p.line(n.start), "column": p.column(n.start), "offset": off(n.start)}

    told: set[int] = set()  # calls of chains that an earlier function's row holds

    def taken_by(s: Scope) -> dict | None:
        f = s.frame
        if s.type != "function" or f.key != "arguments" or f.up.node.type not in ("CallExpression", "NewExpression"):
            return None
        out = {"callee": head_text(f.up.node.get("callee"), text), "index": f.index, "kind": None, "host_offset": None, "value": None, "end": None, "end_line": None, "head": None, "target_offset": None, "inner_offset": None, "inner_end": None, "chain": []}
        host = callback(f)
        if host:
            kind, holder, value, target = host
            plain_target = target is not None and (kind == "statement" or target.type == "Identifier")
            out |= {"kind": kind, "host_offset": off(holder.start), "value": span(value), "end": off(value.end), "end_line": p.line(value.end), "head": head_text(value, text), "target_offset": off(target.start) if plain_target else None}
            inner = [c for c in receivers(value)[1:] if c.start <= f.node.start and f.node.end <= c.end]
            if inner:
                out |= {"inner_offset": off(inner[-1].start), "inner_end": off(inner[-1].end)}
            new = [c for c in inner if id(c) not in told]
            told.update(map(id, new))
            out["chain"] = [{"offset": off(c.start), "end": off(c.end), "line": p.line(c.start), "end_line": p.line(c.end), "head": head_text(c, text)} for c in new]
        return out

    start = {"line": p.line(n.start), "column": p.column(n.start), "offset": off(n.start)} if (n := tree.kids[0][1] if tree.kids and language in ("ts", "tsx") else tree) else None
    for s in b.order:
        for v in s.names.values():
            v.id = f"{s.id}:{v.name}@{off(v.at)}"
    shown = [v for s in b.order for v in sorted(s.names.values(), key=lambda v: (not v.declared, v.at))]
    of_scope: dict[str, list[str]] = {}
    for v in shown:
        of_scope.setdefault(v.scope.id, []).append(v.id)
    refs_of: dict[str, list[str]] = {}
    for r in b.references:
        refs_of.setdefault(r.scope.id, []).append(r.id)
    scopes = []
    for s in b.order:
        n, up = s.node, s.frame.up
        case = n.type == "SwitchCase"
        body = n.all("consequent") if case else []
        last = exits(body[-1]) if body else None
        root = chain_root(s.frame)
        holder = n.get("body") if s.type in ("function", "catch") else n
        scopes.append({
            "id": s.id, "type": s.type, "strict": b.root.type == "module", "upper": s.upper.id if s.upper else None, "children": [c.id for c in s.children], "variable_scope": s.var_scope.id,
            "block_type": n.type, "parent_line": p.line(up.node.start) if up else None, "parent_end_line": p.line(up.node.end) if up else None, "block": start if s.upper is None else span(n), "end": off(n.end), "end_line": p.line(n.end),
            "variables": of_scope.get(s.id, []), "references": refs_of.get(s.id, []),
            "parent_type": up.node.type if up and s.type in ("block", "catch", "function") else None, "key": s.frame.key if up and s.type in ("block", "catch", "function") else None,
            "parent_offset": off(up.node.start) if up else None, "chain_root_offset": off(root.start) if root else None, "case_test": case_text(n.get("test"), text) if case else None,
            "callback": taken_by(s),
            "falls_through": case and last is None, "exits_function": case and bool(last) and last <= {"return", "throw"}, "depths": s.depths,
            "abrupt": [{"type": JUMPS[j.type], "target": j.get("label").name if j.get("label") else None, "line": p.line(j.start), "offset": off(j.start), "end": off(j.end)} for j in (jumps(holder) if s.type != "for" and holder else [])],
        })
    variables = []
    for v in shown:
        defs = []
        for d in v.defs:
            init, up = d.get("init"), d.get("parent")
            defs.append({
                "type": d["type"], "name": span(d["ident"]), "node_type": d["node"].type, "node": span(d["node"]), "parent_type": up.type if up else None, "init_type": init.type if init else None,
                "init_offset": off(init.start) if init else None, "init_end": off(init.end) if init else None, "declaration_kind": d.get("declaration_kind"),
                "import_kind": d.get("import_kind"), "imported_name": d.get("imported_name"), "import_source": d.get("import_source"),
            })
        variables.append({"id": v.id, "name": v.name, "scope": v.scope.id, "references": [r.id for r in v.refs], "defs": defs, "unused": b.unused(v)})
    references = []
    for r in b.references:
        test, (way, holder), stmt = predicate(r.frame), completion(r.frame), statement(r.frame)
        up, key = (r.frame.up.node.type, r.frame.key) if r.frame else ("", "")
        references.append({
            "id": r.id, "name": r.node.name, "at": span(r.node), "scope": r.scope.id, "resolved": r.variable.id or None, "owners": [v.id for v in b.owners(r)], "init": r.init, "read": r.read, "write": r.write,
            "call": up in ("CallExpression", "NewExpression") and key == "callee", "receiver": up == "MemberExpression" and key == "object",
            "predicate_type": test.type if test else None, "predicate_offset": off(test.start) if test else None, "completion": way,
            "completion_at": span(holder) if holder else None, "completion_end": off(holder.end) if holder else None, "completion_end_line": p.line(holder.end) if holder else None,
            "statement_at": span(stmt) if stmt else None, "statement_end_line": p.line(stmt.end) if stmt else None, "statement_head": head_text(stmt.kids[0][1], text) if stmt else None,
            "statement_ternary": stmt is not None and bare(stmt.kids[0][1]).type == "ConditionalExpression",
            "jsx": r.frame is not None and key == "name" and up == "JSXOpeningElement",
        })
    warnings = [{"kind": "var-detected", "message": "var declaration detected; rendered as node only (no edges).", **span(n)} for n in b.vars_warned]
    return {"scopes": scopes, "variables": variables, "references": references, "diagnostics": warnings}
