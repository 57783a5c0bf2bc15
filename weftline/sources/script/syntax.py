"""A recursive-descent parser for scripts: modules, classes, async code, JSX, and typed sources whose types are skipped.

Nodes carry the usual syntax-tree type names. Positions are code points of the text; ``sources.script.bind``
turns them into UTF-16 ones. A text outside the grammar raises ``SyntaxFault`` with the position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator


class SyntaxFault(Exception):
    def __init__(self, message: str, at: int) -> None:
        super().__init__(message)
        self.at = at


class Node:
    """``kids`` holds (key, node) in source order; ``name`` is an identifier's or operator's or literal's text."""

    __slots__ = ("type", "start", "end", "kids", "name", "kind")

    def __init__(self, type: str, start: int, end: int, kids: list[tuple[str, Node]] | None = None, name: str | None = None, kind: str | None = None) -> None:
        self.type, self.start, self.end, self.kids, self.name, self.kind = type, start, end, kids or [], name, kind

    def get(self, key: str) -> Node | None:
        return next((n for k, n in self.kids if k == key), None)

    def all(self, key: str) -> list[Node]:
        return [n for k, n in self.kids if k == key]

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += [k for _, k in reversed(n.kids)]


_SPACE = re.compile(r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*(?:[^*]|\*(?!/))*\*/)+")
_NAME = re.compile(r"#?(?:[^\W\d]|[$_])[\w$\u200c\u200d]*")
_NUMBER = re.compile(r"0[xX][\da-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_STRING = re.compile(r"'(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\"")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_PUNCT = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@`]")
RESERVED = set(
    "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null"
    " return super switch this throw true try typeof var void while with enum".split()
)
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
MODIFIERS = {"public", "private", "protected", "readonly", "override"}


class Parser:
    def __init__(self, text: str, typed: bool, jsx: bool) -> None:
        self.text, self.typed, self.jsx = text, typed, jsx
        self.pos = self.last = 0
        self.no_in = False
        self.plain: set[int] = set()  # positions known not to start an arrow or type arguments
        if text.startswith("#!"):
            self.pos = len(text.split("\n", 1)[0])
        self.step()

    # tokens -----------------------------------------------------------------------------------------------------
    def step(self) -> None:
        self.last = getattr(self, "end", 0)
        text, at = self.text, self.pos
        m = _SPACE.match(text, at)
        if m:
            at = m.end()
        self.newline = bool(m and re.search(r"[\n\r\u2028\u2029]", m.group()))
        self.start = at
        if at >= len(text):
            self.kind, self.value, self.end = "eof", "", at
        else:
            for kind, rule in (("name", _NAME), ("string", _STRING), ("number", _NUMBER), ("punct", _PUNCT)):
                m = rule.match(text, at)
                if m:
                    self.kind, self.value, self.end = kind, m.group(), m.end()
                    break
            else:
                raise SyntaxFault("Unexpected character", at)
        self.pos = self.end

    def mark(self) -> tuple:
        return self.pos, self.last, self.kind, self.value, self.start, self.end, self.newline

    def back(self, m: tuple) -> None:
        self.pos, self.last, self.kind, self.value, self.start, self.end, self.newline = m

    def at(self, *values: str) -> bool:
        return self.value in values and self.kind in ("punct", "name")

    def eat(self, value: str) -> bool:
        if self.at(value):
            self.step()
            return True
        return False

    def need(self, value: str) -> None:
        if not self.eat(value):
            raise SyntaxFault(f"Expected {value}", self.start)

    def need_angle(self) -> None:
        """Consume one ``>``, also off a longer operator."""
        if not (self.kind == "punct" and self.value.startswith(">")):
            raise SyntaxFault("Expected >", self.start)
        self.pos = self.end = self.start + 1
        self.step()

    def semicolon(self) -> None:
        if not self.eat(";") and not (self.at("}") or self.kind == "eof" or self.newline):
            raise SyntaxFault("Expected a semicolon or an end of line", self.start)

    def peek(self) -> tuple[str, str, bool]:
        m = self.mark()
        self.step()
        out = self.kind, self.value, self.newline
        self.back(m)
        return out

    def done(self, type: str, start: int, *kids: tuple[str, Node | None], name: str | None = None, kind: str | None = None) -> Node:
        return Node(type, start, self.last, [(k, n) for k, n in kids if n is not None], name, kind)

    def trying(self, rule):
        """``rule()`` or, where it doesn't match here, None with nothing consumed."""
        m, no_in = self.mark(), self.no_in
        try:
            return rule()
        except SyntaxFault:
            self.back(m)
            self.no_in = no_in
            return None

    # types (skipped) --------------------------------------------------------------------------------------------
    def skip_type(self) -> bool:
        if self.at("|", "&", "?", "!"):
            self.step()
        while True:
            if self.at("keyof", "typeof", "readonly", "unique", "infer", "asserts", "new", "abstract") and self.peek()[1] not in (",", ")", ";", "=", ">", "|", "&", "is"):
                self.step()
                continue
            if self.at("<"):
                self.skip_angles()
                continue
            parens = self.at("(")
            if self.at("(", "[", "{"):
                self.skip_balanced()
            elif self.at("`"):
                self.template()
            elif self.at("-"):
                self.step()
                continue
            elif self.kind in ("name", "string", "number"):
                called = self.at("import")
                self.step()
                if called and self.at("("):
                    self.skip_balanced()
            else:
                raise SyntaxFault("Type expected", self.start)
            while True:
                if self.at(".") or self.at("is") and not self.newline:
                    self.step()
                    if self.last and self.text[self.last - 1] == ".":
                        self.step()
                    else:
                        self.skip_type()
                elif self.at("<"):
                    self.skip_angles()
                elif self.at("[") and not self.newline:
                    self.skip_balanced()
                else:
                    break
            if self.at("|", "&") or parens and self.at("=>"):
                self.step()
                continue
            if self.at("extends") and not self.newline:
                self.step()
                self.skip_type()
                if self.eat("?"):
                    self.skip_type()
                    self.need(":")
                    self.skip_type()
            return True

    def skip_angles(self) -> bool:
        self.need("<")
        while not (self.kind == "punct" and self.value.startswith(">")):
            if self.at("const", "in", "out"):
                self.step()
            self.skip_type()
            if self.eat("="):
                self.skip_type()
            if not self.eat(","):
                break
        self.need_angle()
        return True

    def skip_balanced(self) -> None:
        depth = 0
        while True:
            if self.at("(", "[", "{"):
                depth += 1
            elif self.at(")", "]", "}"):
                depth -= 1
            elif self.at("`"):
                self.template()
                continue
            elif self.kind == "eof":
                raise SyntaxFault("Unexpected end of text", self.start)
            self.step()
            if not depth:
                return

    def annotation(self) -> None:
        if self.typed:
            if self.at("?", "!") and self.peek()[1] in (":", ",", ")", "=", ";"):
                self.step()
            if self.eat(":"):
                self.skip_type()

    def generics(self) -> None:
        if self.typed and self.at("<"):
            self.skip_angles()

    # statements -------------------------------------------------------------------------------------------------
    def program(self) -> Node:
        body = []
        while self.kind != "eof":
            body.append(("body", self.statement()))
        return Node("Program", 0, len(self.text), body)

    def block(self) -> Node:
        start = self.start
        self.need("{")
        body = []
        while not self.at("}"):
            body.append(("body", self.statement()))
        self.step()
        return self.done("BlockStatement", start, *body)

    def typed_only(self, start: int) -> Node | None:
        """A declaration of types alone: kept as a childless node."""
        if not self.typed or self.kind != "name":
            return None
        kind, value, newline = self.peek()
        word = self.value
        if newline or kind not in ("name", "string") and not (word == "declare" and value == "global"):
            return None
        if word == "declare":
            self.step()
            depth = 0
            while self.kind != "eof":
                if self.at("{", "(", "["):
                    self.skip_balanced()
                    depth = 1
                elif self.at(";") or self.newline and depth:
                    break
                else:
                    self.step()
            self.eat(";")
            return self.done("TSDeclaration", start)
        if word == "type":
            self.step()
            self.step()
            self.generics()
            self.need("=")
            self.skip_type()
            self.semicolon()
            return self.done("TSTypeAliasDeclaration", start)
        if word in ("interface", "namespace", "module"):
            while not self.at("{"):
                if self.at("<"):
                    self.skip_angles()
                else:
                    self.step()
            self.skip_balanced()
            return self.done("TSInterfaceDeclaration" if word == "interface" else "TSModuleDeclaration", start)
        if word == "abstract" and value == "class":
            self.step()
            return self.klass(True, start)
        return None

    def statement(self) -> Node:
        start, v = self.start, self.value
        if self.kind == "punct":
            if v == "{":
                return self.block()
            if v == ";":
                self.step()
                return self.done("EmptyStatement", start)
            if v == "@":
                return self.klass(True, start)
        if self.kind == "name":
            if v in ("var", "const") or v in ("let", "using") and (self.peek()[0] == "name" and self.peek()[1] not in ("in", "of", "instanceof") or self.peek()[1] in ("{", "[")):
                if v == "const" and self.typed and self.peek()[1] == "enum":
                    self.step()
                    return self.enum(start)
                out = self.variables()
                self.semicolon()
                out.end = self.last
                return out
            rule = getattr(self, "s_" + v, None)
            if rule:
                out = rule(start)
                if out:
                    return out
            if v == "async" and self.peek()[1] == "function" and not self.peek()[2]:
                return self.function("FunctionDeclaration", start)
            if v == "enum" and self.typed:
                return self.enum(start)
            out = self.typed_only(start)
            if out:
                return out
            if v not in RESERVED and self.peek()[1] == ":":
                label = self.identifier()
                self.need(":")
                body = self.statement()
                return self.done("LabeledStatement", start, ("label", label), ("body", body))
        e = self.expression()
        self.semicolon()
        return self.done("ExpressionStatement", start, ("expression", e))

    def enum(self, start: int) -> Node:
        self.need("enum")
        name = self.identifier()
        self.skip_balanced()
        return self.done("TSEnumDeclaration", start, ("id", name))

    def variables(self) -> Node:
        start, kind = self.start, self.value
        self.step()
        out = []
        while True:
            at = self.start
            target = self.binding()
            self.annotation()
            init = self.assignment() if self.eat("=") else None
            out.append(("declarations", self.done("VariableDeclarator", at, ("id", target), ("init", init))))
            if not self.eat(","):
                return self.done("VariableDeclaration", start, *out, kind=kind)

    def parens(self) -> Node:
        self.need("(")
        e = self.expression()
        self.need(")")
        return e

    def s_function(self, start: int) -> Node:
        return self.function("FunctionDeclaration", start)

    def s_class(self, start: int) -> Node:
        return self.klass(True, start)

    def s_if(self, start: int) -> Node:
        self.step()
        test = self.parens()
        then = self.statement()
        other = self.statement() if self.eat("else") else None
        return self.done("IfStatement", start, ("test", test), ("consequent", then), ("alternate", other))

    def s_with(self, start: int) -> Node:
        self.step()
        held = self.parens()
        return self.done("WithStatement", start, ("object", held), ("body", self.statement()))

    def s_while(self, start: int) -> Node:
        self.step()
        test = self.parens()
        return self.done("WhileStatement", start, ("test", test), ("body", self.statement()))

    def s_do(self, start: int) -> Node:
        self.step()
        body = self.statement()
        self.need("while")
        test = self.parens()
        self.eat(";")
        return self.done("DoWhileStatement", start, ("body", body), ("test", test))

    def s_for(self, start: int) -> Node:
        self.step()
        self.eat("await")
        self.need("(")
        init = None
        self.no_in = True
        if not self.at(";"):
            declares = self.at("var", "const") or self.at("let", "using") and self.peek()[0] == "name" and self.peek()[1] not in ("in", "of") or self.at("let") and self.peek()[1] in ("{", "[")
            init = self.variables() if declares else self.expression()
        self.no_in = False
        if self.at("of", "in"):
            type = "ForOfStatement" if self.value == "of" else "ForInStatement"
            self.step()
            right = self.expression() if type == "ForInStatement" else self.assignment()
            self.need(")")
            return self.done(type, start, ("left", self.target(init)), ("right", right), ("body", self.statement()))
        self.need(";")
        test = None if self.at(";") else self.expression()
        self.need(";")
        update = None if self.at(")") else self.expression()
        self.need(")")
        return self.done("ForStatement", start, ("init", init), ("test", test), ("update", update), ("body", self.statement()))

    def s_switch(self, start: int) -> Node:
        self.step()
        cases = [("discriminant", self.parens())]
        self.need("{")
        while not self.eat("}"):
            at = self.start
            test = None
            if not self.eat("default"):
                self.need("case")
                test = self.expression()
            self.need(":")
            body = [("test", test)]
            while not self.at("case", "default", "}"):
                body.append(("consequent", self.statement()))
            cases.append(("cases", self.done("SwitchCase", at, *body)))
        return self.done("SwitchStatement", start, *cases)

    def s_try(self, start: int) -> Node:
        self.step()
        block, handler = self.block(), None
        if self.at("catch"):
            at = self.start
            self.step()
            param = None
            if self.eat("("):
                param = self.binding()
                self.annotation()
                self.need(")")
            handler = self.done("CatchClause", at, ("param", param), ("body", self.block()))
            handler.end = self.last
        final = self.block() if self.eat("finally") else None
        if not handler and not final:
            raise SyntaxFault("Expected catch or finally", self.start)
        return self.done("TryStatement", start, ("block", block), ("handler", handler), ("finalizer", final))

    def s_return(self, start: int) -> Node:
        self.step()
        e = None if self.at(";", "}") or self.newline or self.kind == "eof" else self.expression()
        self.semicolon()
        return self.done("ReturnStatement", start, ("argument", e))

    def s_throw(self, start: int) -> Node:
        self.step()
        e = self.expression()
        self.semicolon()
        return self.done("ThrowStatement", start, ("argument", e))

    def jump(self, start: int) -> Node:
        type = self.value.capitalize() + "Statement"
        self.step()
        label = self.identifier() if self.kind == "name" and self.value not in RESERVED and not self.newline else None
        self.semicolon()
        return self.done(type, start, ("label", label))

    s_break = s_continue = jump

    def s_debugger(self, start: int) -> Node:
        self.step()
        self.semicolon()
        return self.done("DebuggerStatement", start)

    def s_import(self, start: int) -> Node | None:
        if self.peek()[1] in ("(", "."):
            return None
        self.step()
        types = self.typed and self.at("type") and self.peek()[1] not in (",", "from")
        if types:
            self.step()
        out: list[tuple[str, Node]] = []
        if self.kind != "string":
            if self.kind == "name":
                at = self.start
                out.append(("specifiers", self.done("ImportDefaultSpecifier", at, ("local", self.identifier()))))
                out[-1][1].end = self.last
                if self.typed and self.eat("="):  # binds no name and reads none
                    self.expression()
                    self.semicolon()
                    return self.done("TSImportEqualsDeclaration", start)
                self.eat(",")
            if self.at("*"):
                at = self.start
                self.step()
                self.need("as")
                local = self.identifier()
                out.append(("specifiers", self.done("ImportNamespaceSpecifier", at, ("local", local))))
            elif self.eat("{"):
                while not self.at("}"):
                    at = self.start
                    only = self.typed and self.at("type") and self.peek()[1] not in (",", "}", "as")
                    if only:
                        self.step()
                    name = self.export_name()
                    local = self.identifier() if self.eat("as") else None
                    spec = self.done("ImportSpecifier", at, ("imported", name), ("local", local or Node("Identifier", name.start, name.end, name=name.name)))
                    if not only:
                        out.append(("specifiers", spec))
                    if not self.eat(","):
                        break
                self.need("}")
            self.need("from")
        source = self.literal()
        attributes = []
        if self.at("with") and not self.newline:
            self.step()
            self.need("{")
            while not self.eat("}"):
                key = self.word() if self.kind == "name" else self.literal()
                self.need(":")
                attributes.append(("attributes", self.done("ImportAttribute", key.start, ("key", key), ("value", self.literal()))))
                if not self.at("}"):
                    self.need(",")
        self.semicolon()
        return self.done("ImportDeclaration", start, *([] if types else out), ("source", source), *attributes)

    def export_name(self) -> Node:
        if self.kind == "string":
            out = self.literal()
            out.name = out.name[1:-1]
            return out
        return self.word()

    def s_export(self, start: int) -> Node:
        self.step()
        if self.typed and self.eat("="):
            self.expression()
            self.semicolon()
            return self.done("TSExportAssignment", start)
        if self.typed and self.at("as") and self.peek()[1] == "namespace":
            self.step()
            self.step()
            self.identifier()
            self.semicolon()
            return self.done("TSNamespaceExportDeclaration", start)
        if self.eat("default"):
            at = self.start
            if self.at("class", "@") or self.at("abstract") and self.peek()[1] == "class":
                self.eat("abstract")
                d = self.klass(True, at)
            elif self.at("function") or self.at("async") and self.peek()[1] == "function":
                d = self.function("FunctionDeclaration", at)
            else:
                d = self.assignment()
                self.semicolon()
            return self.done("ExportDefaultDeclaration", start, ("declaration", d))
        if self.eat("*"):
            exported = self.export_name() if self.eat("as") else None
            self.need("from")
            source = self.literal()
            self.semicolon()
            return self.done("ExportAllDeclaration", start, ("exported", exported), ("source", source))
        if self.at("{") or self.typed and self.at("type") and self.peek()[1] in ("{", "*"):
            types = self.eat("type")
            out: list[tuple[str, Node]] = []
            if self.eat("*"):
                pass
            else:
                self.need("{")
                while not self.at("}"):
                    at = self.start
                    only = self.typed and self.at("type") and self.peek()[1] not in (",", "}", "as")
                    if only:
                        self.step()
                    local = self.export_name()
                    exported = self.export_name() if self.eat("as") else None
                    if not only:
                        out.append(("specifiers", self.done("ExportSpecifier", at, ("local", local), ("exported", exported))))
                    if not self.eat(","):
                        break
                self.need("}")
            source = self.literal() if self.eat("from") else None
            self.semicolon()
            return self.done("ExportNamedDeclaration", start, *([] if types else out), ("source", source))
        return self.done("ExportNamedDeclaration", start, ("declaration", self.statement()))

    # bindings, functions, classes -------------------------------------------------------------------------------
    def word(self) -> Node:
        if self.kind != "name":
            raise SyntaxFault("Expected a name", self.start)
        start, name = self.start, self.value
        self.step()
        return self.done("Identifier", start, name=name)

    def identifier(self) -> Node:
        if self.value in RESERVED or self.value.startswith("#"):
            raise SyntaxFault("Expected an identifier", self.start)
        return self.word()

    def literal(self) -> Node:
        if self.kind not in ("string", "number"):
            raise SyntaxFault("Expected a literal", self.start)
        start, v, kind = self.start, self.value, self.kind
        self.step()
        return self.done("Literal", start, name=v, kind=kind)

    def binding(self) -> Node:
        start = self.start
        out: list[tuple[str, Node]] = []
        if self.eat("["):
            while not self.at("]"):
                if self.eat(","):
                    continue
                out.append(("elements", self.element()))
                if not self.at("]"):
                    self.need(",")
            self.step()
            return self.done("ArrayPattern", start, *out)
        if self.eat("{"):
            while not self.at("}"):
                at = self.start
                if self.at("..."):
                    out.append(("properties", self.element()))
                else:
                    key, computed = self.key()
                    if self.eat(":"):
                        value = self.element()
                    else:
                        value = Node("Identifier", key.start, key.end, name=key.name)
                        if self.eat("="):
                            value = self.done("AssignmentPattern", at, ("left", value), ("right", self.assignment()))
                            value.end = self.last
                    out.append(("properties", self.done("Property", at, *([("key", key)] if computed else []), ("value", value))))
                if not self.at("}"):
                    self.need(",")
            self.step()
            return self.done("ObjectPattern", start, *out)
        return self.identifier()

    def element(self) -> Node:
        start = self.start
        if self.eat("..."):
            out = self.binding()
            self.annotation()
            return self.done("RestElement", start, ("argument", out))
        left = self.binding()
        self.annotation()
        if self.eat("="):
            right = self.assignment()
            return self.done("AssignmentPattern", start, ("left", left), ("right", right))
        return left

    def parameters(self) -> list[tuple[str, Node]]:
        self.need("(")
        out, no_in, self.no_in = [], self.no_in, False
        while not self.at(")"):
            at, extra = self.start, False
            self.decorators()
            while self.typed and self.at(*MODIFIERS) and self.peek()[0] == "name":
                self.step()
                extra = True
            if self.typed and self.at("this") and not extra:
                self.step()
                self.annotation()
            else:
                p = self.element()
                out.append(("params", Node("TSParameterProperty", at, p.end, [("parameter", p)]) if extra else p))
            if not self.at(")"):
                self.need(",")
        self.step()
        self.no_in = no_in
        return out

    def body(self) -> Node:
        no_in, self.no_in = self.no_in, False
        out = self.block()
        self.no_in = no_in
        return out

    def function(self, type: str, start: int, name: bool = True) -> Node:
        self.eat("async")
        self.need("function")
        self.eat("*")
        own = self.identifier() if name and self.kind == "name" else None
        return self.callable(type, start, own)

    def callable(self, type: str, start: int, own: Node | None = None) -> Node:
        self.generics()
        params = self.parameters()
        self.annotation()
        if self.typed and not self.at("{"):
            self.semicolon()  # an overload: a declaration without a body
            return self.done("TSDeclareFunction", start)
        return self.done(type, start, ("id", own), *params, ("body", self.body()))

    def key(self) -> tuple[Node, bool]:
        if self.eat("["):
            out = self.assignment()
            self.need("]")
            return out, True
        return (self.literal() if self.kind in ("string", "number") else self.word()), False

    def decorators(self) -> list[tuple[str, Node]]:
        out = []
        while self.at("@"):
            start = self.start
            self.step()
            e = self.chain(self.primary(), False)
            out.append(("decorators", self.done("Decorator", start, ("expression", e))))
        return out

    def klass(self, declares: bool, start: int) -> Node:
        kids: list[tuple[str, Node | None]] = list(self.decorators())
        if self.at("export"):
            self.step()
            self.eat("default")
        self.eat("abstract")
        self.need("class")
        kids.append(("id", self.identifier() if self.kind == "name" and not self.at("extends", "implements") else None))
        self.generics()
        if self.eat("extends"):
            kids.append(("superClass", self.chain(self.primary())))
            self.generics()
        if self.typed and self.eat("implements"):
            self.skip_type()
            while self.eat(","):
                self.skip_type()
        at = self.start
        self.need("{")
        members = []
        while not self.eat("}"):
            if not self.eat(";"):
                member = self.member()
                if member:
                    members.append(("body", member))
        kids.append(("body", self.done("ClassBody", at, *members)))
        return self.done("ClassDeclaration" if declares else "ClassExpression", start, *kids)

    def member(self) -> Node | None:
        start, kids = self.start, self.decorators()
        typed_only = False
        while self.kind == "name" and self.value in ({"static", "async", "get", "set", "accessor"} | (MODIFIERS | {"declare", "abstract"} if self.typed else set())):
            kind, value, newline = self.peek()
            if value in ("(", "=", ";", "}", ":", "?", "!", "<") and kind == "punct" and not (value == "{"):
                break
            if newline and self.value != "static":
                break
            typed_only |= self.value in ("declare", "abstract")
            if self.at("static") and value == "{":
                self.step()
                b = self.body()
                return self.done("StaticBlock", start, ("body", b))
            self.step()
        self.eat("*")
        if self.typed and self.at("[") and self.trying(self.index_signature):
            return None
        key, computed = self.key()
        kids += [("key", key)] if computed else []
        if self.typed and self.at("?", "!"):
            self.step()
        if self.at("(", "<"):
            value = self.callable("FunctionExpression", self.start)
            if value.type == "TSDeclareFunction":
                return None
            return self.done("MethodDefinition", start, *kids, ("value", value))
        self.annotation()
        value = self.assignment() if self.eat("=") else None
        self.semicolon()
        return None if typed_only else self.done("PropertyDefinition", start, *kids, ("value", value))

    def index_signature(self) -> bool:
        self.need("[")
        self.identifier()
        self.need(":")
        self.skip_type()
        self.need("]")
        self.annotation()
        self.semicolon()
        return True

    # expressions ------------------------------------------------------------------------------------------------
    def expression(self) -> Node:
        start = self.start
        out = [("expressions", self.assignment())]
        while self.eat(","):
            out.append(("expressions", self.assignment()))
        return out[0][1] if len(out) == 1 else self.done("SequenceExpression", start, *out)

    def arrow(self) -> Node:
        start = self.start
        if self.at("async") and not self.peek()[2] and (self.peek()[1] in ("(", "<") or self.peek()[0] == "name"):
            self.step()
        if self.at("<"):
            self.generics()
        if self.at("("):
            params = self.parameters()
            self.annotation()
        else:
            params = [("params", self.identifier())]
        if not self.at("=>") or self.newline:
            raise SyntaxFault("Expected =>", self.start)
        self.step()
        if self.at("{"):
            return self.done("ArrowFunctionExpression", start, *params, ("body", self.body()))
        return self.done("ArrowFunctionExpression", start, *params, ("body", self.assignment()), kind="expression")

    def assignment(self) -> Node:
        start = self.start
        if self.kind == "name" and self.value not in RESERVED or self.at("(") or self.at("<") and self.typed:
            starts = self.at("(", "<") or self.peek()[1] == "=>" or self.at("async")
            if starts and start not in self.plain:
                out = self.trying(self.arrow)
                if out:
                    return out
                self.plain.add(start)
        if self.at("yield"):
            self.step()
            self.eat("*")
            e = None if self.newline or self.at(")", "]", "}", ",", ";", ":") or self.kind == "eof" else self.assignment()
            return self.done("YieldExpression", start, ("argument", e))
        left = self.binary(0)
        if self.at("?"):
            self.step()
            no_in, self.no_in = self.no_in, False
            then = self.assignment()
            self.no_in = no_in
            self.need(":")
            other = self.assignment()
            return self.done("ConditionalExpression", start, ("test", left), ("consequent", then), ("alternate", other))
        if self.kind == "punct" and self.value in ASSIGN:
            op = self.value
            self.step()
            right = self.assignment()
            return self.done("AssignmentExpression", start, ("left", self.target(left)), ("right", right), name=op)
        return left

    def target(self, n: Node) -> Node:
        """Array and object literals on the left of an assignment are patterns."""
        if n.type in ("ArrayExpression", "ObjectExpression"):
            n.type = n.type.replace("Expression", "Pattern")
            n.kids = [(k, self.target(c)) for k, c in n.kids]
        elif n.type == "Property":
            n.kids = [(k, self.target(c) if k == "value" else c) for k, c in n.kids]
        elif n.type == "SpreadElement":
            n.type = "RestElement"
            n.kids = [(k, self.target(c)) for k, c in n.kids]
        elif n.type == "AssignmentExpression" and n.name == "=":
            n.type = "AssignmentPattern"
        elif n.type == "ParenthesizedExpression":
            n.kids = [(k, self.target(c)) for k, c in n.kids]
        return n

    def binary(self, least: int) -> Node:
        start = self.start
        left = self.unary()
        while True:
            if self.typed and self.at("as", "satisfies") and not self.newline:
                self.step()
                self.skip_type()
                left = self.done("TSAsExpression", start, ("expression", left))
                continue
            level = BINARY.get(self.value, 0) if self.kind in ("punct", "name") else 0
            if not level or level <= least or self.value == "in" and self.no_in:
                return left
            op = self.value
            self.step()
            right = self.binary(level - 1 if op == "**" else level)
            type = "LogicalExpression" if level <= 3 else "BinaryExpression"
            left = self.done(type, start, ("left", left), ("right", right), name=op)

    def unary(self) -> Node:
        start = self.start
        if self.at("!", "~", "+", "-", "typeof", "void", "delete"):
            op = self.value
            self.step()
            return self.done("UnaryExpression", start, ("argument", self.unary()), name=op)
        if self.at("++", "--"):
            op = self.value
            self.step()
            return self.done("UpdateExpression", start, ("argument", self.unary()), name=op)
        if self.at("await") and (self.peek()[0] != "punct" or self.peek()[1] in ("(", "[", "{", "`", "!", "+", "-")) and self.peek()[0] != "eof":
            self.step()
            return self.done("AwaitExpression", start, ("argument", self.unary()))
        out = self.chain(self.primary())
        if self.at("++", "--") and not self.newline:
            op = self.value
            self.step()
            return self.done("UpdateExpression", start, ("argument", out), name=op)
        return out

    def arguments(self) -> list[tuple[str, Node]]:
        self.need("(")
        out, no_in, self.no_in = [], self.no_in, False
        while not self.at(")"):
            out.append(("arguments", self.spread()))
            if not self.at(")"):
                self.need(",")
        self.step()
        self.no_in = no_in
        return out

    def spread(self) -> Node:
        start = self.start
        if self.eat("..."):
            e = self.assignment()
            return self.done("SpreadElement", start, ("argument", e))
        return self.assignment()

    def chain(self, e: Node, calls: bool = True, call: bool = True) -> Node:
        start = e.start
        while True:
            if self.at(".", "?."):
                optional = self.value == "?."
                self.step()
                if optional and self.at("("):
                    e = self.done("CallExpression", start, ("callee", e), *self.arguments())
                elif optional and self.at("["):
                    continue
                else:
                    p = self.word()
                    e = self.done("MemberExpression", start, ("object", e), name=p.name)
            elif self.at("[") and (calls or not self.newline):
                self.step()
                no_in, self.no_in = self.no_in, False
                p = self.expression()
                self.no_in = no_in
                self.need("]")
                e = self.done("MemberExpression", start, ("object", e), ("property", p), kind="computed")
            elif self.at("(") and call:
                args = self.arguments()
                e = self.done("CallExpression", start, ("callee", e), *args)
            elif self.at("`"):
                q = self.template()
                e = self.done("TaggedTemplateExpression", start, ("tag", e), ("quasi", q))
            elif self.typed and self.at("!") and not self.newline and self.peek()[1] != "=":
                self.step()
                e = self.done("TSNonNullExpression", start, ("expression", e))
            elif self.typed and self.at("<") and self.start not in self.plain:
                at = self.start
                if not self.trying(self.type_arguments):
                    self.plain.add(at)
                    return e
            else:
                return e

    def type_arguments(self) -> bool:
        """Type arguments of a call, or of a value where nothing that could be an operand follows."""
        self.skip_angles()
        if not (self.at("(", "`", ";", ")", "]", "}", ",", ":") or self.newline or self.kind == "eof"):
            raise SyntaxFault("Not type arguments", self.start)
        return True

    def primary(self) -> Node:
        start, v = self.start, self.value
        if self.kind in ("string", "number"):
            return self.literal()
        if self.kind == "name":
            if v == "function" or v == "async" and self.peek()[1] == "function":
                return self.function("FunctionExpression", start)
            if v == "class":
                return self.klass(False, start)
            if v == "new":
                return self.construct(start)
            if v in ("this", "super"):
                self.step()
                return self.done("ThisExpression" if v == "this" else "Super", start)
            if v in ("true", "false", "null"):
                self.step()
                return self.done("Literal", start, name=v, kind="word")
            if v == "import":
                meta = self.word()
                if self.eat("."):
                    return self.meta(start, meta)
                return self.done("ImportExpression", start, *self.arguments())
            if v.startswith("#"):
                self.step()
                return self.done("PrivateIdentifier", start, name=v)
            return self.identifier()
        if v == "(":
            self.step()
            no_in, self.no_in = self.no_in, False
            e = self.expression()
            self.no_in = no_in
            self.need(")")
            return self.done("ParenthesizedExpression", start, ("expression", e))
        if v == "[":
            self.step()
            out = []
            while not self.at("]"):
                if self.eat(","):
                    continue
                out.append(("elements", self.spread()))
                if not self.at("]"):
                    self.need(",")
            self.step()
            return self.done("ArrayExpression", start, *out)
        if v == "{":
            return self.object()
        if v == "`":
            return self.template()
        if v in ("/", "/="):
            m = _REGEX.match(self.text, start)
            if m:
                self.pos = self.end = m.end()
                self.step()
                return self.done("Literal", start, name=m.group(), kind="regex")
        if v == "<" and self.jsx:
            return self.element_tree()
        if v == "@":
            return self.klass(False, start)
        if v == "<" and self.typed:
            self.skip_angles()
            return self.done("TSTypeAssertion", start, ("expression", self.unary()))
        raise SyntaxFault("Unexpected token", start)

    def meta(self, start: int, meta: Node) -> Node:
        return self.done("MetaProperty", start, ("meta", meta), ("property", self.word()))

    def construct(self, start: int) -> Node:
        meta = self.word()
        if self.eat("."):
            return self.meta(start, meta)
        callee = self.chain(self.construct(self.start) if self.at("new") else self.primary(), call=False)
        args = self.arguments() if self.at("(") else []
        return self.done("NewExpression", start, ("callee", callee), *args)

    def object(self) -> Node:
        start = self.start
        self.need("{")
        out = []
        no_in, self.no_in = self.no_in, False
        while not self.at("}"):
            at = self.start
            if self.at("..."):
                out.append(("properties", self.spread()))
            else:
                while self.at("get", "set", "async") and self.peek()[1] not in ("(", ":", ",", "}", "=", "<"):
                    self.step()
                self.eat("*")
                key, computed = self.key()
                kids = [("key", key)] if computed else []
                if self.at("(", "<"):
                    value = self.callable("FunctionExpression", self.start)
                elif self.eat(":"):
                    value = self.assignment()
                else:
                    if key.type != "Identifier" or key.name in RESERVED:
                        raise SyntaxFault("Expected :", self.start)
                    value = Node("Identifier", key.start, key.end, name=key.name)
                    if self.eat("="):
                        right = self.assignment()
                        value = self.done("AssignmentPattern", at, ("left", value), ("right", right))
                out.append(("properties", self.done("Property", at, *kids, ("value", value))))
            if not self.at("}"):
                self.need(",")
        self.step()
        self.no_in = no_in
        return self.done("ObjectExpression", start, *out)

    def template(self) -> Node:
        start, at, out = self.start, self.start + 1, []
        while True:
            c = self.text[at : at + 1]
            if not c:
                raise SyntaxFault("Unterminated template", start)
            if c == "`":
                break
            if c == "\\":
                at += 2
            elif self.text.startswith("${", at):
                self.pos = at + 2
                self.step()
                no_in, self.no_in = self.no_in, False
                out.append(("expressions", self.expression()))
                self.no_in = no_in
                if not self.at("}"):
                    raise SyntaxFault("Expected }", self.start)
                at = self.start + 1
            else:
                at += 1
        self.pos = self.end = at + 1
        self.step()
        return self.done("TemplateLiteral", start, *out)

    # JSX --------------------------------------------------------------------------------------------------------
    def tag(self) -> Node | None:
        if self.at(">"):
            return None
        start = self.start
        name = re.compile(r"[\w$-]+(?:\s*[.:]\s*[\w$-]+)*").match(self.text, start)
        if not name:
            raise SyntaxFault("Expected a tag name", start)
        self.pos = self.end = name.end()
        self.step()
        words = re.split(r"\s*[.]\s*", name.group())
        if ":" in name.group():
            parts = [Node("JSXIdentifier", start + m.start(), start + m.end(), name=m.group()) for m in re.finditer(r"[\w$-]+", name.group())]
            return Node("JSXNamespacedName", start, name.end(), [("namespace", parts[0]), ("name", parts[1])])
        out = Node("JSXIdentifier", start, start + len(words[0]), name=words[0])
        if len(words) > 1:
            return Node("JSXMemberExpression", start, name.end(), [("object", out)])
        return out

    def element_tree(self) -> Node:
        start = self.start
        self.need("<")
        name = self.tag()
        kids: list[tuple[str, Node]] = [("name", name)] if name else []
        while not self.at(">", "/"):
            if self.at("{"):
                self.step()
                at = self.start
                self.need("...")
                kids.append(("attributes", self.done("JSXSpreadAttribute", at, ("argument", self.assignment()))))
                self.need("}")
                continue
            at = self.start
            m = re.compile(r"[\w$-]+(?::[\w$-]+)?").match(self.text, at)
            if not m:
                raise SyntaxFault("Expected an attribute", at)
            self.pos = self.end = m.end()
            self.step()
            value = None
            if self.at("="):
                self.step()
                value = self.literal() if self.kind == "string" else self.element_tree() if self.at("<") else self.container()
            kids.append(("attributes", self.done("JSXAttribute", at, ("value", value), name=m.group())))
        opening = Node("JSXOpeningElement", start, self.end, kids)
        if self.at("/"):
            self.step()
            opening.end = self.end
            self.need(">")
            return self.done("JSXElement", start, ("openingElement", opening))
        children: list[tuple[str, Node]] = []
        at = self.end
        while True:
            m = re.compile(r"[^<{]*").match(self.text, at)
            self.pos = self.end = m.end()
            self.step()
            if self.kind == "eof":
                raise SyntaxFault("Unterminated element", start)
            if self.at("{"):
                mark = self.start
                self.step()
                if not self.at("}"):
                    children.append(("children", Node("JSXExpressionContainer", mark, self.end, [("expression", self.spread())])))
                if not self.at("}"):
                    raise SyntaxFault("Expected }", self.start)
                at = self.end
            elif self.peek()[1] == "/":
                self.step()
                self.step()
                self.tag()
                self.need(">")
                return self.done("JSXElement" if name else "JSXFragment", start, ("openingElement", opening), *children)
            else:
                child = self.element_tree()
                children.append(("children", child))
                at = child.end

    def container(self) -> Node:
        start = self.start
        self.need("{")
        e = self.assignment()
        self.need("}")
        return self.done("JSXExpressionContainer", start, ("expression", e))


def parse(text: str, language: str) -> Node:
    """The tree of a text in one of the languages ts, tsx, js, jsx. Nesting beyond the stack is a fault, too."""
    p = Parser(text, language in ("ts", "tsx"), language != "ts")
    try:
        return p.program()
    except RecursionError:
        raise SyntaxFault("Nested too deeply", p.start) from None
