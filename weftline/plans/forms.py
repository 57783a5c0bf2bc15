"""Small programs, one for each form of statement, with their nodes and edges.

The rows were taken from this engine's own output and then read against the rules. They show a change of behaviour;
they are no independent proof of it, unlike the SQL of the other script queries, which is written by hand.

``@`` stands for a number. ``edges``: source | label | target, each by kind and name; ``nodes``: kind, name, line, and ``unused`` where it is."""

from __future__ import annotations

FORMS = {
    "for": {
        "text": "let s@ = 0;\nfor (let i = 0; i < 3; i++) {\n  s@ = s@ + i;\n}\nuse(s@);\n",
        "edges": [
            "LetBinding s@ | set | WriteReference s@",
            "LetBinding i | set | WriteReference i",
            "LetBinding i | read | SyntheticForStatementHeader for ()",
            "WriteReference i | read | WriteReference s@",
            "SyntheticImplicitGlobal use | read,call | SyntheticExpressionStatement use()",
            "WriteReference s@ | read | SyntheticExpressionStatement use()",
        ],
        "nodes": [
            "LetBinding | s@ | 1",
            "SyntheticImplicitGlobal | use | 0",
            "SyntheticForStatementHeader | for () | 2",
            "LetBinding | i | 2",
            "WriteReference | i | 2",
            "WriteReference | s@ | 3",
            "SyntheticExpressionStatement | use() | 5",
        ],
    },
    "for_of": {
        "text": "const l@ = [];\nfor (const x of l@) {\n  use(x);\n}\n",
        "edges": [
            "ConstBinding l@ | read | SyntheticForOfStatementHeader for ()",
            "SyntheticImplicitGlobal use | read,call | SyntheticExpressionStatement use()",
            "ConstBinding x | read | SyntheticExpressionStatement use()",
        ],
        "nodes": [
            "ConstBinding | l@ | 1",
            "SyntheticImplicitGlobal | use | 0",
            "SyntheticForOfStatementHeader | for () | 2",
            "ConstBinding | x | 2",
            "SyntheticExpressionStatement | use() | 3",
        ],
    },
    "while": {
        "text": "let n@ = 3;\nwhile (n@) {\n  n@ = n@ - 1;\n}\nuse(n@);\n",
        "edges": [
            "LetBinding n@ | set | WriteReference n@",
            "LetBinding n@ | read | SyntheticWhileStatementTest while ()",
            "SyntheticImplicitGlobal use | read,call | SyntheticExpressionStatement use()",
            "WriteReference n@ | read | SyntheticExpressionStatement use()",
        ],
        "nodes": [
            "LetBinding | n@ | 1",
            "SyntheticImplicitGlobal | use | 0",
            "SyntheticWhileStatementTest | while () | 2",
            "WriteReference | n@ | 3",
            "SyntheticExpressionStatement | use() | 5",
        ],
    },
    "do": {
        "text": "let n@ = 3;\ndo {\n  n@--;\n} while (n@);\n",
        "edges": [
            "LetBinding n@ | set | WriteReference n@",
            "WriteReference n@ | read | SyntheticDoWhileStatementTest do while ()",
        ],
        "nodes": [
            "LetBinding | n@ | 1",
            "WriteReference | n@ | 3",
            "SyntheticDoWhileStatementTest | do while () | 4",
        ],
    },
    "switch": {
        "text": "let s@ = 0;\nconst k = 2;\nswitch (k) {\n  case 1:\n    s@ = 1;\n  case 2:\n    s@ = 2;\n    break;\n  default:\n    s@ = 3;\n}\nuse(s@);\n",
        "edges": [
            "LetBinding s@ | set | WriteReference s@",
            "WriteReference s@ | fallthrough | WriteReference s@",
            "LetBinding s@ | set | WriteReference s@",
            "ConstBinding k | read | SyntheticSwitchStatementDiscriminant switch ()",
            "SyntheticImplicitGlobal use | read,call | SyntheticExpressionStatement use()",
            "WriteReference s@ | read | SyntheticExpressionStatement use()",
            "WriteReference s@ | read | SyntheticExpressionStatement use()",
        ],
        "nodes": [
            "LetBinding | s@ | 1",
            "ConstBinding | k | 2",
            "SyntheticImplicitGlobal | use | 0",
            "SyntheticSwitchStatementDiscriminant | switch () | 3",
            "WriteReference | s@ | 5",
            "WriteReference | s@ | 7",
            "WriteReference | s@ | 10",
            "SyntheticBreakStatement | break | 8",
            "SyntheticExpressionStatement | use() | 12",
        ],
    },
    "try": {
        "text": "let s@ = 0;\ntry {\n  s@ = 1;\n} catch (e) {\n  s@ = 2;\n  use(e);\n} finally {\n  s@ = 3;\n}\nuse(s@);\n",
        "edges": [
            "LetBinding s@ | set | WriteReference s@",
            "LetBinding s@ | set | WriteReference s@",
            "LetBinding s@ | set | WriteReference s@",
            "SyntheticImplicitGlobal use | read,call | SyntheticExpressionStatement use()",
            "CatchParameter e | read | SyntheticExpressionStatement use()",
            "SyntheticImplicitGlobal use | read,call | SyntheticExpressionStatement use()",
            "WriteReference s@ | read | SyntheticExpressionStatement use()",
        ],
        "nodes": [
            "LetBinding | s@ | 1",
            "SyntheticImplicitGlobal | use | 0",
            "CatchParameter | e | 4",
            "WriteReference | s@ | 3",
            "WriteReference | s@ | 5",
            "WriteReference | s@ | 8",
            "SyntheticExpressionStatement | use() | 6",
            "SyntheticExpressionStatement | use() | 10",
        ],
    },
    "class": {
        "text": "const b@ = 1;\nclass C@ {\n  m(x) {\n    return x + b@;\n  }\n}\nconst o = new C@();\n",
        "edges": [
            "FormalParameter x | read | ReturnArgumentReference x",
            "ConstBinding b@ | read | ReturnArgumentReference b@",
            "ClassDeclaration C@ | read,call | ConstBinding o",
        ],
        "nodes": [
            "ConstBinding | b@ | 1",
            "ClassDeclaration | C@ | 2",
            "ConstBinding | o | 7 | unused",
            "ClassDeclaration | C@ | 2 | unused",
            "FormalParameter | x | 3",
            "ReturnArgumentReference | x | 4",
            "ReturnArgumentReference | b@ | 4",
        ],
    },
    "import": {
        "text": "import d@, { a as b, c } from 'm';\nimport * as n from 'm';\nexport const e = d@ + b + c + n;\n",
        "edges": [
            "DefaultImportBinding d@ | read | ConstBinding e",
            "NamedImportBinding b | read | ConstBinding e",
            "NamedImportBinding c | read | ConstBinding e",
            "NamespaceImportBinding n | read | ConstBinding e",
            "SyntheticImportIntermediate a | read | NamedImportBinding b",
        ],
        "nodes": [
            "DefaultImportBinding | d@ | 1",
            "SyntheticImportIntermediate | a | 1",
            "NamedImportBinding | b | 1",
            "NamedImportBinding | c | 1",
            "NamespaceImportBinding | n | 2",
            "ConstBinding | e | 3 | unused",
        ],
    },
    "jsx": {
        "text": "const P@ = (q) => <p>{q}</p>;\nconst v = <P@ q={1} />;\n",
        "edges": [
            "SyntheticImplicitGlobal p | read | ReturnArgumentReference p",
            "FormalParameter q | read | ReturnArgumentReference q",
            "ConstBinding P@ | read | ConstBinding v",
        ],
        "nodes": [
            "ConstBinding | P@ | 1",
            "ConstBinding | v | 2 | unused",
            "SyntheticImplicitGlobal | p | 0",
            "FormalParameter | q | 1",
            "ReturnArgumentReference | p | 1",
            "ReturnArgumentReference | q | 1",
        ],
    },
    "destructure": {
        "text": "const o@ = {};\nconst { a, b: c, ...r } = o@;\nconst [x = c] = a;\nuse(x, r);\n",
        "edges": [
            "ConstBinding o@ | read | ConstBinding a",
            "ConstBinding o@ | read | ConstBinding c",
            "ConstBinding o@ | read | ConstBinding r",
            "ConstBinding c | read | ConstBinding x",
            "ConstBinding a | read | ConstBinding x",
            "SyntheticImplicitGlobal use | read,call | SyntheticExpressionStatement use()",
            "ConstBinding x | read | SyntheticExpressionStatement use()",
            "ConstBinding r | read | SyntheticExpressionStatement use()",
        ],
        "nodes": [
            "ConstBinding | o@ | 1",
            "ConstBinding | a | 2",
            "ConstBinding | c | 2",
            "ConstBinding | r | 2",
            "ConstBinding | x | 3",
            "SyntheticImplicitGlobal | use | 0",
            "SyntheticExpressionStatement | use() | 4",
        ],
    },
    "callback": {
        "text": "const k@ = 1;\nconst r = [1].map((i) => i + k@);\nr.forEach((j) => use(j));\n",
        "edges": [
            "subgraph call-proxy | read | ConstBinding r",
            "FormalParameter i | read | ReturnArgumentReference i",
            "ConstBinding k@ | read | ReturnArgumentReference k@",
            "ConstBinding r | read | subgraph call-proxy",
            "SyntheticImplicitGlobal use | read,call | ReturnArgumentReference use",
            "FormalParameter j | read | ReturnArgumentReference j",
        ],
        "nodes": [
            "ConstBinding | k@ | 1",
            "ConstBinding | r | 2",
            "SyntheticImplicitGlobal | use | 0",
            "FormalParameter | i | 2",
            "FormalParameter | j | 3",
            "ReturnArgumentReference | i | 2",
            "ReturnArgumentReference | k@ | 2",
            "ReturnArgumentReference | use | 3",
            "ReturnArgumentReference | j | 3",
        ],
    },
    "ternary": {
        "text": "const t@ = 1;\nlet y = 0;\nconst z = t@ ? y : t@;\nuse(z);\n",
        "edges": [
            "ConstBinding t@ | read | SyntheticConditionalTest ternary ?:",
            "LetBinding y | read | ConstBinding z",
            "ConstBinding t@ | read | ConstBinding z",
            "SyntheticImplicitGlobal use | read,call | SyntheticExpressionStatement use()",
            "ConstBinding z | read | SyntheticExpressionStatement use()",
        ],
        "nodes": [
            "ConstBinding | t@ | 1",
            "LetBinding | y | 2",
            "ConstBinding | z | 3",
            "SyntheticImplicitGlobal | use | 0",
            "SyntheticConditionalTest | ternary ?: | 3",
            "SyntheticExpressionStatement | use() | 4",
        ],
    },
    "throw": {
        "text": "function f@(m) {\n  if (m) {\n    throw m;\n  }\n}\n",
        "edges": [
            "FormalParameter m | read | SyntheticIfStatementTest if ()",
            "FormalParameter m | read | ThrowArgumentReference m",
        ],
        "nodes": [
            "FunctionDeclaration | f@ | 1 | unused",
            "FormalParameter | m | 1",
            "SyntheticIfStatementTest | if () | 2",
            "ThrowArgumentReference | m | 3",
        ],
    },
    "var": {
        "text": "var v@ = 1;\nuse(v@);\nconst w = v@;\n",
        "edges": [
            "SyntheticImplicitGlobal use | read,call | SyntheticExpressionStatement use()",
        ],
        "nodes": [
            "VarBinding | v@ | 1",
            "ConstBinding | w | 3 | unused",
            "SyntheticImplicitGlobal | use | 0",
            "SyntheticExpressionStatement | use() | 2",
        ],
    },
    "update": {
        "text": "let u@ = 1;\nu@ += 2;\nu@++;\nuse(u@);\n",
        "edges": [
            "LetBinding u@ | set | WriteReference u@",
            "WriteReference u@ | set | WriteReference u@",
            "SyntheticImplicitGlobal use | read,call | SyntheticExpressionStatement use()",
            "WriteReference u@ | read | SyntheticExpressionStatement use()",
        ],
        "nodes": [
            "LetBinding | u@ | 1",
            "SyntheticImplicitGlobal | use | 0",
            "WriteReference | u@ | 2",
            "WriteReference | u@ | 3",
            "SyntheticExpressionStatement | use() | 4",
        ],
    },
    "closure": {
        "text": "const c@ = 1;\nconst f = () => {\n  const g = () => c@;\n  return g();\n};\nf();\n",
        "edges": [
            "ConstBinding c@ | read | ReturnArgumentReference c@",
            "ConstBinding g | read,call | ReturnArgumentReference g",
            "ConstBinding f | read,call | SyntheticExpressionStatement f()",
        ],
        "nodes": [
            "ConstBinding | c@ | 1",
            "ConstBinding | f | 2",
            "ConstBinding | g | 3",
            "ReturnArgumentReference | c@ | 3",
            "ReturnArgumentReference | g | 4",
            "SyntheticExpressionStatement | f() | 6",
        ],
    },
}
