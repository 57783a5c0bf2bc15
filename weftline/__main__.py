"""Command line: the graph of one script file, or of standard input, as text.

    python -m weftline [-f mermaid|json|ir|stats|markdown] [-r ROOTS] [-A N] [-B N] [-C N] [-H[QUERIES] | --highlight[=QUERIES]] [--depth N] [--depth-function N]
        [--depth-block N] [--color-theme dark|light] [--plugin NAMES] [-o FILE | --out-dir DIR] [-v] FILE | --stdin

-H without queries marks the roots.

Exit codes: 0, 1 where the file can't be read or parsed, 2 for wrong usage."""

from __future__ import annotations

import argparse
import json
import pathlib
import sys
import time

from .functions import naming
from .functions.queries import Direction, Endpoint, Path, ends, highlight_queries, notice, resolved, root_queries
from .operators.files import USES
from .operators.render import DEFAULT_DEPTH, depth_text
from .sources.code import LANGUAGES
from .sources.script import flow, plugins
from .sources.script.bind import analyse
from .sources.script.syntax import SyntaxFault

EXTENSIONS = {"mermaid": "mmd", "json": "json", "ir": "json", "stats": "tsv", "markdown": "md"}
DEFAULT_RADIUS = 10


def count(text: str) -> int:
    if not text.isascii() or not text.isdigit() or int(text) >= 2**32:
        raise argparse.ArgumentTypeError(f"not a count: {text}")
    return int(text)


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("weftline")
    p.add_argument("file", nargs="?")
    p.add_argument("--stdin", action="store_true")
    p.add_argument("--stdin-lang", choices=["ts", "tsx", "js", "jsx"], default="ts")
    p.add_argument("-f", "--format", choices=sorted(EXTENSIONS), default="mermaid")
    p.add_argument("--mermaid-renderer", choices=["dagre", "elk"], default="elk")
    p.add_argument("-r", "--roots")
    p.add_argument("-A", "--descendants", type=count)
    p.add_argument("-B", "--ancestors", type=count)
    p.add_argument("-C", "--context", type=count)
    p.add_argument("-H", "--highlight")
    for kind in ("", "-function", "-block"):
        p.add_argument(f"--depth{kind}", type=count)
    p.add_argument("--color-theme", choices=sorted(flow.THEMES), default="dark")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--plugin", action="append", default=[])
    p.add_argument("-o", "--out-file")
    p.add_argument("--out-dir")
    return p


def radius(descendants: int | None, ancestors: int | None, context: int | None) -> tuple[int, int]:
    """Without any flag 10 each way; else a missing side is the context, or nothing."""
    if descendants is ancestors is context is None:
        return DEFAULT_RADIUS, DEFAULT_RADIUS
    rest = context or 0
    return rest if descendants is None else descendants, rest if ancestors is None else ancestors


def matching(q: Endpoint, nodes: list[dict], uses: bool, told: dict[str, None]) -> set[str]:
    """The ids that a query selects; a bare name also selects uses only with ``uses``. Notices of ambiguous names go to ``told``."""
    if q.ambiguous:
        named = any(n["name"] == q.name for n in nodes)
        told["\n".join(notice(q, named))] = None
        q = resolved(q, named)
    if q.low is None:
        return {n["id"] for n in nodes if n["name"] == q.name and (uses or n["kind"] not in USES)}
    return {n["id"] for n in nodes if n["line"] <= q.high and (n["end_line"] or n["line"]) >= q.low and q.name in (None, n["name"])}


def marks(tables: dict, text: str | None, roots: list[Endpoint], told: dict[str, None]) -> dict | None:
    """What to highlight: nothing without the flag, the roots with the bare flag, else what the queries ask for."""
    if text is None:
        return None
    asked = []
    for raw, q in highlight_queries(text) if text else [("", q) for q in roots]:
        left, *right = (matching(e, tables["nodes"], True, told) for e in ends(q))
        asked.append(("path" if isinstance(q, Path) else q.way if isinstance(q, Direction) else "point", raw, left, right[0] if right else set()))
    return flow.highlight(tables, asked)


def main(argv: list[str] | None = None) -> int:
    parser = options()
    began = time.perf_counter()
    argv = sys.argv[1:] if argv is None else argv
    a = parser.parse_args(["--highlight=" if x in ("-H", "--highlight") else x for x in argv])  # its value stands in the same word
    done = lambda step: a.verbose and print(f"{step}: {1000 * (time.perf_counter() - began):.1f} ms", file=sys.stderr)
    if not a.stdin and a.file is None:
        parser.error("a file or --stdin is needed")
    if a.out_dir and pathlib.Path(a.out_dir).suffix:
        print(f"notice: '{a.out_dir}' is taken as a folder; for a file use --out-file", file=sys.stderr)
    if a.out_file and a.out_dir:
        parser.error("--out-file and --out-dir exclude each other")
    names = list(dict.fromkeys(n.strip() for group in a.plugin for n in group.split(",") if n.strip()))
    try:
        queries, rewrites = root_queries(a.roots) if a.roots is not None else [], plugins.named(names)
        if a.highlight:
            highlight_queries(a.highlight)
    except ValueError as e:
        parser.error(str(e))
    path = f"stdin.{a.stdin_lang}" if a.stdin else a.file
    extension = path.rsplit(".", 1)[-1]
    try:
        if extension not in LANGUAGES:
            raise ValueError(f"unsupported extension: {path}")
        text = sys.stdin.read() if a.stdin else pathlib.Path(path).read_text("utf-8")
        ir = analyse(text, LANGUAGES[extension], extension == "mjs" or LANGUAGES[extension] != "js")
    except SyntaxFault as fault:
        print(f"Parse error in {path}: {fault} at {fault.at}", file=sys.stderr)
        return 1
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    warnings = [f"warning: L{d['line']}:{d['column']}: {d['message']}" for d in ir["diagnostics"]]
    if a.format != "markdown":
        for w in warnings:
            print(w, file=sys.stderr)
    for rewrite in rewrites:
        ir = rewrite(ir)
    done("analysed")
    general = DEFAULT_DEPTH if a.depth is None else a.depth
    depths = [general if own is None else own for own in (a.depth_function, a.depth_block)]
    tables = flow.Graph(ir, flow.ceiling(*depths)).tables()
    told: dict[str, None] = {}
    if queries and a.format != "ir":
        roots: set[str] = set()
        reach, comments, missed = radius(a.descendants, a.ancestors, a.context), [], []
        for q, raw in zip(queries, a.roots.split(","), strict=True):
            found = matching(q, tables["nodes"], False, told)
            comments.append(f"{raw.strip()}={len(found)}")
            if not found:
                missed.append(f"pruning warning query {raw.strip()} matched 0 roots")
                print(f"warning: no node matches {naming.token(q)}", file=sys.stderr)
            roots |= found
        kept = flow.around(tables, roots, *reach)
        hints = {"boundary": flow.border(tables, kept, *reach), "comments": [f"pruning roots {' '.join(comments)} ancestors={reach[1]} descendants={reach[0]}", *missed]}
        tables = flow.part(tables, kept) | hints
    marked = marks(tables, a.highlight, queries, told) if a.format in ("mermaid", "markdown") else None
    for line in [*told, *(f"warning: {w}" for w in (marked or {"warnings": []})["warnings"])]:
        print(line, file=sys.stderr)
    done("graph")
    chart = lambda: flow.diagram(tables, a.mermaid_renderer == "elk", a.color_theme, marked)
    asked = " ".join(filter(None, (naming.query_flags(a.roots, *(radius(a.descendants, a.ancestors, a.context) if a.roots else (None, None)), a.highlight), depth_text(*depths)))) or None
    out = {
        "ir": lambda: json.dumps({"path": path, "language": LANGUAGES[extension], "text": text, **ir}, ensure_ascii=False) + "\n",
        "json": lambda: json.dumps({"path": path, "direction": "RL", "elements": flow.tree(tables), "edges": [{k: e[k] for k in ("src", "dst", "label")} for e in tables["edges"]]}, ensure_ascii=False) + "\n",
        "stats": lambda: flow.statistics(tables, path),
        "mermaid": lambda: chart(),
        "markdown": lambda: flow.markdown(path, extension, text, [*warnings, *told], asked, chart()),
    }[a.format]()
    target = a.out_file
    if a.out_dir:
        target = f"{a.out_dir}/{naming.basename(queries, a.descendants, a.ancestors, a.context, path)}.{EXTENSIONS[a.format]}"
    if target:
        pathlib.Path(target).parent.mkdir(parents=True, exist_ok=True)
        pathlib.Path(target).write_text(out, "utf-8")
    else:
        sys.stdout.write(out)
    done("written")
    return 0


if __name__ == "__main__":
    sys.exit(main())
