"""Script files as tables: one map over files, no exchange; the tables are columns of one row a file and explode from it.

A file that doesn't parse, or fails in any other way, gives a row with ``error`` and empty tables, so that one bad file fails no
job. Parser, binder and graph follow the nesting of a file by calls that live on the heap, so they may go as deep as FRAMES.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, _parse_datatype_string

_SPAN = "struct<line: long, column: long, offset: long>"
_DEPTHS = "struct<function: long, `if`: long, `for`: long, while: long, switch: long, `try-catch-finally`: long, block: long>"
SCHEMA = f"""path string, language string, error string,
scopes array<struct<id: string, type: string, strict: boolean, upper: string, children: array<string>, variable_scope: string, block_type: string, parent_line: long, parent_end_line: long, block: {_SPAN}, end: long, end_line: long,
  variables: array<string>, references: array<string>, parent_type: string, key: string, parent_offset: long, chain_root_offset: long, case_test: string,
  callback: struct<callee: string, index: long, kind: string, host_offset: long, value: {_SPAN}, `end`: long, end_line: long, head: string, target_offset: long, inner_offset: long, inner_end: long, chain: array<struct<offset: long, `end`: long, line: long, end_line: long, head: string>>>,
  falls_through: boolean, exits_function: boolean, depths: {_DEPTHS}, abrupt: array<struct<type: string, target: string, line: long, offset: long, `end`: long>>>>,
variables array<struct<id: string, name: string, scope: string, references: array<string>, defs: array<struct<type: string, name: {_SPAN}, node_type: string, node: {_SPAN}, parent_type: string,
  init_type: string, init_offset: long, init_end: long, declaration_kind: string, import_kind: string, imported_name: string, import_source: string>>, unused: boolean>>,
references array<struct<id: string, name: string, at: {_SPAN}, scope: string, resolved: string, owners: array<string>, init: boolean, read: boolean, write: boolean, call: boolean, receiver: boolean,
  predicate_type: string, predicate_offset: long, completion: string, completion_at: {_SPAN},
  completion_end: long, completion_end_line: long, statement_at: {_SPAN}, statement_end_line: long, statement_head: string, statement_ternary: boolean, jsx: boolean>>,
diagnostics array<struct<kind: string, message: string, line: long, column: long, offset: long>>"""
GRAPH_SCHEMA = """path string, nodes array<struct<ord: long, id: string, kind: string, name: string, line: long, end_line: long, parent: string, unused: boolean, declaration_kind: string, init_is_function: boolean,
  imported_name: string, jsx: boolean>>,
subgraphs array<struct<ord: long, id: string, kind: string, line: long, end_line: long, parent: string, owner: string, name: string, case_test: string, has_else: boolean, argument: long>>,
edges array<struct<ord: long, src: string, dst: string, label: string>>, diagram string"""
TABLES = ("scopes", "variables", "references", "diagnostics")
#: file extension to language: fixed values
LANGUAGES = {"ts": "ts", "tsx": "tsx", "jsx": "jsx", "js": "js", "mjs": "js", "cjs": "js"}


def language_of(path: Column) -> Column:
    """The language of a path, null where the extension is none of ours."""
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    return F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[ext]


def is_module(path: Column) -> Column:
    """.mjs is a module, .cjs a script; else plain js is a script and the typed or JSX languages are modules."""
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    return F.when(ext == "mjs", True).when(ext == "cjs", False).otherwise(language_of(path) != "js")


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, text) of whole files of our languages. Files of no bytes give no row: Spark's listing leaves them out."""
    rows = spark.read.option("recursiveFileLookup", "true").text(list(paths), wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(language_of(F.col("path")).isNotNull())


def analysed(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per file of (path, text): SCHEMA. A null text is an empty file; an unknown extension is an error."""
    return _mapped(_spread(files, partitions), _analyse, SCHEMA)


def file_graphs(files: DataFrame, plugins: list[str] | None = None, partitions: int | None = None, limits: dict[str, int] | None = None) -> DataFrame:
    """``graphs(with_plugins(analysed(files), plugins))`` in one pass: the tables in between stay within the task.

    ``limits`` (see ``script.flow.ceiling``) leaves out scopes that are nested deeper."""
    from .script.plugins import named

    rewrites = named(plugins or [])

    def one(r: dict) -> dict:
        r = _analyse(r)
        for rewrite in rewrites:
            r = rewrite(r)
        return _graph(r, limits)

    return _mapped(_spread(files, partitions), one, GRAPH_SCHEMA)


def _spread(files: DataFrame, partitions: int | None) -> DataFrame:
    """The files by the hash of their path over ``partitions`` tasks (spark.sql.shuffle.partitions if not given).

    Parsing costs seconds a megabyte, so that the splits of a scan, sized for reading, are far too large for it and a few
    small files would share one task; moving the text once is cheap beside it. A stream keeps the partitions of its batch."""
    own = files.select("path", language_of(F.col("path")).alias("language"), is_module(F.col("path")).alias("module"), "text")
    if files.isStreaming:
        return own
    return own.repartition(partitions or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


#: Python frames that the analysis of one file may stack up; about half a kilobyte each.
FRAMES = 400_000


@contextmanager
def _deep() -> Iterator[None]:
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, FRAMES))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def _analyse(r: dict) -> dict:
    from .script.bind import analyse
    from .script.syntax import SyntaxFault

    path, language = r["path"], r["language"]
    row = {"path": path, "language": language, "error": None, **{t: [] for t in TABLES}}
    if language is None:
        return row | {"error": f"Unsupported extension: {path}"}
    try:
        with _deep():
            return row | analyse(r["text"] or "", language, bool(r["module"]))
    except SyntaxFault as fault:
        return row | {"error": f"Parse error in {path}: {fault} at {fault.at}"}
    except Exception as fault:  # noqa: BLE001  a file's own row tells of it
        return row | {"error": f"Analysis of {path} failed: {type(fault).__name__}: {fault}"}


def _graph(r: dict, limits: dict[str, int] | None = None) -> dict:
    from .script.flow import Graph, diagram

    nothing: dict = {"nodes": [], "subgraphs": [], "edges": []}
    try:
        with _deep():
            t = Graph(r, limits).tables() if r["scopes"] else nothing
            return {"path": r["path"], **t, "diagram": diagram(t)}
    except RecursionError:  # deeper than FRAMES: an empty graph
        return {"path": r["path"], **nothing, "diagram": diagram(nothing)}


def _mapped(rows: DataFrame, one: Callable[[dict], dict], schema: str) -> DataFrame:
    """``one`` over every row, in Arrow batches of few rows: a row may be a large file."""
    target = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in _parse_datatype_string(schema)])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a in range(0, batch.num_rows, 64):
                yield pa.RecordBatch.from_pylist([one(r) for r in batch.slice(a, 64).to_pylist()], schema=target)

    return rows.mapInArrow(batches, schema)


def with_plugins(ir: DataFrame, names: list[str]) -> DataFrame:
    """The analysed files after the named rewrites, in their order. An unknown name is an error here, not in a task."""
    from .script.plugins import named

    rewrites = named(names)

    def one(r: dict) -> dict:
        for rewrite in rewrites:
            r = rewrite(r)
        return r

    return _mapped(ir, one, SCHEMA) if rewrites else ir


def graphs(ir: DataFrame) -> DataFrame:
    """One row per analysed file: GRAPH_SCHEMA. A file that didn't parse has empty tables."""
    return _mapped(ir.select("path", "scopes", "variables", "references"), _graph, GRAPH_SCHEMA)


def graph_rows(graph: DataFrame, table: str) -> DataFrame:
    """nodes, subgraphs or edges as rows: path, ord and the fields."""
    return graph.select("path", F.inline(table))


def exploded(ir: DataFrame, table: str) -> DataFrame:
    """One of TABLES as rows: path, ord and the fields."""
    if table not in TABLES or not isinstance(ir.schema[table].dataType, ArrayType):
        raise ValueError(f"No such table: {table}")
    return ir.select("path", F.posexplode(table).alias("ord", "_r")).select("path", "ord", "_r.*")


def unused(ir: DataFrame) -> DataFrame:
    """(path, id, name) of declared variables that nothing outside their own body reads."""
    return exploded(ir, "variables").where("unused").select("path", "id", "name")


def warnings(ir: DataFrame) -> DataFrame:
    """(path, line) texts of the diagnostics."""
    return exploded(ir, "diagnostics").select("path", F.format_string("warning: L%d:%d: %s", "line", "column", "message").alias("warning"))


def failures(ir: DataFrame) -> DataFrame:
    return ir.where("error is not null").select("path", "error")


def ir_json(ir: DataFrame) -> DataFrame:
    """(path, json): every table of a file, nulls kept."""
    return ir.select("path", F.to_json(F.struct(*ir.columns), {"ignoreNullFields": "false"}).alias("json"))
