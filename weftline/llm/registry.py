"""The operators bound to the driver tables, one query each, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html, language, mixing, neardup, quality, sharding, tokens, toxicity, vectors
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _on(fn: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: fn(*[table(spark, sf_dir, t) for t in tables])


QUERIES: dict[str, Query] = {
    "op1_decontaminate": _on(decontaminate.query, "documents", "benchmark"),
    "op2_toxicity": _on(toxicity.query, "documents", "labels"),
    "op3_tokens": _on(tokens.query, "documents"),
    "op4_html": _on(html.query, "pages"),
    "op5_neardup": _on(neardup.query, "documents"),
    "op6_language": _on(language.query, "documents"),
    "op7_sharding": _on(sharding.query, "documents"),
    "op8_vectors": _on(vectors.query, "embeddings"),
    "op9_mixing": _on(mixing.query, "documents"),
    "op10_quality": _on(quality.query, "documents", "labels"),
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": decontaminate.ORACLE_SQL,
    "op5_neardup": neardup.ORACLE_SQL,
    "op8_vectors": vectors.ORACLE_SQL,
    "op9_mixing": mixing.ORACLE_SQL,
}
