"""Root and highlight queries: text to a predicate on nodes (name, line, end_line)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"
LARGEST = 2**32 - 1


@dataclass(frozen=True)
class Endpoint:
    low: int | None = None
    high: int | None = None
    name: str | None = None
    ambiguous: bool = False

    def matches(self) -> Column:
        end = F.coalesce(F.col("end_line"), F.col("line"))
        out = F.lit(True)
        if self.low is not None:
            out = (F.col("line") <= self.high) & (end >= self.low)
        return out & (F.col("name") == self.name) if self.name is not None else out


@dataclass(frozen=True)
class Path:
    left: Endpoint
    right: Endpoint


@dataclass(frozen=True)
class Direction:
    start: Endpoint
    way: str  # a: descendants, b: ancestors, c: both


def endpoint(text: str) -> Endpoint:
    """``n``, ``n:id``, ``n-m``, ``n-m:id``, ``Ln-m``, ``Ln`` (line or name) or ``id``; the first form that fits."""
    ranged = re.fullmatch(rf"(\d+)(?:-(\d+))?(?::({NAME}))?", text) or re.fullmatch(r"[Ll](\d+)-(\d+)()", text)
    if ranged:
        low, high = int(ranged[1]), int(ranged[2] or ranged[1])
        if max(low, high) > LARGEST:
            raise ValueError(f"unrecognized token: {text}")
        if low < 1 or low > high:
            raise ValueError(f"lines begin at 1 and ranges don't end before they start: {text}")
        return Endpoint(low, high, ranged[3] or None)
    if re.fullmatch(r"[Ll]\d+", text):
        line = int(text[1:])
        return Endpoint(line, line, text, ambiguous=True)
    if re.fullmatch(NAME, text):
        return Endpoint(name=text)
    raise ValueError(f"unrecognized token: {text}")


def root_queries(text: str) -> list[Endpoint]:
    parts = [p.strip() for p in text.split(",")]
    if not all(parts):
        raise ValueError("a query is empty")
    return [endpoint(p) for p in parts]


def highlight_query(text: str) -> Endpoint | Path | Direction:
    sides = text.split("..")
    if len(sides) > 2:
        raise ValueError(f"more than one '..': {text}")
    if len(sides) == 1:
        return endpoint(text)
    if way := re.fullmatch(r"\+([abc])", sides[1]):
        return Direction(endpoint(sides[0]), way[1])
    return Path(endpoint(sides[0]), endpoint(sides[1]))


def highlight_queries(text: str) -> list[tuple[str, Endpoint | Path | Direction]]:
    """The comma-separated highlight queries with their texts."""
    return [(part, highlight_query(part)) for part in text.split(",")]


def ends(query: Endpoint | Path | Direction) -> list[Endpoint]:
    """The endpoints that a highlight query names."""
    if isinstance(query, Path):
        return [query.left, query.right]
    return [query.start] if isinstance(query, Direction) else [query]


def notice(query: Endpoint, named: bool) -> list[str]:
    """How an ambiguous ``Ln`` was taken, and how to ask for the line."""
    taken = "a node has this name, so that it is taken as the name" if named else "no node has this name, so that it is taken as the line"
    return [f"notice: '{query.name}' is ambiguous", f"  {taken}", f"  for the line ask for '{query.low}'"]


def resolved(query: Endpoint, named: bool) -> Endpoint:
    """An ambiguous ``Ln`` once it is known whether a node has that very name: then the name, else the line."""
    if not query.ambiguous:
        return query
    return Endpoint(name=query.name) if named else Endpoint(query.low, query.high)
