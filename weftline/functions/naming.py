"""Names of outputs, made from the options of a query."""

from __future__ import annotations

from .queries import Endpoint


def token(q: Endpoint) -> str:
    """``l3``, ``l3-9``, ``l3-x``, ``l3-9-x`` or the name."""
    if q.low is None:
        return q.name
    if q.ambiguous:  # not yet known to be a name
        return f"l{q.low}"
    lines = f"l{q.low}" if q.low == q.high else f"l{q.low}-{q.high}"
    return lines if q.name is None else f"{lines}-{q.name}"


def radius(descendants: int | None, ancestors: int | None, context: int | None) -> str:
    """``-a1-b2-c3`` of what is given; the context isn't named where both others are."""
    if descendants is not None and ancestors is not None:
        context = None
    return "".join(f"-{k}{n}" for k, n in (("a", descendants), ("b", ancestors), ("c", context)) if n is not None)


def basename(roots: list[Endpoint], descendants: int | None, ancestors: int | None, context: int | None, path: str) -> str:
    """The root tokens joined by ``+`` with the radius; without roots the file's stem."""
    if not roots:
        return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return "+".join(token(q) for q in roots) + radius(descendants, ancestors, context)


def query_flags(roots: str | None, descendants: int | None, ancestors: int | None, highlight: str | None) -> str | None:
    """The shortest flags that state a query; None at the defaults."""
    out = []
    if roots:
        same = descendants is not None and descendants == ancestors
        out.append(f"-r {roots}" + (f" -C {descendants}" if same else "".join(f" {f} {n}" for f, n in (("-A", descendants), ("-B", ancestors)) if n is not None)))
    if highlight is not None:
        out.append(f"-H {highlight}".strip())
    return " ".join(out) or None
