"""Rewrites of an analysed file between analysis and graph, by name."""

from __future__ import annotations

from collections.abc import Callable

Rewrite = Callable[[dict], dict]
HOOKS = ("useCallback", "useMemo")


def hook_imports(ir: dict) -> dict[str, str]:
    """Variable id to hook name, for named imports of the two hooks from ``react``."""
    firsts = ((v["id"], v["defs"][0]) for v in ir["variables"] if v["defs"])
    return {i: d["imported_name"] for i, d in firsts if d["import_source"] == "react" and d["import_kind"] == "named" and d["imported_name"] in HOOKS}


def wrapped(ir: dict, hooks: dict[str, str]) -> dict[str, dict | None]:
    """Variables whose initialiser is a hook call around a function: to the function's scope for ``useCallback``, else to None."""
    calls: dict[tuple[str, int], str] = {}
    for r in ir["references"]:
        if r["call"] and not r["init"] and r["resolved"] in hooks:
            for owner in r["owners"]:
                calls.setdefault((owner, r["at"]["offset"]), hooks[r["resolved"]])
    functions: dict[str, list[dict]] = {}
    for s in ir["scopes"]:
        if s["type"] == "function":
            functions.setdefault(s["upper"], []).append(s)
    out: dict[str, dict | None] = {}
    for v in ir["variables"]:
        d = v["defs"][0] if v["defs"] else None
        hook = calls.get((v["id"], d["init_offset"])) if d else None
        later = [s for s in functions.get(v["scope"], []) if d and d["init_offset"] is not None and s["block"]["offset"] > d["init_offset"]]
        if hook and later:
            inner = min(later, key=lambda s: s["block"]["offset"])
            out[v["id"]] = inner if hook == "useCallback" else None
    return out


def react(ir: dict) -> dict:
    """Take ``useCallback`` and ``useMemo`` out: a callback's variable becomes the function's owner; hook imports that nothing
    else uses go, with the references of the calls."""
    hooks = hook_imports(ir)
    targets = wrapped(ir, hooks) if hooks else {}
    if not targets:
        return ir
    gone = {r["id"] for r in ir["references"] if not r["init"] and any(o in targets for o in r["owners"])}
    held = {r["resolved"] for r in ir["references"] if r["id"] not in gone}
    away = {v for v in hooks if v not in held}

    def without(ids: list[str], lost: set[str]) -> list[str]:
        return [i for i in ids if i not in lost]

    variables = []
    for v in ir["variables"]:
        if v["id"] in away:
            continue
        inner = targets.get(v["id"])
        defs = v["defs"]
        if inner:
            defs = [defs[0] | {"init_type": inner["block_type"], "init_offset": inner["block"]["offset"], "init_end": inner["end"]}, *defs[1:]]
        variables.append(v | {"references": without(v["references"], gone), "defs": defs})
    scopes = [s | {"variables": without(s["variables"], away), "references": without(s["references"], gone)} for s in ir["scopes"]]
    references = [r | {"owners": without(r["owners"], away)} for r in ir["references"] if r["id"] not in gone]
    return ir | {"scopes": scopes, "variables": variables, "references": references}


PLUGINS: dict[str, Rewrite] = {"react": react}


def register(name: str, rewrite: Rewrite) -> None:
    PLUGINS[name] = rewrite


def named(names: list[str]) -> list[Rewrite]:
    """The rewrites in the order asked for; an unknown name is an error."""
    unknown = [n for n in names if n not in PLUGINS]
    if unknown:
        raise ValueError(f"Unknown plugin: {', '.join(unknown)}")
    return [PLUGINS[n] for n in names]
