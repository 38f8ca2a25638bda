"""The steps that have led to a frame, read from Spark's analysed plan as a graph.

A step is a read, filter, join, aggregate or other node, with its condition, keys or columns. Projections that follow each other are one
step, and what only renames all columns is none. Steps are walked level by level from the frame, both sides of a join included, and a
node that two branches share is listed once, so the latest steps are told without a walk over the whole plan."""

from __future__ import annotations

import re
from collections import deque
from typing import Any

from pyspark.sql import DataFrame

#: Steps told, characters of one, and nodes that are looked at for them.
LAST = 5
WIDTH = 120
VISITS = 300

#: Nodes that change nothing a user would call a step.
_SILENT = ("SubqueryAlias", "View", "ResolvedHint", "WithCTE", "CTERelationDef", "EventTimeWatermark")
_JOINS = {"LEFT OUTER": "left join", "RIGHT OUTER": "right join", "FULL OUTER": "full join", "LEFT SEMI": "semi join", "LEFT ANTI": "anti join", "INNER": "inner join", "CROSS": "cross join"}


def _items(sequence: Any) -> list[Any]:
    return [sequence.apply(i) for i in range(sequence.size())]


def _sql(expression: Any) -> str:
    """An expression as SQL, without qualifiers, back quotes of plain names and casts of constants."""
    text = re.sub(r"`(\w+)`", r"\1", expression.sql())
    text = re.sub(r"CAST\(('[^']*'|[\w.]+) AS \w+\)", r"\1", text)
    text = re.sub(r"\b(?:[A-Za-z_]\w*\.)+(?=[A-Za-z_])", "", text)
    return _bare(text)


def _bare(text: str) -> str:
    """text without the brackets around all of it."""
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if depth == 0 and i < len(text) - 1:
            return text
    return text[1:-1] if text.startswith("(") else text


def _renames(node: Any) -> dict[str, str] | None:
    """The old name by the new one, where a node is a projection that keeps all columns in place and renames each; else None."""
    if node.getClass().getSimpleName() != "Project":
        return None
    made, given = _items(node.projectList()), _items(node.children().head().output())
    if not made or len(made) != len(given):
        return None
    names = {}
    for new, old in zip(made, given, strict=True):
        if new.getClass().getSimpleName() != "Alias" or not new.child().semanticEquals(old):
            return None
        names[new.name()] = old.name()
    return names


def _condition(node: Any) -> str:
    """The condition of a join by the names that its inputs had before they were renamed for it."""
    text, names = _sql(node.condition().get()), {}
    for child in _items(node.children()):
        names |= _renames(child) or {}
    text = re.sub(r"\w+", lambda word: names.get(word[0], word[0]), text)
    return _bare(text.removeprefix("true AND "))


def _listed(expressions: Any) -> str:
    return ", ".join(e.name() if hasattr(e, "name") and e.getClass().getSimpleName() in ("AttributeReference", "Alias") else _sql(e) for e in _items(expressions))


def _source(node: Any) -> str:
    """What a leaf reads: a table's name, the last part of a path, or the kind of data."""
    kind = node.getClass().getSimpleName()
    if kind == "LogicalRelation":
        if node.catalogTable().isDefined():
            return node.catalogTable().get().identifier().table()
        paths = [str(p).rstrip("/").rsplit("/", 1)[-1] for p in _items(node.relation().location().rootPaths())]
        return ", ".join(re.sub(r"\.(parquet|json|csv|orc|txt)$", "", p) for p in paths)
    if kind.startswith(("DataSourceV2", "StreamingDataSourceV2", "StreamingRelation")):
        return re.sub(r"[^\w.]+", " ", node.nodeName()).strip()
    return {"LocalRelation": "local rows", "LogicalRDD": "rows of an RDD", "Range": "range", "OneRowRelation": "one row", "InMemoryRelation": "cached rows", "CTERelationRef": "shared subquery"}.get(kind, _words(kind))


def _words(kind: str) -> str:
    return re.sub(r"(?<=[a-z])(?=[A-Z])", " ", kind).lower()


def _step(node: Any) -> str | None:
    """The text of a node; None for one that is no step."""
    kind = node.getClass().getSimpleName()
    if kind in _SILENT or _renames(node) is not None:
        return None
    if node.children().isEmpty():
        return f"read {_source(node)}"
    if kind == "Project":
        return f"select {_listed(node.projectList())}"
    if kind == "Filter":
        return f"filter {_sql(node.condition())}"
    if kind == "Join":
        name = _JOINS.get(node.joinType().sql(), node.joinType().sql().lower() + " join")
        return name + (f" on {_condition(node)}" if node.condition().isDefined() else "")
    if kind == "Aggregate":
        keys = _listed(node.groupingExpressions())
        return f"aggregate by {keys}" if keys else "aggregate"
    if kind == "Sort":
        return f"sort by {', '.join(_sql(o) for o in _items(node.order()))}"
    if kind == "Window":
        return f"window by {_listed(node.partitionSpec())}".removesuffix(" by ")
    if kind in ("Deduplicate", "Distinct"):
        return "distinct" + (f" by {_listed(node.keys())}" if kind == "Deduplicate" else "")
    if kind in ("GlobalLimit", "LocalLimit"):
        return f"limit {_sql(node.limitExpr())}"
    return _words(kind)


def _next(node: Any, step: str) -> list[Any]:
    """The inputs of a step: of projections in a row, and of the two nodes that make up a limit, those of the last."""
    children = _items(node.children())
    while len(children) == 1 and (inner := children[0]) is not None:
        kind = inner.getClass().getSimpleName()
        if kind in _SILENT or (step.startswith("select ") and kind == "Project") or (step.startswith("limit ") and kind == "LocalLimit"):
            children = _items(inner.children())
        else:
            break
    return children


def pipeline_of(df: DataFrame, last: int = LAST) -> list[str] | None:
    """The latest steps that have made the frame, each after its inputs; "..." stands for earlier ones. None where there is no plan to
    read (a session without a JVM at hand). Steps are cut at WIDTH characters."""
    try:
        waiting, steps, visits = deque([df._jdf.queryExecution().analyzed()]), [], 0
        while waiting and len(steps) <= last and visits < VISITS:
            node, visits = waiting.popleft(), visits + 1
            step = _step(node)
            if step is None:
                waiting.extend(reversed(_items(node.children())))
                continue
            step = step if len(step) <= WIDTH else step[: WIDTH - 1] + "…"
            # A frame that is joined with itself is in the plan twice, as one object or as an equal one. It is listed at its earliest use, and its inputs before it.
            steps = [(n, text) for n, text in steps if text != step or not node.sameResult(n)] + [(node, step)]
            # The right side first, so that the left one is told before it when the order is turned.
            waiting.extend(reversed(_next(node, step)))
    except Exception:  # noqa: BLE001  a snapshot is taken with or without its pipeline
        return None
    return (["..."] if len(steps) > last or waiting else []) + [text for _, text in steps[:last]][::-1]
