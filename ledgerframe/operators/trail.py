"""Trails of metadata-only snapshots, and the tap that records them.

A tap returns its input lazily and unchanged; what it records is one Row of aggregates, so the driver never sees data."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame

from ledgerframe.functions.types import check_columns, check_frame, class_name, is_numeric
from ledgerframe.operators.pipeline import pipeline_of
from ledgerframe.plans.profile import Scope, checked_way, collected


@dataclass(frozen=True)
class Changes:
    """Against the snapshot before. Added and removed columns refer to all columns, type changes to those recorded on both sides."""

    row_delta: int
    col_delta: int
    na_delta: int
    cols_added: list[str] = field(default_factory=list)
    cols_removed: list[str] = field(default_factory=list)
    type_changes: list[dict] = field(default_factory=list)


@dataclass(frozen=True)
class Snapshot:
    """What a tap knows of the data at one place; it has no rows of it."""

    label: str
    index: int
    timestamp: datetime
    type: str
    nrow: int
    ncol: int
    all_columns: list[str]
    schema: list[dict]
    total_nas: int
    numeric_summary: list[dict] | None
    diagnostics: dict | None = None
    pipeline: list[str] | None = None
    changes: Changes | None = None
    custom: dict | None = None
    controls: dict | None = None

    def __str__(self) -> str:
        from ledgerframe.operators.report import snapshot_text

        return snapshot_text(self)


class AuditTrail:
    """A named, growing list of snapshots with unique labels. Taps change it in place."""

    def __init__(self, name: str | None = None) -> None:
        if name is not None and (not isinstance(name, str) or not name):
            raise ValueError("name must be a single non-empty string")
        self.created_at = now()
        self.name = name or self.created_at.strftime("trail_%Y%m%d_%H%M%S")
        self.snapshots: list[Snapshot] = []
        self._persisted: list[DataFrame] = []

    @property
    def labels(self) -> list[str]:
        return [s.label for s in self.snapshots]

    def __len__(self) -> int:
        return len(self.snapshots)

    def check_label(self, label: str | None, default: str) -> str:
        if label is not None and (not isinstance(label, str) or not label):
            raise ValueError("label must be a single non-empty string")
        label = label or default
        if label in self.labels:
            raise ValueError(f"the trail already has a snapshot labelled {label!r}")
        return label

    def append(self, snapshot: Snapshot) -> None:
        self.snapshots.append(snapshot)

    def release(self) -> None:
        """Unpersists what taps with cache=True have persisted."""
        while self._persisted:
            self._persisted.pop().unpersist()

    def __str__(self) -> str:
        from ledgerframe.operators.report import trail_text

        return trail_text(self)

    __repr__ = __str__


def audit_trail(name: str | None = None) -> AuditTrail:
    return AuditTrail(name)


def now() -> datetime:
    return datetime.now(timezone.utc).replace(microsecond=0)


def check_trail(trail: object) -> AuditTrail:
    if not isinstance(trail, AuditTrail):
        raise TypeError("trail must be an AuditTrail, as made by audit_trail()")
    return trail


def scope_of(df: DataFrame, numeric_summary: bool, cols_include: Sequence[str] | None, cols_exclude: Sequence[str] | None, quantiles: str = "auto") -> Scope:
    """The columns that a snapshot describes. Names to include that don't exist, or none at all, are warned of."""
    if cols_include is not None and cols_exclude is not None:
        raise ValueError("cols_include and cols_exclude can't both be given")
    checked_way(quantiles)
    for given in (cols_include, cols_exclude):
        if given is not None and (isinstance(given, str) or not all(isinstance(c, str) for c in given)):
            raise TypeError("cols_include and cols_exclude must be lists of column names")
    fields = tuple(df.schema.fields)
    chosen = fields
    if cols_include is not None:
        if not cols_include:
            warnings.warn("cols_include is empty: the snapshot describes no column", stacklevel=3)
        if lost := [c for c in cols_include if c not in df.columns]:
            warnings.warn(f"cols_include names columns that don't exist: {', '.join(lost)}", stacklevel=3)
        chosen = tuple(f for f in fields if f.name in cols_include)
    if cols_exclude is not None:
        chosen = tuple(f for f in fields if f.name not in cols_exclude)
    return Scope(fields, chosen, tuple(f for f in chosen if is_numeric(f)) if numeric_summary else (), quantiles)


def changes_between(before: Snapshot, after: Snapshot) -> Changes:
    """From one snapshot to another."""
    types = {c["column"]: c["type"] for c in before.schema}
    changed = [{"column": c["column"], "from": types[c["column"]], "to": c["type"]} for c in after.schema if types.get(c["column"], c["type"]) != c["type"]]
    return Changes(
        after.nrow - before.nrow,
        after.ncol - before.ncol,
        after.total_nas - before.total_nas,
        [c for c in after.all_columns if c not in before.all_columns],
        [c for c in before.all_columns if c not in after.all_columns],
        changed,
    )


def build_snapshot(df: DataFrame, trail: AuditTrail, label: str, kind: str, scope: Scope, controls: dict, keep: Column | None = None, extra: tuple[Column, ...] = (), **more: Any) -> tuple[Snapshot, Any]:
    """The snapshot of df, or of its rows with `keep`, and the row with the extra aggregates."""
    row, found = collected(df, scope, keep, extra)
    missing = {f.name: int(row[f"na_{i}"]) for i, f in enumerate(scope.all_fields)}
    schema = [{"column": f.name, "type": class_name(f), "n_na": missing[f.name]} for f in scope.fields]
    summary = [{"column": f.name, **found[f.name]} for f in scope.numeric] or None
    snapshot = Snapshot(label, len(trail) + 1, now(), kind, int(row["n_rows"]), len(scope.all_fields), [f.name for f in scope.all_fields], schema, sum(missing.values()), summary, pipeline=pipeline_of(df), controls=controls, **more)
    return snapshot, row


def with_changes(snapshot: Snapshot, trail: AuditTrail) -> Snapshot:
    return Snapshot(**{**snapshot.__dict__, "changes": changes_between(trail.snapshots[-1], snapshot) if trail.snapshots else None})


def controls_of(numeric_summary: bool, cols_include: Sequence[str] | None, cols_exclude: Sequence[str] | None) -> dict:
    return {"numeric_summary": numeric_summary, "cols_include": None if cols_include is None else list(cols_include), "cols_exclude": None if cols_exclude is None else list(cols_exclude)}


def audit_tap(
    df: DataFrame,
    trail: AuditTrail,
    label: str | None = None,
    fns: Mapping[str, Callable[[DataFrame], Any] | Column] | Sequence[Callable[[DataFrame], Any] | Column] | None = None,
    numeric_summary: bool = True,
    cols_include: Sequence[str] | None = None,
    cols_exclude: Sequence[str] | None = None,
    quantiles: str = "auto",
    cache: bool = False,
) -> DataFrame:
    """Records a snapshot of df and returns df unchanged (persisted, with cache=True, so that later taps don't compute it anew).

    fns: custom diagnostics by name: functions of the frame, or aggregate Columns, which join the snapshot's own pass.
    Unnamed ones are called fn_<i>. quantiles: "auto" (exact, by the input's size in one pass or by a distributed sort), "exact", "sorted" or "approximate".
    """
    check_trail(trail)
    check_frame(df)
    label = trail.check_label(label, f"step_{len(trail) + 1}")
    scope = scope_of(df, numeric_summary, cols_include, cols_exclude, quantiles)
    named = {str(k) if k else f"fn_{i}": f for i, (k, f) in enumerate(fns.items() if isinstance(fns, Mapping) else ((None, f) for f in fns or ()), 1)}
    for key, fn in named.items():
        if not callable(fn) and not isinstance(fn, Column):
            raise TypeError(f"fns: {key} must be a function or an aggregate Column")
    if cache:
        df = df.persist()
        trail._persisted.append(df)
    columns = {k: f for k, f in named.items() if isinstance(f, Column)}
    snapshot, row = build_snapshot(df, trail, label, "tap", scope, controls_of(numeric_summary, cols_include, cols_exclude), extra=tuple(c.alias(f"fn:{k}") for k, c in columns.items()))
    custom = {k: row[f"fn:{k}"] if k in columns else f(df) for k, f in named.items()}
    trail.append(with_changes(Snapshot(**{**snapshot.__dict__, "custom": custom or None}), trail))
    return df


__all__ = ["AuditTrail", "Changes", "Snapshot", "audit_tap", "audit_trail", "check_columns"]
