"""Trails, snapshots and differences as text."""

from __future__ import annotations

from collections import Counter
from typing import Any

from ledgerframe.functions.render import shortened, shown, signed, table_text
from ledgerframe.operators.diff import AuditDiff, audit_diff
from ledgerframe.operators.trail import AuditTrail, Snapshot, check_trail


def kind_text(s: Snapshot) -> str:
    """The type of a snapshot with the gist of its diagnostics."""
    d = s.diagnostics or {}
    if s.type == "join":
        return f"{d.get('join_type', 'join')}" + (f" ({d['relation']})" if d.get("relation") else "")
    return f"filter ({d.get('filter_type', 'keep')})" if s.type == "filter" else s.type


def changes_text(s: Snapshot) -> str:
    if s.changes is None:
        return ""
    c = s.changes
    parts = [f"{signed(v)} {what}" for v, what in ((c.row_delta, "rows"), (c.col_delta, "cols"), (c.na_delta, "NAs")) if v]
    return ", ".join([*parts, *[f"{t['column']}: {t['from']} to {t['to']}" for t in c.type_changes]]) or "no change"


def custom_text(value: Any) -> str:
    """A custom diagnostic in a line: scalars as they are, small mappings of scalars, else a marker."""
    scalar = lambda v: v is None or isinstance(v, (bool, int, float, str))
    if scalar(value):
        return shortened(shown(value))
    if isinstance(value, dict) and value and all(map(scalar, value.values())):
        return shortened(", ".join(f"{k}={shown(v)}" for k, v in value.items()))
    return f"<{type(value).__name__}>"


def trail_text(trail: AuditTrail, show_custom: bool = True) -> str:
    title = f"Audit trail {trail.name!r}: {len(trail)} snapshot{'' if len(trail) == 1 else 's'}, created {trail.created_at:%Y-%m-%d %H:%M:%S}"
    if not trail.snapshots:
        return f"{title}\n(no snapshots)"
    rows = [(s.index, s.label, kind_text(s), s.nrow, s.ncol, s.total_nas) for s in trail.snapshots]
    parts = [table_text(title, ("#", "Label", "Type", "Rows", "Cols", "NAs"), rows)]
    if show_custom and (notes := [(s.label, k, custom_text(v)) for s in trail.snapshots for k, v in (s.custom or {}).items()]):
        parts.append(table_text("Custom diagnostics", ("Label", "Name", "Value"), notes))
    if len(trail) > 1:
        parts.append(table_text("Changes", ("From", "To", "Change"), [(a.label, b.label, changes_text(b)) for a, b in zip(trail.snapshots, trail.snapshots[1:], strict=False)]))
    return "\n\n".join(parts)


def snapshot_text(s: Snapshot) -> str:
    parts = [table_text(f"Snapshot {s.label!r} (#{s.index}, {kind_text(s)})", ("Item", "Value"), [("Rows", f"{s.nrow:,}"), ("Columns", f"{s.ncol:,}"), ("Missing values", f"{s.total_nas:,}"), *([("Changes", changes_text(s))] if s.changes else [])])]
    if s.schema:
        parts.append(table_text("Columns", ("column", "type", "n_na"), [tuple(c.values()) for c in s.schema]))
    if s.numeric_summary:
        parts.append(table_text("Numeric summary", tuple(s.numeric_summary[0]), [tuple(c.values()) for c in s.numeric_summary]))
    for title, found in (("Diagnostics", s.diagnostics), ("Custom diagnostics", s.custom)):
        if found:
            parts.append(table_text(title, ("Item", "Value"), [(k, custom_text(v)) for k, v in found.items()]))
    return "\n\n".join(parts)


def diff_text(d: AuditDiff) -> str:
    a, b, c = d.before, d.after, d.changes
    rows = [("Rows", a.nrow, b.nrow, signed(c.row_delta)), ("Columns", a.ncol, b.ncol, signed(c.col_delta)), ("Missing values", a.total_nas, b.total_nas, signed(c.na_delta))]
    parts = [table_text(f"From {a.label!r} to {b.label!r}", ("Item", "From", "To", "Delta"), rows)]
    lines = [f"Columns added: {', '.join(c.cols_added) or 'none'}", f"Columns removed: {', '.join(c.cols_removed) or 'none'}", *[f"Type of {t['column']}: {t['from']} to {t['to']}" for t in c.type_changes]]
    parts.append("\n".join(lines))
    for title, found in (("Missing values by column", d.na_changes), ("Means of numeric columns", d.numeric_shifts)):
        if found:
            parts.append(table_text(title, ("column", "from", "to", "delta"), [tuple(x.values()) for x in found]))
    return "\n\n".join(parts)


def profile_text(s: Snapshot) -> str:
    """The last state: columns by type, columns with missing values, the numeric summary."""
    kinds = sorted(Counter(c["type"] for c in s.schema).items())
    parts = [table_text(f"Final profile ({s.label}): {s.nrow:,} rows, {s.ncol:,} columns", ("type", "columns"), kinds)]
    if holes := [(c["column"], c["n_na"], f"{100 * c['n_na'] / s.nrow:.1f}%" if s.nrow else "N/A") for c in s.schema if c["n_na"]]:
        parts.append(table_text("Columns with missing values", ("column", "n_na", "share"), holes))
    if s.numeric_summary:
        parts.append(table_text("Numeric summary", tuple(s.numeric_summary[0]), [tuple(c.values()) for c in s.numeric_summary]))
    return "\n\n".join(parts)


def audit_report(trail: AuditTrail, format: str = "console", show: bool = True) -> str:
    """The whole trail as text, printed unless show is false: summary, consecutive differences, controls, custom diagnostics, final profile."""
    check_trail(trail)
    if format != "console":
        raise ValueError("format must be 'console'")
    parts = [trail_text(trail)]
    parts += [diff_text(audit_diff(trail, i, i + 1)) for i in range(1, len(trail))]
    plain = {"numeric_summary": True, "cols_include": None, "cols_exclude": None}
    if limits := [(s.label, k, shown(v) if not isinstance(v, list) else ", ".join(v)) for s in trail.snapshots for k, v in (s.controls or {}).items() if v != plain.get(k)]:
        parts.append(table_text("Snapshot controls", ("Label", "Control", "Value"), limits))
    if trail.snapshots:
        parts.append(profile_text(trail.snapshots[-1]))
    text = "\n\n".join(parts)
    if show:
        print(text)
    return text
