"""Filters with diagnostics: what they drop, what share of a measure goes with it, and how often the predicate is missing.

Keeping takes rows where the predicate is true; dropping takes away only those, so rows where it is missing stay."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe.functions.types import both, check_frame, check_share, condition, is_numeric, label_of
from ledgerframe.operators.trail import AuditTrail, Snapshot, build_snapshot, check_trail, controls_of, scope_of, with_changes


def _flag(predicates: Sequence[Column | str], drop: bool) -> Column:
    """Whether a row stays."""
    if not predicates:
        return F.lit(True)
    held = F.coalesce(both(predicates), F.lit(False))
    return ~held if drop else held


def _stat(df: DataFrame, stat: Column | str | None) -> Column | None:
    if stat is None:
        return None
    found = df.select(condition(stat).alias("s")).schema[0]
    if not is_numeric(found):
        raise TypeError("stat must be numeric")
    value = condition(stat).cast("double")
    return F.when(~F.isnan(value), value)


def _aggregates(predicates: Sequence[Column | str], keep: Column, stat: Column | None) -> list[Column]:
    out = [F.count(F.lit(1)).alias("n_total"), F.count_if(keep).alias("n_kept"), F.count_if(both(predicates).isNull()).alias("n_na_in_filter")]
    if stat is not None:
        out += [F.coalesce(F.sum(stat), F.lit(0.0)).alias("stat_total"), F.coalesce(F.sum(F.when(keep, stat)), F.lit(0.0)).alias("stat_kept")]
    return out


def filter_diagnostics(df: DataFrame, *predicates: Column | str, stat: Column | str | None = None, drop: bool = False) -> DataFrame:
    """One row, lazily: n_total, n_dropped, pct_dropped, n_na_in_filter, stat_total, stat_dropped."""
    value = _stat(df, stat)
    row = df.agg(*_aggregates(predicates, _flag(predicates, drop), value))
    dropped = F.col("n_total") - F.col("n_kept")
    pct = F.when(F.col("n_total") > 0, 100.0 * dropped / F.col("n_total")).otherwise(0.0)
    none = F.lit(None).cast("double")
    stats = (F.col("stat_total"), F.col("stat_total") - F.col("stat_kept")) if value is not None else (none, none)
    return row.select("n_total", dropped.alias("n_dropped"), pct.alias("pct_dropped"), "n_na_in_filter", stats[0].alias("stat_total"), stats[1].alias("stat_dropped"))


def _said(row, verb: str, label: str, stat: Column | str | None) -> list[str]:  # noqa: ANN001
    share = f"{100 * (row.n_total - row.n_kept) / row.n_total:.2f}%" if row.n_total else "N/A"
    out = [f"{verb}({label})", f"Dropped {row.n_total - row.n_kept:,} of {row.n_total:,} rows ({share})."]
    if stat is not None:
        lost = row.stat_total - row.stat_kept
        part = f"{100 * lost / row.stat_total:.2f}%" if abs(row.stat_total) > 1.5e-8 else "N/A"
        out.append(f"Dropped {lost:,.2f} of {row.stat_total:,.2f} for {label_of(stat)} ({part}).")
    return out


def _warned(dropped: int, total: int, threshold: float | None) -> None:
    if threshold is not None and total and dropped / total > threshold:
        warnings.warn(f"dropped {100 * dropped / total:.1f}% of rows, which exceeds threshold {100 * threshold:g}%", stacklevel=4)


def _filtered(df: DataFrame, predicates: Sequence[Column | str], stat: Column | str | None, quiet: bool, warn_threshold: float | None, drop: bool) -> DataFrame:
    check_frame(df)
    check_share(warn_threshold, "warn_threshold")
    keep, value = _flag(predicates, drop), _stat(df, stat)
    if not quiet or warn_threshold is not None:
        row = df.agg(*_aggregates(predicates, keep, value)).first()
        if not quiet:
            print("\n".join(_said(row, "filter_drop" if drop else "filter_keep", ", ".join(map(label_of, predicates)), stat)))
        _warned(row.n_total - row.n_kept, row.n_total, warn_threshold)
    return df.where(keep) if predicates else df


def filter_keep(df: DataFrame, *predicates: Column | str, stat: Column | str | None = None, quiet: bool = False, warn_threshold: float | None = None) -> DataFrame:
    """The rows where all predicates are true; reports what was dropped."""
    return _filtered(df, predicates, stat, quiet, warn_threshold, False)


def filter_drop(df: DataFrame, *predicates: Column | str, stat: Column | str | None = None, quiet: bool = False, warn_threshold: float | None = None) -> DataFrame:
    """The rows but those where all predicates are true; without predicates, all rows."""
    return _filtered(df, predicates, stat, quiet, warn_threshold, True)


def _tapped(df: DataFrame, predicates: Sequence[Column | str], trail: AuditTrail | None, label: str | None, stat: Column | str | None, quiet: bool, warn_threshold: float | None, numeric_summary: bool, cols_include: Sequence[str] | None, cols_exclude: Sequence[str] | None, quantiles: str, drop: bool) -> DataFrame:
    check_frame(df)
    check_share(warn_threshold, "warn_threshold")
    if trail is None:
        if label is not None:
            warnings.warn("label has no effect without a trail", stacklevel=3)
        if stat is not None or warn_threshold is not None or quiet:
            return _filtered(df, predicates, stat, quiet, warn_threshold, drop)
        return df.where(_flag(predicates, drop)) if predicates else df
    check_trail(trail)
    label = trail.check_label(label, f"filter_{'out_' if drop else ''}{len(trail) + 1}")
    keep, value = _flag(predicates, drop), _stat(df, stat)
    scope = scope_of(df, numeric_summary, cols_include, cols_exclude, quantiles)
    snapshot, row = build_snapshot(df, trail, label, "filter", scope, controls_of(numeric_summary, cols_include, cols_exclude), keep, tuple(_aggregates(predicates, keep, value)))
    dropped = row.n_total - row.n_kept
    diagnostics = {
        "filter_type": "drop" if drop else "keep",
        "expr_label": " & ".join(map(label_of, predicates)),
        "n_dropped": dropped,
        "n_total": row.n_total,
        "pct_dropped": 100 * dropped / row.n_total if row.n_total else 0.0,
        "stat_dropped": row.stat_total - row.stat_kept if value is not None else None,
        "stat_total": row.stat_total if value is not None else None,
        "stat_col": label_of(stat) if stat is not None else None,
        "n_na_in_filter": row.n_na_in_filter,
    }
    trail.append(with_changes(Snapshot(**{**snapshot.__dict__, "diagnostics": diagnostics}), trail))
    if not quiet:
        print(f"{label}: dropped {dropped:,} of {row.n_total:,} rows ({diagnostics['pct_dropped']:.1f}%)")
        if value is not None:
            print(f"  {diagnostics['stat_col']}: dropped {diagnostics['stat_dropped']:,.2f} of {diagnostics['stat_total']:,.2f}")
    _warned(dropped, row.n_total, warn_threshold)
    return df.where(keep) if predicates else df


def filter_tap(df: DataFrame, *predicates: Column | str, trail: AuditTrail | None = None, label: str | None = None, stat: Column | str | None = None, quiet: bool = False, warn_threshold: float | None = None, numeric_summary: bool = True, cols_include: Sequence[str] | None = None, cols_exclude: Sequence[str] | None = None, quantiles: str = "auto") -> DataFrame:
    """A keeping filter that records a snapshot of its result with diagnostics, in one pass over its input. Without a trail: a filter."""
    return _tapped(df, predicates, trail, label, stat, quiet, warn_threshold, numeric_summary, cols_include, cols_exclude, quantiles, False)


def filter_out_tap(df: DataFrame, *predicates: Column | str, trail: AuditTrail | None = None, label: str | None = None, stat: Column | str | None = None, quiet: bool = False, warn_threshold: float | None = None, numeric_summary: bool = True, cols_include: Sequence[str] | None = None, cols_exclude: Sequence[str] | None = None, quantiles: str = "auto") -> DataFrame:
    """The same for a dropping filter."""
    return _tapped(df, predicates, trail, label, stat, quiet, warn_threshold, numeric_summary, cols_include, cols_exclude, quantiles, True)
