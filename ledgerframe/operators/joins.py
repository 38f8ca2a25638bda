"""The six joins, with missing keys equal, and their taps, which record match rates, key relation and a measure's coverage."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe.functions.types import check_columns, check_frame, free_name, numbered
from ledgerframe.operators.trail import AuditTrail, Snapshot, build_snapshot, check_trail, controls_of, scope_of, with_changes
from ledgerframe.plans.ranges import range_join
from ledgerframe.operators.validate import By, JoinValidation, common_columns, key_pairs, validate_join

#: Spark's name of each join.
KINDS = {"left_join": "left", "right_join": "right", "inner_join": "inner", "full_join": "full", "anti_join": "left_anti", "semi_join": "left_semi"}


def normalize_by(by: By | Column | None) -> list[tuple[str, str]] | None:
    """Equal keys as pairs; None for natural and theta joins."""
    return None if by is None or isinstance(by, Column) else key_pairs(by)


def join_frames(x: DataFrame, y: DataFrame, by: By | Column | None = None, how: str = "left_join", on: str | None = None, suffix: tuple[str, str] = ("_x", "_y"), unmatched: str = "drop", multiple: str = "all") -> DataFrame:
    """Joins x and y.

    by: equal keys (a missing key equals a missing key); None: all common columns; a Column over both frames, or `on`, SQL over the
    aliases x and y, for any other condition: with an equality of both sides Spark joins by that, and comparisons alone are joined by
    buckets of one side's values (`plans/ranges.py`). Equal keys come out once, by x's name; other columns in both get the suffixes, as often
    as it takes to make their names differ from all others.
    unmatched="error" fails if a row of x has no match; multiple="error" if one has several, and "any" takes one of them.
    """
    kind = KINDS[how]
    if on is not None or isinstance(by, Column):
        return _theta(x, y, F.expr(on) if on is not None else by, kind, suffix)
    pairs = key_pairs(common_columns(x, y) if by is None else by)
    check_columns(x, [a for a, _ in pairs], "keys of x")
    check_columns(y, [b for _, b in pairs], "keys of y")
    if unmatched == "error" or multiple == "error":
        found = validate_join(x, y, pairs)
        if unmatched == "error" and found.n_only_x:
            raise ValueError(f"{found.n_only_x} rows of x have no match")
        if multiple == "error" and found.y_has_dups:
            raise ValueError("rows of x may have several matches: keys of y are duplicated")
    if multiple == "any":
        y = y.dropDuplicates([b for _, b in pairs])
    keys_x, keys_y = [a for a, _ in pairs], [b for _, b in pairs]
    left, right = numbered(x, "x"), numbered(y, "y")
    at_x, at_y = ({c: f"{letter}{i}" for i, c in enumerate(df.columns)} for letter, df in (("x", x), ("y", y)))
    match = F.lit(True)
    for a, b in pairs:
        match = match & F.col(at_x[a]).eqNullSafe(F.col(at_y[b]))
    joined = left.join(right, match, kind)
    if kind in ("left_semi", "left_anti"):
        return joined.toDF(*x.columns)
    from_y = {a: at_y[b] for a, b in pairs} if kind in ("right", "full") else {}
    rest_y = [c for c in y.columns if c not in keys_y]
    columns = [F.coalesce(at_x[c], from_y[c]) if c in from_y else F.col(at_x[c]) for c in x.columns] + [F.col(at_y[c]) for c in rest_y]
    names = _suffixed(x.columns, rest_y, keys_x, suffix)
    return joined.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)])


def _suffixed(names_x: list[str], names_y: list[str], keys: list[str], suffix: tuple[str, str]) -> list[str]:
    """Names of the columns of x and then y. Those in both get their side's suffix, but for keys of x, which keep their names."""
    keep_x, keep_y = [c for c in names_x if c in keys or c not in names_y], [c for c in names_y if c not in names_x]
    taken, out = [*keep_x, *keep_y], []
    for names, keep, more in ((names_x, keep_x, suffix[0]), (names_y, keep_y, suffix[1])):
        for c in names:
            out.append(c if c in keep else free_name(c + more, taken, more))
            if c not in keep:
                taken.append(out[-1])
    return out


def _theta(x: DataFrame, y: DataFrame, match: Column, kind: str, suffix: tuple[str, str]) -> DataFrame:
    left, right = x.alias("x"), y.alias("y")
    joined = range_join(left, right, match, kind)
    if joined is None:
        joined = left.join(right, match, kind)
    if kind in ("left_semi", "left_anti"):
        return joined.select("x.*")
    quoted = lambda side, c: F.col(f"{side}.`{c}`")
    names = _suffixed(x.columns, y.columns, [], suffix)
    return joined.select(*[c.alias(n) for c, n in zip([*[quoted("x", c) for c in x.columns], *[quoted("y", c) for c in y.columns]], names, strict=True)])


def _tapped(how: str, x: DataFrame, y: DataFrame, by: By | Column | None, trail: AuditTrail | None, label: str | None, stat: str | None, numeric_summary: bool, cols_include: Sequence[str] | None, cols_exclude: Sequence[str] | None, y_name: str, quantiles: str, **options) -> DataFrame:  # noqa: ANN003
    check_frame(x, "x"), check_frame(y, "y")
    pairs = normalize_by(by) if options.get("on") is None else None
    if trail is None:
        if label is not None:
            warnings.warn("label has no effect without a trail", stacklevel=3)
        if stat is not None:
            try:
                print(_validated(x, y, pairs, stat))
            except Exception as error:  # noqa: BLE001  diagnostics never stop a join
                warnings.warn(f"the join could not be validated: {error}", stacklevel=3)
        return join_frames(x, y, by, how, **options)
    check_trail(trail)
    label = trail.check_label(label, f"{how}_{len(trail) + 1}")
    diagnostics: dict = {"join_type": how, "y_name": y_name}
    if pairs is not None:
        try:
            diagnostics |= _enriched(_validated(x, y, pairs, stat), stat)
        except Exception as error:  # noqa: BLE001  a join that can't be validated keeps its basic snapshot
            diagnostics["validation_error"] = str(error)
    joined = join_frames(x, y, by, how, **options)
    scope = scope_of(joined, numeric_summary, cols_include, cols_exclude, quantiles)
    snapshot, _ = build_snapshot(joined, trail, label, "join", scope, controls_of(numeric_summary, cols_include, cols_exclude), diagnostics=diagnostics)
    trail.append(with_changes(snapshot, trail))
    return joined


def _validated(x: DataFrame, y: DataFrame, pairs: list[tuple[str, str]] | None, stat: str | None) -> JoinValidation:
    if pairs is None:
        raise ValueError("only joins by equal keys can be validated")
    in_x, in_y = (stat if stat in df.columns else None for df in (x, y))
    if stat is not None and not in_x and not in_y:
        raise ValueError(f"stat column {stat!r} is in neither table")
    return validate_join(x, y, pairs, stat_x=in_x, stat_y=in_y)


def _enriched(found: JoinValidation, stat: str | None) -> dict:
    out = {k: found.metrics[k] for k in ("relation", "n_only_x", "n_only_y", "x_has_dups", "y_has_dups", "n_key_overlap", "n_matched_pairs")}
    out["match_rate"] = {"x": found.match_rate_x, "y": found.match_rate_y}
    out["stat"] = None if stat is None else {"column": stat} | {k: v for k, v in found.metrics.asDict().items() if k.startswith("stat_")}
    return out


def _tap(how: str) -> Callable[..., DataFrame]:
    def tap(x: DataFrame, y: DataFrame, by: By | Column | None = None, *, trail: AuditTrail | None = None, label: str | None = None, stat: str | None = None, numeric_summary: bool = True, cols_include: Sequence[str] | None = None, cols_exclude: Sequence[str] | None = None, y_name: str = "y", quantiles: str = "auto", on: str | None = None, suffix: tuple[str, str] = ("_x", "_y"), unmatched: str = "drop", multiple: str = "all") -> DataFrame:
        return _tapped(how, x, y, by, trail, label, stat, numeric_summary, cols_include, cols_exclude, y_name, quantiles, on=on, suffix=suffix, unmatched=unmatched, multiple=multiple)

    tap.__name__ = tap.__qualname__ = f"{how}_tap"
    tap.__doc__ = f"{how.replace('_', ' ').capitalize()} that records a snapshot of its result; see join_frames for the conditions. With equal keys the snapshot has the join's diagnostics, for `stat` also the measure's coverage."
    return tap


left_join_tap, right_join_tap, inner_join_tap, full_join_tap, anti_join_tap, semi_join_tap = map(_tap, KINDS)
__all__ = ["KINDS", "Snapshot", "anti_join_tap", "full_join_tap", "inner_join_tap", "join_frames", "left_join_tap", "normalize_by", "right_join_tap", "semi_join_tap"]
