"""Differences between any two snapshots of a trail."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ledgerframe.operators.trail import AuditTrail, Changes, Snapshot, changes_between, check_trail

_DIFF = "kind string, column string, from_value string, to_value string, delta double"


def resolve_snapshot(trail: AuditTrail, at: str | int) -> Snapshot:
    """A snapshot by label or by its number from 1."""
    if isinstance(at, str):
        if at not in trail.labels:
            raise KeyError(f"no snapshot is labelled {at!r}; there are: {', '.join(trail.labels) or 'none'}")
        return trail.snapshots[trail.labels.index(at)]
    if isinstance(at, bool) or not isinstance(at, int):
        raise TypeError("a snapshot is given by label or whole number")
    if not 1 <= at <= len(trail):
        raise IndexError(f"there is no snapshot {at}; the trail has {len(trail)}")
    return trail.snapshots[at - 1]


def na_changes(before: Snapshot, after: Snapshot) -> list[dict] | None:
    """Common columns whose number of missing values changed."""
    old = {c["column"]: c["n_na"] for c in before.schema}
    found = [{"column": c["column"], "from": old[c["column"]], "to": c["n_na"], "delta": c["n_na"] - old[c["column"]]} for c in after.schema if c["column"] in old and c["n_na"] != old[c["column"]]]
    return found or None


def mean_shifts(before: Snapshot, after: Snapshot) -> list[dict] | None:
    """The means of all numeric columns summarised on both sides."""
    old = {c["column"]: c["mean"] for c in before.numeric_summary or ()}
    out = []
    for c in after.numeric_summary or ():
        if c["column"] in old:
            a, b = old[c["column"]], c["mean"]
            out.append({"column": c["column"], "from": a, "to": b, "delta": None if a is None or b is None else b - a})
    return out or None


@dataclass(frozen=True)
class AuditDiff:
    before: Snapshot
    after: Snapshot
    changes: Changes
    na_changes: list[dict] | None
    numeric_shifts: list[dict] | None

    def to_df(self, spark: SparkSession) -> DataFrame:
        """One row for each difference: kind, column, from_value, to_value, delta."""
        c, text = self.changes, lambda v: None if v is None else str(v)
        rows = [(k, None, str(a), str(b), float(b - a)) for k, a, b in (("rows", self.before.nrow, self.after.nrow), ("columns", self.before.ncol, self.after.ncol), ("missing values", self.before.total_nas, self.after.total_nas))]
        rows += [("column added", x, None, None, None) for x in c.cols_added] + [("column removed", x, None, None, None) for x in c.cols_removed]
        rows += [("type changed", t["column"], t["from"], t["to"], None) for t in c.type_changes]
        for kind, found in (("missing values of a column", self.na_changes), ("mean", self.numeric_shifts)):
            rows += [(kind, x["column"], text(x["from"]), text(x["to"]), None if x["delta"] is None else float(x["delta"])) for x in found or ()]
        return spark.createDataFrame(rows, _DIFF)

    def __str__(self) -> str:
        from ledgerframe.operators.report import diff_text

        return diff_text(self)


def audit_diff(trail: AuditTrail, from_: str | int, to: str | int) -> AuditDiff:
    """The differences from one snapshot to another, in either order of the trail."""
    check_trail(trail)
    before, after = resolve_snapshot(trail, from_), resolve_snapshot(trail, to)
    return AuditDiff(before, after, changes_between(before, after), na_changes(before, after), mean_shifts(before, after))
