"""Reconciling two tables: schemas, keys, and values within a tolerance.

Matched rows are one null-safe join of pruned projections; all summaries of all columns come from one aggregate over it, and
discrepant cells stay a lazy frame, made by unpivoting only the cells that differ."""

from __future__ import annotations

import math
import sys
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe.functions.render import table_text
from ledgerframe.functions.types import check_columns, check_frame, class_name, free_name, is_missing, is_numeric, name, numbered, present, to_rows
from ledgerframe.operators.validate import stacked_counts
from ledgerframe.plans.profile import checked_way, quantile_columns
from ledgerframe.plans.rowids import file_numbered
from ledgerframe.plans.running import first_of_each

EPSILON = sys.float_info.epsilon
_INDEX = "row_index"
#: Names of what a differing cell says.
_CELL = ("column", "type", "value_x", "value_y", "abs_diff", "pct_diff")
_FIVE = ("min", "q25", "median", "q75", "max")


def row_indexed(df: DataFrame, order_by: Sequence[Column | str] | None, index: str = _INDEX) -> DataFrame:
    """df with its rows' numbers from 1 in `index`, in the given order or else as read.

    Rows of Parquet files, in no other order, are numbered by file and place (`plans/rowids.py`), and nothing is kept. All others are numbered
    inside their partitions and shifted by a prefix sum over the partitions' sizes, so the order is distributed; that numbered frame is
    persisted, because both passes must see the same partitions."""
    names = [f"c{i}" for i in range(len(df.columns))]
    if not order_by and (known := file_numbered(df, names, "n")) is not None:
        return known.toDF(*df.columns, index)
    ordered = df.orderBy(*order_by) if order_by else df
    rows = numbered(ordered, "c").withColumn("m", F.monotonically_increasing_id()).persist()
    part, place = F.shiftright("m", 33), F.col("m").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # One row for each partition.
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("start"))
    indexed = rows.withColumns({"place": place + 1, "part": part}).join(starts, "part")
    return indexed.select(*rows.columns[:-1], F.col("place") + F.col("start")).toDF(*df.columns, index)


@dataclass(frozen=True)
class Plan:
    """How two tables are compared, from their schemas and arguments alone."""

    x: DataFrame
    y: DataFrame
    keys: list[str]
    by_index: bool
    common: list[str]
    only_x_columns: list[str]
    only_y_columns: list[str]
    type_mismatches: list[dict]
    numeric: list[str]
    categorical: list[str]
    tol: float
    top_n: float
    quantiles: str = "auto"

    @property
    def values(self) -> list[str]:
        return [*self.numeric, *self.categorical]


def plan_comparison(x: DataFrame, y: DataFrame, key_cols: Sequence[str] | None = None, tol: float = EPSILON, top_n: float = math.inf, compare_cols: Sequence[str] | None = None, exclude_cols: Sequence[str] | None = None, order_by: Sequence[Column | str] | None = None, quantiles: str = "auto") -> Plan:
    check_frame(x, "x"), check_frame(y, "y")
    if isinstance(tol, bool) or not isinstance(tol, (int, float)) or math.isnan(tol) or tol < 0:
        raise ValueError("tol must be a single non-negative number")
    if isinstance(top_n, bool) or not isinstance(top_n, (int, float)) or math.isnan(top_n) or top_n <= 0:
        raise ValueError("top_n must be a single positive number")
    if compare_cols is not None and exclude_cols is not None:
        raise ValueError("compare_cols and exclude_cols can't both be given")
    common = [c for c in x.columns if c in y.columns]
    if not common:
        raise ValueError("the tables have no columns in common")
    classes = {c: (class_name(x.schema[c]), class_name(y.schema[c])) for c in common}
    mismatches = [{"column": c, "type_x": a, "type_y": b} for c, (a, b) in classes.items() if a != b]
    keys = [c for c, (a, b) in classes.items() if a == b and a in ("integer", "factor", "character")] if key_cols is None else list(key_cols)
    check_columns(x, keys, "key columns of x")
    check_columns(y, keys, "key columns of y")
    if wrong := [k for k in keys if classes[k][0] != classes[k][1]]:
        raise TypeError(f"key columns differ in type: {', '.join(wrong)}")
    values = [c for c in common if c not in keys]
    for given in (compare_cols, exclude_cols):
        if given is not None and (isinstance(given, str) or not all(isinstance(c, str) for c in given)):
            raise TypeError("compare_cols and exclude_cols must be lists of column names")
    if compare_cols is not None:
        if lost := [c for c in compare_cols if c not in values]:
            raise ValueError(f"compare_cols are no value columns of both tables: {', '.join(lost)}")
        values = [c for c in values if c in compare_cols]
    if exclude_cols is not None:
        if lost := [c for c in exclude_cols if c not in values]:
            warnings.warn(f"exclude_cols are no value columns of both tables: {', '.join(lost)}", stacklevel=3)
        values = [c for c in values if c not in exclude_cols]
    same = [c for c in values if classes[c][0] == classes[c][1]]
    numeric = [c for c in same if is_numeric(x.schema[c])]
    by_index, only_x, only_y = not keys, [c for c in x.columns if c not in common], [c for c in y.columns if c not in common]
    if by_index:
        keys = [free_name(_INDEX, [*x.columns, *y.columns])]
        x, y = row_indexed(x, order_by, keys[0]), row_indexed(y, order_by, keys[0])
    return Plan(x, y, keys, by_index, common, only_x, only_y, mismatches, numeric, [c for c in same if c not in numeric], float(tol), top_n, checked_way(quantiles))


def matched_rows(p: Plan) -> DataFrame:
    """The keys k<i>, and for each value column k the pair x<k>, y<k>."""
    left = p.x.select(*[name(c).alias(f"k{i}") for i, c in enumerate(p.keys)], *[name(c).alias(f"x{k}") for k, c in enumerate(p.values)])
    right = p.y.select(*[name(c).alias(f"j{i}") for i, c in enumerate(p.keys)], *[name(c).alias(f"y{k}") for k, c in enumerate(p.values)])
    match = F.lit(True)
    for i in range(len(p.keys)):
        match = match & F.col(f"k{i}").eqNullSafe(F.col(f"j{i}"))
    return left.join(right, match).drop(*[f"j{i}" for i in range(len(p.keys))])


@dataclass(frozen=True)
class _Cell:
    """Expressions of one value column in a matched row."""

    column: str
    numeric: bool
    x: Column
    y: Column
    none_x: Column
    none_y: Column
    diff: Column
    differs: Column


def _cells(p: Plan) -> list[_Cell]:
    out = []
    for k, c in enumerate(p.values):
        fx, fy, x, y = p.x.schema[c], p.y.schema[c], F.col(f"x{k}"), F.col(f"y{k}")
        none_x, none_y = is_missing(x, fx), is_missing(y, fy)
        if c in p.numeric:
            x, y = present(x, fx).cast("double"), present(y, fy).cast("double")
            # Equal infinities differ by nothing; opposite ones by infinity.
            diff = F.when(x == y, F.lit(0.0)).otherwise(F.abs(x - y))
            differs = F.coalesce(diff > p.tol, F.lit(False)) | (none_x != none_y)
        else:
            x, y, diff = x.cast("string"), y.cast("string"), F.lit(None).cast("double")
            differs = ~x.eqNullSafe(y)
        out.append(_Cell(c, c in p.numeric, x, y, none_x, none_y, diff, differs))
    return out


def comparison_row(p: Plan) -> DataFrame:
    """All summaries as one row, lazily: rows_matched, rows_with_disc and for each column its own."""
    rows, cells = matched_rows(p), _cells(p)
    aggregates, any_differs = [], F.lit(False)
    ranked = iter(quantile_columns(rows, [c.diff for c in cells if c.numeric], p.quantiles))
    for k, c in enumerate(cells):
        any_differs = any_differs | c.differs
        compared = F.count(c.diff) if c.numeric else F.count_if(~(c.none_x & c.none_y))
        aggregates += [compared.alias(f"n{k}"), F.count_if(c.differs).alias(f"d{k}"), F.count_if(c.none_x != c.none_y).alias(f"m{k}")]
        if c.numeric:
            aggregates.append(next(ranked).alias(f"q{k}"))
    return rows.agg(F.count(F.lit(1)).alias("rows_matched"), F.count_if(any_differs).alias("rows_with_disc"), *aggregates)


def numeric_summary_df(p: Plan) -> DataFrame:
    """column, n, min, q25, median, q75, max, n_over_tol of each numeric column with anything to compare."""
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"n{k}").alias("n"), *[F.get(F.col(f"q{k}"), F.lit(j)).alias(s) for j, s in enumerate(_FIVE)], F.col(f"d{k}").alias("n_over_tol")) for k, c in enumerate(p.values) if c in p.numeric]
    return to_rows(comparison_row(p), structs).where("n > 0 or n_over_tol > 0")


def categorical_summary_df(p: Plan) -> DataFrame:
    """column, n_compared, n_mismatched, pct_mismatched (a proportion), n_na_mismatch."""
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"n{k}").alias("n_compared"), F.col(f"d{k}").alias("n_mismatched"), (F.col(f"d{k}") / F.nullif(F.col(f"n{k}"), F.lit(0))).alias("pct_mismatched"), F.col(f"m{k}").alias("n_na_mismatch")) for k, c in enumerate(p.values) if c in p.categorical]
    return to_rows(comparison_row(p), structs).where("n_compared > 0")


def match_summary_df(p: Plan) -> DataFrame:
    """only_x, only_y, matched_no_disc, matched_with_disc and their proportions, as one row, lazily."""
    counts = key_overlap_df(p)
    row = comparison_row(p).select(F.lit(0).alias("k"), "rows_matched", "rows_with_disc")
    row = row.join(counts.withColumn("k", F.lit(0)), "k")
    clean = F.col("rows_matched") - F.col("rows_with_disc")
    share = lambda c: F.when(F.col("rows_matched") > 0, c / F.col("rows_matched"))
    return row.select("only_x", "only_y", clean.alias("matched_no_disc"), F.col("rows_with_disc").alias("matched_with_disc"), share(clean).alias("pct_no_disc"), share(F.col("rows_with_disc")).alias("pct_with_disc"))


def key_overlap_df(p: Plan) -> DataFrame:
    """matches, only_x, only_y: distinct keys; and dups: whether either side repeats a key."""
    return _overlap(p).drop("rows_x", "rows_y")


def _overlap(p: Plan) -> DataFrame:
    """`key_overlap_df` with the rows of both sides."""
    counts = stacked_counts(p.x, p.y, p.keys)
    rows = [F.coalesce(F.sum(f"n_{s}"), F.lit(0)).alias(f"rows_{s}") for s in ("x", "y")]
    return counts.agg(*rows, F.count_if(F.col("n_x").isNotNull() & F.col("n_y").isNotNull()).alias("matches"), F.count_if(F.col("n_y").isNull()).alias("only_x"), F.count_if(F.col("n_x").isNull()).alias("only_y"), F.coalesce(F.max(F.greatest(F.coalesce("n_x", F.lit(0)), F.coalesce("n_y", F.lit(0)))) > 1, F.lit(False)).alias("dups"))


def _differing(p: Plan, cells: list[_Cell], kind: str) -> DataFrame:
    """k<i> and c: a struct of _CELL for each differing cell, with values of the given type; at most top_n a column, the largest
    differences first, missing ones last, then by key."""
    structs = []
    for c in cells:
        largest = F.greatest(F.abs(c.x), F.abs(c.y)) if c.numeric else F.lit(None).cast("double")
        pct = F.when(c.diff.isNull(), F.lit(None)).when(largest == 0, F.lit(0.0)).otherwise(c.diff / largest).cast("double")
        values = (F.lit(c.column), F.lit("numeric" if c.numeric else "categorical"), c.x.cast(kind), c.y.cast(kind), c.diff, pct)
        structs.append(F.when(c.differs, F.struct(*[v.alias(n) for n, v in zip(_CELL, values, strict=True)])))
    keys = [f"k{i}" for i in range(len(p.keys))]
    none = f"array<struct<column:string,type:string,value_x:{kind},value_y:{kind},abs_diff:double,pct_diff:double>>"
    rows = matched_rows(p).select(*keys, F.explode(F.filter(F.array(*structs) if structs else F.array().cast(none), lambda c: c.isNotNull())).alias("c"))
    if math.isinf(p.top_n):
        return rows
    return first_of_each(rows, F.col("c.column"), [F.col("c.abs_diff").desc_nulls_last(), *map(F.col, keys)], int(p.top_n))


def _named(p: Plan, rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Keys by their names and the fields of c, of which one that a key is called like gets underscores."""
    names = list(p.keys)
    for f in fields:
        names.append(free_name(f, names))
    return rows.select(*[f"k{i}" for i in range(len(p.keys))], *[f"c.{f}" for f in fields]).toDF(*names)


def discrepancies_df(p: Plan, numeric: bool) -> DataFrame:
    """One row for each differing cell: keys, column, value_x, value_y, for numbers also abs_diff and pct_diff; at most top_n a column,
    the largest differences first, missing ones last, then by key. Rows that a large top_n puts in order are persisted."""
    rows = _differing(p, [c for c in _cells(p) if c.numeric == numeric], "double" if numeric else "string")
    return _named(p, rows, [f for f in _CELL if f != "type" and (numeric or not f.endswith("_diff"))])


def tidy_df(p: Plan) -> DataFrame:
    """All differing cells of both kinds, from one join: keys, column, type, value_x, value_y (as text), abs_diff, pct_diff."""
    return _named(p, _differing(p, _cells(p), "string"), _CELL)


@dataclass(frozen=True)
class Comparison:
    """The result of compare_tables: summaries collected, cells and keys lazy."""

    plan: Plan
    comparison_method: str | None
    n_rows: tuple[int, int]
    key_summary: dict
    match_summary: dict
    numeric_summary: list[dict] | None
    categorical_summary: list[dict] | None
    total_discrepancies: int
    discrepancies: DataFrame | None = None
    categorical_discrepancies: DataFrame | None = None
    only_x_keys: DataFrame | None = None
    only_y_keys: DataFrame | None = None
    type_mismatches: list[dict] = field(default_factory=list)

    def to_df(self) -> DataFrame:
        return tidy_df(self.plan)

    def release(self) -> None:
        """Frees what row-index comparison has persisted."""
        if self.plan.by_index:
            self.plan.x.unpersist(), self.plan.y.unpersist()

    def _remaining(self, total: int, displayed: int) -> list[str]:
        """How many are not displayed, and how many were stored if top_n left some out."""
        stored = f" ({self.plan.top_n:,} stored)" if self.plan.top_n < total else ""
        return [f"... and {total - displayed:,} more{stored}"] if total > displayed else []

    def text(self, show_n: int = 5) -> str:
        p, m = self.plan, self.match_summary
        parts = [table_text("1. Columns", ("Item", "Value"), [("Common", len(p.common)), ("Only in x", ", ".join(p.only_x_columns) or "-"), ("Only in y", ", ".join(p.only_y_columns) or "-")])]
        if self.type_mismatches:
            parts.append(table_text("Type mismatches", ("column", "x", "y"), [tuple(t.values()) for t in self.type_mismatches]))
        parts.append(table_text(f"2. Rows ({self.comparison_method or 'keys only'}: {', '.join(p.keys)})", ("Item", "Value"), [("Rows in x", self.n_rows[0]), ("Rows in y", self.n_rows[1]), *m.items()]))
        if self.numeric_summary:
            parts.append(table_text(f"3. Numeric differences (tolerance {p.tol:g})", tuple(self.numeric_summary[0]), [tuple(r.values()) for r in self.numeric_summary]))
        if self.categorical_summary:
            parts.append(table_text("4. Other differences", tuple(self.categorical_summary[0]), [tuple(r.values()) for r in self.categorical_summary]))
        totals = [sum(r[n] for r in rows or ()) for rows, n in ((self.numeric_summary, "n_over_tol"), (self.categorical_summary, "n_mismatched"))]
        shown = [("5. Largest numeric discrepancies", self.discrepancies, totals[0]), ("6. Other discrepancies", self.categorical_discrepancies, totals[1])]
        shown += [("7. Keys only in x", self.only_x_keys, m["only_x"]), ("8. Keys only in y", self.only_y_keys, m["only_y"])]
        for title, cells, total in shown:
            if cells is not None and total:
                rows = cells.limit(show_n).collect()
                parts.append(table_text(title, cells.columns, [tuple(r) for r in rows], self._remaining(total, len(rows))))
        parts.append(f"Discrepancies in all: {self.total_discrepancies:,}")
        return "\n\n".join(parts)

    def __str__(self) -> str:
        return self.text()


def compare_tables(x: DataFrame, y: DataFrame, key_cols: Sequence[str] | None = None, tol: float = EPSILON, top_n: float = math.inf, compare_cols: Sequence[str] | None = None, exclude_cols: Sequence[str] | None = None, order_by: Sequence[Column | str] | None = None, quantiles: str = "auto") -> Comparison:
    """Compares y with x by keys (found from the schemas unless given), or by row index with key_cols=[] (in the order of order_by).

    quantiles of the differences: see `WAYS` in plans/profile.py."""
    p = plan_comparison(x, y, key_cols, tol, top_n, compare_cols, exclude_cols, order_by, quantiles)
    overlap = _overlap(p).first()
    if overlap.dups:
        warnings.warn("keys are not unique: matched rows are all combinations of equal keys", stacklevel=2)
    found = comparison_row(p).first()
    index = {c: k for k, c in enumerate(p.values)}
    numeric = [{"column": c, "n": found[f"n{k}"], **dict(zip(_FIVE, found[f"q{k}"] or [None] * 5, strict=True)), "n_over_tol": found[f"d{k}"]} for c, k in index.items() if c in p.numeric and found[f"n{k}"] + found[f"d{k}"]]
    other = [{"column": c, "n_compared": found[f"n{k}"], "n_mismatched": found[f"d{k}"], "pct_mismatched": found[f"d{k}"] / found[f"n{k}"], "n_na_mismatch": found[f"m{k}"]} for c, k in index.items() if c in p.categorical and found[f"n{k}"]]
    rows, bad = found.rows_matched, found.rows_with_disc
    match = {"only_x": overlap.only_x, "only_y": overlap.only_y, "matched_no_disc": rows - bad, "matched_with_disc": bad, "pct_no_disc": (rows - bad) / rows if rows else None, "pct_with_disc": bad / rows if rows else None}
    counts = stacked_counts(p.x, p.y, p.keys)

    def only(which: str) -> DataFrame:
        rows = counts.where(which).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(p.keys)])
        return rows if math.isinf(p.top_n) else rows.limit(int(p.top_n))

    return Comparison(
        p,
        ("row_index" if p.by_index else "keys") if p.values else None,
        (overlap.rows_x, overlap.rows_y),
        {"matches": overlap.matches, "only_x": overlap.only_x, "only_y": overlap.only_y},
        match,
        numeric or None,
        other or None,
        sum(found[f"d{k}"] for k in index.values()),
        discrepancies_df(p, True) if p.numeric else None,
        discrepancies_df(p, False) if p.categorical else None,
        only("n_y is null"),
        only("n_x is null"),
        p.type_mismatches,
    )
