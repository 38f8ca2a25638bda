"""Frequency tables and crosstabs.

Counts combine on the map side; what comes after works on one row for each distinct value. A top-N cutoff takes the top rows
and gets the rest from the total. Positions and running shares of all values are prefix sums over range partitions (plans/running.py), so
a column of very many values is never put in order by one task; a table's rows reach the driver only to be shown."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerframe.functions.render import table_text
from ledgerframe.functions.types import check_columns, check_frame, is_missing, is_numeric, levels_of, name, present
from ledgerframe.operators.trail import AuditTrail, audit_tap
from ledgerframe.plans.running import running_sums, with_total

SORTS = ("value_asc", "value_desc", "freq_desc", "freq_asc")
NA_MODES = ("include", "exclude", "only")
DISPLAYS = ("count", "row_pct", "col_pct", "total_pct")
NA_LABEL, OTHER_LABEL = "<NA>", "(Other)"
MANY_VALUES = 50
#: Largest top-N cutoff whose rows one task puts in order.
FEW = 10_000
#: Rows of a table that are shown at most.
SHOWN = 500
#: Rank of special rows: after all values, <NA> before (Other).
_VALUE, _NA, _OTHER = 0, 1, 2


def _checked(df: DataFrame, variables: Sequence[str], wt: str | None, sort: str, cutoff: float | None, na: str, display: str) -> None:
    check_frame(df)
    if len(variables) not in (1, 2):
        raise ValueError("give one or two variables")
    check_columns(df, [*variables, *([wt] if wt else [])], "variables")
    for value, allowed, what in ((sort, SORTS, "sort"), (na, NA_MODES, "na"), (display, DISPLAYS, "display")):
        if value not in allowed:
            raise ValueError(f"{what} must be one of {', '.join(allowed)}")
    if cutoff is not None and (isinstance(cutoff, bool) or not isinstance(cutoff, (int, float)) or not math.isfinite(cutoff) or cutoff <= 0):
        raise ValueError("cutoff must be a positive number")
    if wt and not is_numeric(df.schema[wt]):
        raise TypeError("wt must be a numeric column")


def _none(df: DataFrame, variables: Sequence[str]) -> list[Column]:
    return [is_missing(name(v), df.schema[v]) for v in variables]


def _by_na(df: DataFrame, variables: Sequence[str], na: str) -> DataFrame:
    if na == "include":
        return df
    any_none = F.greatest(*_none(df, variables), F.lit(False))
    return df.where(any_none if na == "only" else ~any_none)


def _measure(df: DataFrame, wt: str | None) -> Column:
    if wt is None:
        return F.count(F.lit(1))
    return F.coalesce(F.sum(present(name(wt), df.schema[wt]).cast("double")), F.lit(0.0))


def _value(df: DataFrame, v: str) -> Column:
    return present(name(v), df.schema[v])


def _key(field: T.StructField, column: str) -> Column:
    """What values sort by: factors by level, numbers as numbers, else text."""
    if (levels := levels_of(field)) is not None:
        return F.array_position(F.array(*map(F.lit, levels)), F.col(column))
    return F.col(column) if is_numeric(field) or isinstance(field.dataType, (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)) else F.col(column).cast("string")


def _frequencies(df: DataFrame, v: str, wt: str | None) -> DataFrame:
    """value, key, special, freq: one row for each value; an unweighted factor shows levels without rows too."""
    field = df.schema[v]
    f = df.groupBy(_value(df, v).alias("value")).agg(_measure(df, wt).alias("freq"))
    if (levels := levels_of(field)) is not None and wt is None:
        all_levels = df.sparkSession.createDataFrame([(x,) for x in levels], "value string")
        f = f.join(all_levels, "value", "full").withColumn("freq", F.coalesce("freq", F.lit(0)))
    return f.select("value", _key(field, "value").alias("key"), F.when(F.col("value").isNull(), _NA).otherwise(_VALUE).alias("special"), "freq")


def _with_cutoff(f: DataFrame, cutoff: float | None) -> DataFrame:
    """f with the values beyond the cutoff as one (Other); `n_other` is the number of values in it, 0 elsewhere."""
    if cutoff is None:
        return f.withColumn("n_other", F.lit(0).cast("long"))
    order = [F.col("freq").desc(), F.col("special"), F.col("key")]
    if cutoff >= 1:
        top = f.orderBy(*order).limit(int(cutoff))
    else:
        ranked = with_total(running_sums(f, order, {"reached": F.col("freq")}), "freq", "all")
        before = F.col("reached") - F.col("freq")
        top = ranked.where((F.col("position") == 1) | (before < F.lit(cutoff) * F.col("all"))).drop("position", "reached", "all")
    total = f.agg(F.sum("freq").alias("f"), F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(0))
    kept = top.agg(F.sum("freq").alias("g"), F.count(F.lit(1)).alias("m")).withColumn("k", F.lit(0))
    rest = total.join(kept, "k").where("n > m")
    kinds = dict(f.dtypes)
    other = rest.select(F.lit(None).cast(kinds["value"]).alias("value"), F.lit(None).cast(kinds["key"]).alias("key"), F.lit(_OTHER).alias("special"), (F.col("f") - F.col("g")).cast(kinds["freq"]).alias("freq"), (F.col("n") - F.col("m")).alias("n_other"))
    return top.withColumn("n_other", F.lit(0).cast("long")).unionByName(other)


def _display_order(sort: str) -> list[Column]:
    key = F.col("key").desc() if sort == "value_desc" else F.col("key").asc()
    freq = {"freq_desc": [F.col("freq").desc()], "freq_asc": [F.col("freq").asc()]}.get(sort, [])
    return [F.col("special"), *freq, key]


def _label(value: str = "value", special: str = "special") -> Column:
    return F.when(F.col(special) == _OTHER, OTHER_LABEL).when(F.col(special) == _NA, NA_LABEL).otherwise(F.col(value).cast("string"))


def tab_df(df: DataFrame, variable: str, wt: str | None = None, sort: str = "value_asc", cutoff: float | None = None, na: str = "include") -> DataFrame:
    """A one-way table, lazily: position, value, freq, percent, cum_percent, n_other, special (1 for <NA>, 2 for (Other)).

    Its rows in order are persisted when it is first used."""
    _checked(df, [variable], wt, sort, cutoff, na, "count")
    rows = _with_cutoff(_frequencies(_by_na(df, [variable], na), variable, wt), cutoff)
    rows = with_total(rows, "freq", "total")
    rows = rows.withColumn("percent", F.when(F.col("total") != 0, F.round(F.lit(100.0) * F.col("freq") / F.col("total"), 1)).otherwise(0.0))
    if cutoff is not None and 1 <= cutoff <= FEW:
        # Of at most so many rows and (Other), one task keeps the order.
        order = Window.orderBy(*_display_order(sort))
        rows = rows.withColumns({"position": F.row_number().over(order), "running": F.sum("percent").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    else:
        rows = running_sums(rows, _display_order(sort), {"running": F.col("percent")})
    running = F.least(F.round("running", 1), F.lit(100.0))
    return rows.select(F.col("position").cast("int").alias("position"), _label().alias("value"), "freq", "percent", running.alias("cum_percent"), "n_other", "special")


def crosstab_df(df: DataFrame, row: str, column: str, wt: str | None = None, cutoff: float | None = None, na: str = "include") -> DataFrame:
    """A two-way table in long form, lazily: row_value, col_value, n, row_pct, col_pct, total_pct, row_special, col_special, and the
    sort keys row_key, col_key. Cells without rows are absent. The cutoff is on the row variable, by rows where both are present."""
    _checked(df, [row, column], wt, "value_asc", cutoff, na, "count")
    used = _by_na(df, [row, column], na)
    cells = used.groupBy(_value(df, row).alias("a"), _value(df, column).alias("b")).agg(_measure(df, wt).alias("n"))
    special = lambda c: F.when(F.col(c).isNull(), _NA).otherwise(_VALUE)
    cells = cells.withColumns({"row_special": special("a"), "col_special": special("b")})
    if cutoff is not None:
        complete = cells.where("a is not null and b is not null").groupBy("a").agg(F.sum("n").alias("freq"))
        f = complete.select(F.col("a").alias("value"), _key(df.schema[row], "a").alias("key"), F.lit(_VALUE).alias("special"), "freq")
        top = _with_cutoff(f, cutoff).where("special = 0").select(F.col("value").alias("kept"))
        cells = cells.join(top, F.col("a") == F.col("kept"), "left")
        swallowed = F.col("a").isNotNull() & F.col("kept").isNull()
        cells = cells.select(F.when(~swallowed, F.col("a")).alias("a"), "b", "n", F.when(swallowed, _OTHER).otherwise(F.col("row_special")).alias("row_special"), "col_special")
        cells = cells.groupBy("a", "b", "row_special", "col_special").agg(F.sum("n").alias("n"))
    # Cells and margins from one grouping of the cells, which the raw rows have become before. A margin is joined back by its value: many cells of one
    # value are the large side of that join, which adaptive execution splits.
    down, across = ["a", "row_special"], ["b", "col_special"]
    sets = cells.groupingSets([[F.col(c) for c in g] for g in ([*down, *across], down, across, [])], *map(F.col, [*down, *across])).agg(F.grouping_id().alias("level"), F.sum("n").alias("n"))
    level = lambda k: sets.where(F.col("level") == k)
    cells = level(0).select(*down, *across, "n").withColumn("total", level(15).select("n").scalar())
    for by, k, label in ((down, 3, "row_total"), (across, 12, "col_total")):
        margin = level(k).select(F.col(by[0]).alias("value"), F.col(by[1]).alias("special"), F.col("n").alias(label))
        cells = cells.join(margin, F.col(by[0]).eqNullSafe(F.col("value")) & (F.col(by[1]) == F.col("special")), "left").drop("value", "special")
    share = lambda whole: F.when(whole != 0, F.lit(100.0) * F.col("n") / whole).otherwise(0.0)
    return cells.select(
        _label("a", "row_special").alias("row_value"),
        _label("b", "col_special").alias("col_value"),
        "n",
        share(F.col("row_total")).alias("row_pct"),
        share(F.col("col_total")).alias("col_pct"),
        share(F.col("total")).alias("total_pct"),
        "row_special",
        "col_special",
        _key(df.schema[row], "a").alias("row_key"),
        _key(df.schema[column], "b").alias("col_key"),
    )


def missing_counts_df(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """n_obs and n_missing (rows where any variable is missing), before any choice of missing values."""
    return df.agg(F.count(F.lit(1)).alias("n_obs"), F.count_if(F.greatest(*_none(df, variables), F.lit(False))).alias("n_missing"))


@dataclass(frozen=True)
class Tab:
    """A table made for display: the lazy frame, and figures of it. Its rows are collected when they are asked for."""

    variables: list[str]
    frame: DataFrame
    n_obs: int
    n_missing: int
    n_other: int
    total: float
    wt: str | None
    sort: str
    display: str
    #: The levels of factors among the variables; a level without rows is shown.
    levels: tuple[list[str] | None, ...] = ()
    #: Rows of the frame: values, or cells of a crosstab.
    n_rows: int = 0

    @cached_property
    def rows(self) -> list[dict]:
        """All rows of the table; one way in order."""
        return [r.asDict() for r in (self.frame.orderBy("position") if len(self.variables) == 1 else self.frame).collect()]

    def to_df(self) -> DataFrame:
        """One-way: value, freq, percent, cum_percent; two-way: the long form of the counts. Real categories that look like special rows stay."""
        if len(self.variables) == 1:
            return self.frame.select("position", "value", "freq", "percent", "cum_percent")
        return self.frame.select("row_value", "col_value", "n", "row_pct", "col_pct", "total_pct")

    def matrix(self) -> tuple[list[str], list[str], dict[tuple[str, str], float]]:
        """Labels of rows and columns in display order, and the counts of the cells that have any."""
        label = lambda r, side: (r[f"{side}_special"], r[f"{side}_value"])
        out = []
        for side, levels in zip(("row", "col"), self.levels or (None, None), strict=True):
            keys: dict[tuple, list] = {(_VALUE, level): [i, 0.0] for i, level in enumerate(levels or (), 1)}
            for r in self.rows:
                keys.setdefault(label(r, side), [r[f"{side}_key"], 0.0])[1] += r["n"]
            order = sorted(keys, key=lambda k: (k[0], keys[k][0] is None, keys[k][0] if keys[k][0] is not None else 0))
            if self.sort == "value_desc":
                order.sort(key=lambda k: k[0], reverse=False)
                order = [*reversed([k for k in order if k[0] == _VALUE]), *[k for k in order if k[0] != _VALUE]]
            elif self.sort.startswith("freq"):
                order.sort(key=lambda k: (k[0], keys[k][1] if self.sort == "freq_asc" else -keys[k][1]))
            out.append([k[1] for k in order])
        return out[0], out[1], {(r["row_value"], r["col_value"]): r["n"] for r in self.rows}

    def __str__(self) -> str:
        foot = [f"N = {self.n_obs:,}; missing = {self.n_missing:,}" + (f"; weighted by {self.wt}" if self.wt else "")]
        if self.n_other:
            foot.append(f"{OTHER_LABEL} holds {self.n_other:,} values")
        if self.n_rows > SHOWN:
            foot.append(f"... and {self.n_rows - SHOWN:,} more; see to_df()")
        if len(self.variables) == 1:
            few = self.rows if self.n_rows <= SHOWN else [r.asDict() for r in self.frame.where(F.col("position") <= SHOWN).orderBy("position").collect()]
            rows = [(r["value"], r["freq"], f"{r['percent']:.1f}", f"{r['cum_percent']:.1f}") for r in few]
            return table_text(self.variables[0], ("Value", "Freq", "Percent", "Cum"), [*rows, ("Total", self.total, "100.0" if self.total else "0.0", "")], foot)
        if self.n_rows > SHOWN:
            few = self.to_df().orderBy(F.col("n").desc(), "row_value", "col_value").limit(SHOWN).collect()
            return table_text(" x ".join(self.variables), few[0].__fields__, [tuple(r) for r in few], foot)
        down, across, cells = self.matrix()
        part = {(r["row_value"], r["col_value"]): r[self.display] for r in self.rows} if self.display != "count" else {}
        cell = (lambda a, b: f"{part.get((a, b), 0.0):.1f}%") if part or self.display != "count" else (lambda a, b: cells.get((a, b), 0))
        body = [(a, *[cell(a, b) for b in across], sum(cells.get((a, b), 0) for b in across)) for a in down]
        return table_text(" x ".join(self.variables), ("", *across, "Total"), [*body, ("Total", *[sum(cells.get((a, b), 0) for a in down) for b in across], self.total)], foot)


def tab(df: DataFrame, *variables: str, wt: str | None = None, sort: str = "value_asc", cutoff: float | None = None, na: str = "include", display: str = "count") -> Tab:
    """A frequency table of one variable or a crosstab of two.

    wt: a column to sum instead of counting; cutoff: the most frequent N values (from 1 on) or those that make up a share (below 1),
    the rest as (Other); na: missing values included, excluded or alone. Many values without a cutoff are warned of."""
    _checked(df, variables, wt, sort, cutoff, na, display)
    totals = missing_counts_df(df, variables).first()
    if len(variables) == 1:
        frame = tab_df(df, variables[0], wt, sort, cutoff, na)
        row = frame.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n_other"), F.lit(0)).alias("other"), F.coalesce(F.sum("freq"), F.lit(0)).alias("total")).first()
        n_rows, n_other, total, n_values, levels = row.rows, row.other, row.total, row.rows, ()
    else:
        frame = crosstab_df(df, *variables, wt=wt, cutoff=cutoff, na=na)
        row = frame.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count_distinct("row_value", "row_special").alias("values"), F.count_distinct(F.when(F.col("row_special") == _VALUE, F.col("row_value"))).alias("kept")).first()
        n_rows, total, n_values = row.rows, row.total, row["values"]
        n_other, levels = 0, tuple(levels_of(df.schema[v]) for v in variables)
        if cutoff is not None:
            levels = (None, levels[1])
            complete = _by_na(df, variables, "exclude").select(_value(df, variables[0]).alias("v")).distinct().count()
            n_other = complete - row.kept
    if n_values > MANY_VALUES and cutoff is None:
        warnings.warn(f"{variables[0]} has {n_values} values; consider a cutoff", stacklevel=2)
    made = Tab(list(variables), frame, totals.n_obs, totals.n_missing, n_other, total, wt, sort, display, levels, n_rows)
    if n_rows <= SHOWN:
        # So small a table is taken as it is now.
        _ = made.rows
    return made


def tab_tap(df: DataFrame, *variables: str, trail: AuditTrail, label: str | None = None, wt: str | None = None, sort: str = "value_asc", cutoff: float | None = None, na: str = "include", display: str = "count", numeric_summary: bool = True, cols_include: Sequence[str] | None = None, cols_exclude: Sequence[str] | None = None, quantiles: str = "auto") -> DataFrame:
    """A tap that keeps the table as the custom diagnostic "tab(v1, v2)"."""
    made = lambda d: tab(d, *variables, wt=wt, sort=sort, cutoff=cutoff, na=na, display=display)
    return audit_tap(df, trail, label, {f"tab({', '.join(variables)})": made}, numeric_summary, cols_include, cols_exclude, quantiles)
