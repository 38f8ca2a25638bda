"""Audits of a column's transformation: what changed, and how its distribution moved, from one pass over before and after."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerframe.functions.render import table_text
from ledgerframe.functions.types import check_columns, check_frame, class_name, is_missing, levels_of, name
from ledgerframe.plans.profile import quantile_columns

TOLERANCE = math.sqrt(sys.float_info.epsilon)
EXAMPLES = 10
#: Levels that are listed of what a factor becomes, if it is no factor any more.
LEVELS = 10_000


def _pair(df: DataFrame, column: str, fn: Callable[[Column], Column] | Column) -> tuple[DataFrame, T.StructField, T.StructField]:
    """The column before and after, and both fields."""
    after = fn(name(column)) if callable(fn) else fn
    if not isinstance(after, Column):
        raise TypeError("the transformation must give a Column")
    pair = df.select(name(column).alias("__before"), after.alias("__after"))
    return pair, pair.schema["__before"], pair.schema["__after"]


def _changed(before: T.StructField, after: T.StructField) -> Column:
    b, a = F.col("__before"), F.col("__after")
    none_b, none_a = is_missing(b, before), is_missing(a, after)
    same = b == a if class_name(before) == class_name(after) or {class_name(before), class_name(after)} <= {"integer", "numeric"} else b.cast("string") == a.cast("string")
    return (none_b != none_a) | (~none_b & ~none_a & ~F.coalesce(same, F.lit(False)))


def _kind(field: T.StructField) -> str:
    kind = class_name(field)
    return "numeric" if kind in ("integer", "numeric") else kind if kind in ("Date", "POSIXct", "factor", "logical") else "character"


def _numeric(pair: DataFrame, before: T.StructField, after: T.StructField, tolerance: float, way: str) -> list[Column]:
    out, raws = [], {side: F.col(f"__{side}").cast("double") for side in ("before", "after")}
    values = {side: F.when(~F.isnan(raw), raw) for side, raw in raws.items()}
    medians = quantile_columns(pair, list(values.values()), way, (0.5,))
    for (side, v), median in zip(values.items(), medians, strict=True):
        out += [F.avg(v).alias(f"mean_{side}"), F.stddev_samp(v).alias(f"sd_{side}"), F.min(v).alias(f"min_{side}"), F.get(median, F.lit(0)).alias(f"median_{side}"), F.max(v).alias(f"max_{side}")]
        out += [F.count_if(F.coalesce(F.isnan(raws[side]), F.lit(False))).alias(f"n_nan_{side}"), F.count_if(F.abs(v) == float("inf")).alias(f"n_inf_{side}")]
    raw = F.abs(values["after"] - values["before"])
    delta = F.when(~F.isnan(raw), raw)
    beyond = F.count_if(delta > tolerance)
    out += [F.coalesce(F.avg(F.when(_changed(before, after), delta)), F.lit(0.0)).alias("mean_abs_delta"), beyond.alias("n_beyond_tol"), (100.0 * beyond / F.nullif(F.count(delta), F.lit(0))).alias("pct_beyond_tol")]
    return out


def _range(date: bool) -> list[Column]:
    out = []
    for side in ("before", "after"):
        v = F.col(f"__{side}")
        low, high = F.min(v), F.max(v)
        days = F.datediff(high, low).cast("double") if date else (F.unix_micros(high.cast("timestamp")) - F.unix_micros(low.cast("timestamp"))) / 86400e6
        out += [low.cast("string").alias(f"min_{side}"), high.cast("string").alias(f"max_{side}"), F.when(F.count(v) > 1, days).alias(f"span_days_{side}")]
    return out


def transform_df(df: DataFrame, column: str, fn: Callable[[Column], Column] | Column, tolerance: float = TOLERANCE, quantiles: str = "auto") -> DataFrame:
    """The audit as one row, lazily (but for sorted medians): n_total, n_changed, n_unchanged, pct_changed, n_na_before, n_na_after, and what the class has more."""
    pair, before, after = _pair(df, column, fn)
    changed = F.count_if(_changed(before, after))
    total = F.count(F.lit(1))
    aggregates = [total.alias("n_total"), changed.alias("n_changed"), (total - changed).alias("n_unchanged"), F.when(total > 0, 100.0 * changed / total).otherwise(0.0).alias("pct_changed")]
    aggregates += [F.count_if(is_missing(F.col(f"__{side}"), f)).alias(f"n_na_{side}") for side, f in (("before", before), ("after", after))]
    kinds = _kind(before), _kind(after)
    if kinds == ("numeric", "numeric"):
        aggregates += _numeric(pair, before, after, tolerance, quantiles)
    elif kinds[0] == kinds[1] and kinds[0] in ("Date", "POSIXct"):
        aggregates += _range(kinds[0] == "Date")
    elif kinds == ("logical", "logical"):
        aggregates += [F.count_if(F.col(f"__{side}") == truth).alias(f"n_{str(truth).lower()}_{side}") for side in ("before", "after") for truth in (True, False)]
    return pair.agg(*aggregates)


def changed_examples_df(df: DataFrame, column: str, fn: Callable[[Column], Column] | Column) -> DataFrame:
    """before and after (as text) with the number of rows n of each change: the most frequent EXAMPLES, ties by value."""
    pair, before, after = _pair(df, column, fn)
    pairs = pair.where(_changed(before, after)).groupBy(F.col("__before").cast("string").alias("before"), F.col("__after").cast("string").alias("after")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.orderBy(F.col("n").desc(), "before", "after").limit(EXAMPLES)


def level_counts_df(df: DataFrame, column: str, fn: Callable[[Column], Column] | Column) -> DataFrame:
    """level, n_before, n_after of a text or factor column; the null level counts missing values."""
    pair, _, _ = _pair(df, column, fn)
    sides = [pair.groupBy(F.col(f"__{s}").cast("string").alias(f"l_{s}")).agg(F.count(F.lit(1)).alias(f"n_{s}")) for s in ("before", "after")]
    joined = sides[0].join(sides[1], F.col("l_before").eqNullSafe(F.col("l_after")), "full")
    return joined.select(F.coalesce("l_before", "l_after").alias("level"), F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))


@dataclass(frozen=True)
class TransformAudit:
    name: str
    type_class: str
    metrics: dict
    examples: list[dict]
    levels: dict | None
    cleaned: DataFrame
    #: For factors: level, n_before, n_after; the null level counts missing values.
    level_counts: DataFrame | None = None

    def __getattr__(self, key: str):  # noqa: ANN204
        try:
            return self.__dict__["metrics"][key]
        except KeyError:
            raise AttributeError(key) from None

    def __str__(self) -> str:
        text = table_text(f"Transformation of {self.name} ({self.type_class})", ("Item", "Value"), list(self.metrics.items()))
        if self.levels:
            text += "\n\n" + table_text("Levels", ("Change", "Levels"), [(k, ", ".join(v) or "-") for k, v in self.levels.items()])
        if self.examples:
            text += "\n\n" + table_text("Examples", ("before", "after", "rows"), [tuple(e.values()) for e in self.examples])
        return text


def audit_transform(df: DataFrame, column: str, fn: Callable[[Column], Column] | Column, label: str | None = None, tolerance: float = TOLERANCE, quantiles: str = "auto") -> TransformAudit:
    """What a transformation (a function of a Column, or a Column over df) does to a column. `cleaned` is df with it applied.

    quantiles: the way to the medians; see `WAYS` in plans/profile.py. Levels of a factor's new values are listed up to LEVELS of them; the whole
    is in `level_counts`."""
    check_frame(df)
    check_columns(df, [column], "column")
    if isinstance(tolerance, bool) or not isinstance(tolerance, (int, float)) or math.isnan(tolerance) or tolerance < 0:
        raise ValueError("tolerance must be a single non-negative number")
    pair, before, after = _pair(df, column, fn)
    metrics = transform_df(df, column, fn, tolerance, quantiles).first().asDict()
    levels = None
    if _kind(before) == "factor" and (old := levels_of(before)) is not None:
        new = levels_of(after)
        if new is None:
            new = [r[0] for r in pair.where(F.col("__after").isNotNull()).select(F.col("__after").cast("string")).distinct().orderBy("__after").limit(LEVELS).collect()]
        levels = {"before": old, "after": new, "added": [x for x in new if x not in old], "removed": [x for x in old if x not in new]}
    examples = [r.asDict() for r in changed_examples_df(df, column, fn).collect()] if metrics["n_changed"] else []
    cleaned = df.withColumn(column, fn(name(column)) if callable(fn) else fn)
    return TransformAudit(label or column, _kind(before), metrics, examples, levels, cleaned, level_counts_df(df, column, fn) if _kind(before) == "factor" else None)


__all__ = ["TransformAudit", "audit_transform", "changed_examples_df", "level_counts_df", "transform_df"]
