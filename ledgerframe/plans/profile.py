"""The aggregate plans behind snapshots: one pass over the data, whatever is asked of it.

A snapshot of a filter's result is computed over the filter's input, with every aggregate conditional on the keep flag, so
that diagnostics and snapshot share one scan. Only columns that are summarised reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerframe.functions.types import class_name, is_missing, is_numeric, name, present, to_rows
from ledgerframe.plans.quantiles import narrowed_quantiles, sorted_quantiles

#: Numeric columns whose exact quantiles one aggregate computes at most; wider frames are read once for each so many.
QUANTILE_COLUMNS = 100
STATS = ("min", "q25", "median", "mean", "q75", "max")
#: Ways to quantiles: "exact" in the same pass as all else, with memory for the distinct values of a column; "narrowed", exact by histograms in a few
#: passes, and "sorted", exact by a distributed sort in one, for columns of any size; "auto", the first for inputs of up to AUTO_BYTES and else the
#: second, which give the same; "approximate" by a sketch of bounded size.
WAYS = ("auto", "exact", "narrowed", "sorted", "approximate")
#: Estimated bytes of all tables below a plan, up to which a column's distinct values are kept: each task's go to one task, which merges them
#: all, so that larger inputs would have it read and rank them alone. What is made of an RDD or a checkpoint tells no size (Spark gives UNKNOWN_BYTES or more) and counts as large, but for rows that the driver held itself.
AUTO_BYTES, UNKNOWN_BYTES = 1 << 23, 1 << 60
_SHARES = (0.0, 0.25, 0.5, 0.75, 1.0)


@dataclass(frozen=True)
class Scope:
    """What a snapshot looks at: all columns for counts, `fields` for the schema, `numeric` for summaries."""

    all_fields: tuple[T.StructField, ...]
    fields: tuple[T.StructField, ...]
    numeric: tuple[T.StructField, ...]
    quantiles: str = "auto"


def checked_way(way: str) -> str:
    if way not in WAYS:
        raise ValueError(f"quantiles must be one of {', '.join(WAYS)}")
    return way


def _held_by_driver(leaf) -> bool:  # noqa: ANN001
    """Whether the rows of a plan's leaf are of an RDD that was made of collections on the driver, and of no other plan. What code makes of such
    rows before they become a frame is not known, and taken to be of their size."""
    if leaf.nodeName() != "LogicalRDD":
        return False
    open_ = [leaf.rdd()]
    while open_:
        rdd = open_.pop()
        above = rdd.dependencies()
        kind = rdd.getClass().getSimpleName()
        if kind == "SQLExecutionRDD" or (above.isEmpty() and kind != "ParallelCollectionRDD"):
            return False
        open_ += [above.apply(i).rdd() for i in range(above.size())]
    return True


def input_bytes(df: DataFrame) -> int:
    """The estimated size of what a plan reads; UNKNOWN_BYTES or more where some of it tells none."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [0 if _held_by_driver(leaves.apply(i)) else int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    except Exception:  # noqa: BLE001  a session without a JVM at hand has no plan to ask
        return UNKNOWN_BYTES
    return sum(sizes)


def resolved_way(df: DataFrame, way: str) -> str:
    """`way`, with "auto" decided by the size of what df reads."""
    if checked_way(way) != "auto":
        return way
    return "narrowed" if input_bytes(df) > AUTO_BYTES else "exact"


def quantile_columns(df: DataFrame, values: Sequence[Column], way: str, shares: tuple[float, ...] = _SHARES) -> list[Column]:
    """For each value an aggregate over df: the array of its quantiles. Narrowed and sorted ones are calculated here and now, and are literals."""
    way = resolved_way(df, way)
    if way not in ("narrowed", "sorted"):
        return [quantiles(v, way == "approximate", shares) for v in values]
    none, found = F.lit(None).cast("array<double>"), []
    for start in range(0, len(values), QUANTILE_COLUMNS):
        found += (narrowed_quantiles if way == "narrowed" else sorted_quantiles)(df, values[start : start + QUANTILE_COLUMNS], shares)
    return [none if q is None else F.array(*map(F.lit, q)) for q in found]


def quantiles(value: Column, approximate: bool = False, shares: tuple[float, ...] = _SHARES) -> Column:
    """Linear-interpolation quantiles; approximate ones have bounded memory and suit very many distinct values."""
    at = F.array(*map(F.lit, shares))
    return F.percentile_approx(value, at, 10_000) if approximate else F.percentile(value, at)


def _number(field: T.StructField, keep: Column | None) -> Column:
    value = present(name(field.name), field).cast("double")
    return value if keep is None else F.when(keep, value)


def counts(scope: Scope, keep: Column | None = None) -> list[Column]:
    """n_rows, and the missing values of every column as na_<i>."""
    kept = F.lit(True) if keep is None else keep
    rows = F.count(F.lit(1)) if keep is None else F.count_if(kept)
    return [rows.alias("n_rows"), *[F.count_if(kept & is_missing(name(f.name), f)).alias(f"na_{i}") for i, f in enumerate(scope.all_fields)]]


def summaries(df: DataFrame, scope: Scope, fields: tuple[T.StructField, ...], keep: Column | None = None) -> list[Column]:
    """q_<column> and m_<column> of the given numeric columns."""
    values = [_number(f, keep) for f in fields]
    ranked = quantile_columns(df, values, scope.quantiles)
    return [c for f, v, q in zip(fields, values, ranked, strict=True) for c in (F.avg(v).alias(f"m_{f.name}"), q.alias(f"q_{f.name}"))]


def collected(df: DataFrame, scope: Scope, keep: Column | None = None, extra: tuple[Column, ...] = ()) -> tuple[Row, dict[str, dict]]:
    """The counts with any extra aggregates, and the summary of each numeric column. One aggregate up to QUANTILE_COLUMNS numeric columns."""
    parts = [scope.numeric[i : i + QUANTILE_COLUMNS] for i in range(0, len(scope.numeric), QUANTILE_COLUMNS)] or [()]
    first = df.agg(*counts(scope, keep), *extra, *summaries(df, scope, parts[0], keep)).first()
    rows = [first, *[df.agg(*summaries(df, scope, part, keep)).first() for part in parts[1:]]]
    return first, {f.name: _summary(row[f"q_{f.name}"], row[f"m_{f.name}"]) for row, part in zip(rows, parts, strict=True) for f in part}


def _summary(q: list | None, mean: float | None) -> dict:
    low, q25, median, q75, high = q or [None] * 5
    return dict(zip(STATS, (low, q25, median, mean, q75, high), strict=True))


def snapshot_df(df: DataFrame, approximate: bool = False, quantiles: str = "auto") -> DataFrame:
    """The profile of a frame as rows, lazily (but for sorted quantiles): position, column, type, n_na and the numeric summary."""
    fields = tuple(df.schema.fields)
    scope = Scope(fields, fields, tuple(f for f in fields if is_numeric(f)), "approximate" if approximate else quantiles)
    row = df.agg(*counts(scope), *summaries(df, scope, scope.numeric))
    none = F.lit(None).cast("double")
    structs = []
    for i, f in enumerate(fields):
        q = (lambda k, f=f: F.get(name(f"q_{f.name}"), F.lit(k))) if is_numeric(f) else (lambda k: none)
        mean = name(f"m_{f.name}") if is_numeric(f) else none
        values = (q(0), q(1), q(2), mean, q(3), q(4))
        structs.append(F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(class_name(f)).alias("type"), F.col(f"na_{i}").alias("n_na"), *[v.cast("double").alias(s) for v, s in zip(values, STATS, strict=True)]))
    return to_rows(row, structs)
