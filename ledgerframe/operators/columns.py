"""Profiles of columns: missing values, and one summary row for each column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerframe.functions.render import table_text
from ledgerframe.functions.types import check_columns, check_frame, class_name, is_missing, is_numeric, name, present, to_rows
from ledgerframe.plans.profile import quantile_columns
from ledgerframe.plans.values import text_of, value_figures

def missing_df(df: DataFrame) -> DataFrame:
    """position, variable, n_na, pct_na (rounded to one decimal), n_valid: one row for each column, lazily, from one pass."""
    fields = df.schema.fields
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(is_missing(name(f.name), f)).alias(f"na{i}") for i, f in enumerate(fields)])
    pct = lambda c: F.when(F.col("n") > 0, F.round(F.lit(100.0) * c / F.col("n"), 1)).otherwise(0.0)
    return to_rows(row, [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("variable"), F.col(f"na{i}").alias("n_na"), pct(F.col(f"na{i}")).alias("pct_na"), (F.col("n") - F.col(f"na{i}")).alias("n_valid")) for i, f in enumerate(fields)])


@dataclass(frozen=True)
class MissingReport:
    table: list[dict]
    n_rows: int
    n_cols: int
    n_with_na: int
    frame: DataFrame

    def to_df(self) -> DataFrame:
        return self.frame.orderBy(F.col("pct_na").desc(), "position").drop("position")

    def __str__(self) -> str:
        rows = [tuple(r.values()) for r in self.table if r["n_na"]]
        return table_text(f"Missing values: {self.n_with_na} of {self.n_cols} columns", ("variable", "n_na", "pct_na", "n_valid"), rows)


def diagnose_nas(df: DataFrame) -> MissingReport:
    """Missing values (null or NaN) by column, the most affected first."""
    check_frame(df)
    frame = missing_df(df)
    rows = sorted((r.asDict() for r in frame.collect()), key=lambda r: (-r["pct_na"], r["position"]))
    table = [{k: v for k, v in r.items() if k != "position"} for r in rows]
    total = table[0]["n_na"] + table[0]["n_valid"] if table else 0
    return MissingReport(table, total, len(table), sum(r["n_na"] > 0 for r in table), frame)


#: Names of the fields of a summary.
SUMMARY_FIELDS = ("type", "n_unique", "missing", "missing_share", "most_frequent", "mean", "sd", "min", "q25", "q50", "q75", "max", "example1", "example2", "example3")
_SCHEMA = ", ".join(f"{f} {'bigint' if f in ('n_unique', 'missing') else 'double' if f in ('missing_share', 'mean', 'sd', 'q25', 'q50', 'q75') else 'string'}" for f in SUMMARY_FIELDS)


def _examples(value: Column, kind: str, k: int) -> list[Column]:
    """Three values that are there: the least, the greatest and any one. Each is an aggregate of one value, where the first ones in
    reading order would not be reproducible."""
    text = text_of(value, kind)
    least, greatest = (F.min(text), F.max(text)) if kind == "list" else (F.min(value).cast("string"), F.max(value).cast("string"))
    return [least.alias(f"e1_{k}"), greatest.alias(f"e2_{k}"), F.max_by(text, F.xxhash64(text)).alias(f"e3_{k}")]


def _summaries(df: DataFrame, field: T.StructField, k: int, approximate: bool, ranked: Column | None) -> tuple[list[Column], Column]:
    """Aggregates of one column, and the struct that is made of them. ranked: the aggregate of its quantiles, of numbers."""
    kind, value = class_name(field), present(name(field.name), field)
    number = value.cast("double") if kind in ("integer", "numeric", "logical") else None
    aggregates = [F.count(F.lit(1)).alias(f"n{k}"), F.count_if(is_missing(name(field.name), field)).alias(f"na{k}")]
    if approximate:
        aggregates.append(F.approx_count_distinct(text_of(value, kind) if kind == "list" else value).alias(f"u{k}"))
    if number is not None:
        aggregates += [F.avg(number).alias(f"m{k}"), F.stddev_samp(number).alias(f"s{k}")]
    if kind in ("integer", "numeric"):
        aggregates.append(ranked.alias(f"q{k}"))
    if kind in ("integer", "numeric", "character", "factor", "Date"):
        aggregates += [F.min(value).cast("string").alias(f"lo{k}"), F.max(value).cast("string").alias(f"hi{k}")]
    aggregates += _examples(value, kind, k)
    none = F.lit(None)
    q = (lambda j: F.get(F.col(f"q{k}"), F.lit(j))) if kind in ("integer", "numeric") else (lambda j: none)
    values = {
        "type": F.lit("numeric" if kind == "integer" else kind),
        "n_unique": F.col(f"u{k}") if approximate else none,
        "missing": F.col(f"na{k}"),
        "missing_share": F.when(F.col(f"n{k}") > 0, F.col(f"na{k}") / F.col(f"n{k}")),
        "most_frequent": none,
        "mean": F.col(f"m{k}") if number is not None else none,
        "sd": F.col(f"s{k}") if number is not None else none,
        "min": F.col(f"lo{k}") if kind in ("integer", "numeric", "character", "factor", "Date") else none,
        "q25": q(1),
        "q50": q(2),
        "q75": q(3),
        "max": F.col(f"hi{k}") if kind in ("integer", "numeric", "character", "factor", "Date") else none,
    }
    values |= {f"example{j}": F.col(f"e{j}_{k}") for j in (1, 2, 3)}
    kinds = dict(f.split() for f in _SCHEMA.split(", "))
    struct = F.struct(F.lit(k).alias("position"), F.lit(field.name).alias("variable"), *[values[f].cast(kinds[f]).alias(f) for f in SUMMARY_FIELDS])
    return aggregates, struct


def summary_df(df: DataFrame, cols: Sequence[str] | None = None, approximate: bool = False, quantiles: str = "auto") -> DataFrame:
    """position, variable and the summary of each column, lazily (but for quantiles of large inputs). Numbers stay numbers; what has no meaning for a
    class is null.

    One pass has the aggregates of all columns, one counts all their values (`value_figures`), and one reads the most frequent ones. Values of more than a
    long are told apart by 128 bits. approximate: distinct counts and quantiles by sketches."""
    columns = df.columns if cols is None else list(cols)
    check_columns(df, columns, "cols")
    if not columns:
        return df.sparkSession.createDataFrame([], f"position int, variable string, {_SCHEMA}")
    fields = [df.schema[c] for c in columns]
    numbers = [f for f in fields if is_numeric(f)]
    ranked = dict(zip([f.name for f in numbers], quantile_columns(df, [present(name(f.name), f).cast("double") for f in numbers], "approximate" if approximate else quantiles), strict=True))
    parts = [_summaries(df, f, k, approximate, ranked.get(f.name)) for k, f in enumerate(fields)]
    rows = to_rows(df.agg(*[a for aggregates, _ in parts for a in aggregates]), [struct for _, struct in parts])
    modes = [k for k, f in enumerate(fields) if not is_numeric(f)]
    counted = modes if approximate else range(len(fields))
    if not counted:
        return rows
    figures = value_figures(df, [(k, fields[k]) for k in counted], modes).withColumnRenamed("k", "position")
    rows = rows.join(F.broadcast(figures), "position", "left")
    # Of values that are all as frequent the least is taken: the first example.
    mode = F.when(F.col("level"), F.col("example1")).otherwise(F.col("mode"))
    own = {"n_unique": F.col("n_unique") if approximate else F.coalesce("distinct", F.lit(0)).cast("long"), "most_frequent": F.when(F.col("position").isin(*modes), mode)}
    return rows.select("position", "variable", *[own.get(f, F.col(f)).alias(f) for f in SUMMARY_FIELDS])


def summarize_column(df: DataFrame, column: str, approximate: bool = False, quantiles: str = "auto") -> dict:
    """The summary of one column."""
    check_frame(df)
    row = summary_df(df, [column], approximate, quantiles).first().asDict()
    return {f: row[f] for f in SUMMARY_FIELDS}


def get_summary_table(df: DataFrame, cols: Sequence[str] | None = None, approximate: bool = False, quantiles: str = "auto") -> DataFrame:
    """One row for each column: variable and its summary."""
    check_frame(df)
    return summary_df(df, cols, approximate, quantiles).orderBy("position").drop("position")


def most_frequent_df(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value of a column that is not missing, and n; of equally frequent ones the smallest."""
    value = present(name(column), df.schema[column])
    counts = df.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "value").limit(1)
