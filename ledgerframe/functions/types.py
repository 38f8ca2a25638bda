"""Column classes, missing values and small argument checks that all operators share."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOAT = (T.FloatType, T.DoubleType)


def name(column: str) -> Column:
    """The column of exactly this name."""
    return F.col("`" + column.replace("`", "``") + "`")


def free_name(base: str, taken: Iterable[str], more: str = "_") -> str:
    """base, extended until it is none of the names that are taken, in either case."""
    lower = {t.lower() for t in taken}
    if not more and base.lower() in lower:
        raise ValueError(f"the result would have two columns called {base!r}")
    while base.lower() in lower:
        base += more
    return base


def numbered(df: DataFrame, letter: str) -> DataFrame:
    """df with its columns called by a letter and their places, so that no name of theirs meets another."""
    return df.toDF(*[f"{letter}{i}" for i in range(len(df.columns))])


def class_name(field: T.StructField) -> str:
    """The canonical class of a column: integer, numeric, character, factor, logical, Date, POSIXct, list, or Spark's own name.

    A string column whose metadata carries `levels` is a factor."""
    kind = field.dataType
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "factor" if (field.metadata or {}).get("levels") is not None else "character"
    for types, label in ((_INTEGER, "integer"), ((*_FLOAT, T.DecimalType), "numeric"), (T.BooleanType, "logical"), (T.DateType, "Date"), ((T.TimestampType, T.TimestampNTZType), "POSIXct"), ((T.ArrayType, T.MapType, T.StructType), "list")):
        if isinstance(kind, types):
            return label
    return kind.simpleString()


def levels_of(field: T.StructField) -> list[str] | None:
    return (field.metadata or {}).get("levels")


def as_factor(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """df with `column` marked as a factor of these levels, in order; other values become missing."""
    value = F.when(name(column).isin(*levels), name(column)).cast("string")
    return df.withColumn(column, value.alias(column, metadata={"levels": list(levels)}))


def is_numeric(field: T.StructField) -> bool:
    return class_name(field) in ("integer", "numeric")


def may_be_nan(field: T.StructField) -> bool:
    return isinstance(field.dataType, _FLOAT)


def is_missing(value: Column, field: T.StructField) -> Column:
    """Null, or NaN for floating point."""
    return value.isNull() | F.isnan(value) if may_be_nan(field) else value.isNull()


def present(value: Column, field: T.StructField) -> Column:
    """The value, with NaN turned into null."""
    return F.when(~F.isnan(value), value) if may_be_nan(field) else value


def check_frame(df: object, what: str = ".data") -> DataFrame:
    if not isinstance(df, DataFrame):
        raise TypeError(f"{what} must be a Spark DataFrame, not {type(df).__name__}")
    return df


def check_columns(df: DataFrame, columns: Iterable[str], what: str = "columns") -> None:
    if lost := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{what} not found in the data: {', '.join(lost)}")


def check_share(value: float | None, what: str) -> None:
    if value is not None and (isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or not 0 <= value <= 1):
        raise ValueError(f"{what} must be a single number between 0 and 1")


def condition(value: Column | str) -> Column:
    return F.expr(value) if isinstance(value, str) else value


def label_of(value: Column | str) -> str:
    """The text of an expression: SQL as it was given, or the name of a built column."""
    if isinstance(value, str):
        return value
    text = str(value)
    return text[len("Column<'") : -len("'>")] if text.startswith("Column<'") else text


def both(conditions: Sequence[Column | str]) -> Column:
    """All conditions together, in three-valued logic; none is true."""
    out = F.lit(True)
    for c in conditions:
        out = out & condition(c)
    return out


def rate(part: Column, whole: Column) -> Column:
    """100 * part / whole; null where the whole is zero."""
    return F.when(whole != 0, F.lit(100.0) * part / whole)


def to_rows(df: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """A one-row frame turned to one row for each struct, in order of `position`."""
    return df.select(F.inline(F.array(*structs)))
