"""How often each value of each column occurs, for all columns in one pass, in memory that does not grow with the values.

Each cell becomes its column's number and a hash of 128 bits, or the value itself where it fits into a long. Cells are counted with a map-side
combine: what is shuffled is one narrow row for each distinct value of a task, however long the values are, and a frequent value is one row a task. From
these counts come the number of distinct values and the count of the most frequent ones. The most frequent value itself is read in a
second pass, in which cells are compared with the hashes of that count alone; of equally frequent values the least is taken. Where all values are equally
frequent, the column's least value is the answer, and nothing is compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerframe.functions.types import class_name, name, present

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def text_of(value: Column, kind: str) -> Column:
    """A value as text."""
    return F.to_json(F.struct(value)) if kind == "list" else value.cast("string")


def _hashes(value: Column, field: T.StructField) -> tuple[Column, Column]:
    """Two longs that tell the values of a column apart."""
    if isinstance(field.dataType, _WHOLE):
        return value.cast("long"), F.lit(0).cast("long")
    kind = class_name(field)
    told = value if kind in ("numeric", "character", "factor", "logical", "Date", "POSIXct") else text_of(value, kind)
    return F.xxhash64(F.lit(1), told), F.xxhash64(F.lit(2), told)


def _rank(value: Column, field: T.StructField) -> Column:
    """A long that values of a column sort by before their text does."""
    if class_name(field) == "Date":
        return F.unix_date(value).cast("long")
    if isinstance(field.dataType, T.TimestampType):
        # The text is local time, which goes back when summer ends.
        return F.unix_micros(value)
    return F.lit(0).cast("long")


def _cells(df: DataFrame, fields: Sequence[tuple[int, T.StructField]], texts: bool) -> DataFrame:
    """k, a, b of each cell that is not missing; with texts also rank and text."""
    structs = []
    for k, field in fields:
        value = present(name(field.name), field)
        a, b = _hashes(value, field)
        more = [_rank(value, field).alias("rank"), text_of(value, class_name(field)).alias("text")] if texts else []
        structs.append(F.when(value.isNotNull(), F.struct(F.lit(k).alias("k"), a.alias("a"), b.alias("b"), *more)))
    return df.select(F.inline(F.array_compact(F.array(*structs))))


def value_counts(df: DataFrame, fields: Sequence[tuple[int, T.StructField]]) -> DataFrame:
    """k, a, b, n: one row for each value of the numbered columns."""
    return _cells(df, fields, False).groupBy("k", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def value_figures(df: DataFrame, fields: Sequence[tuple[int, T.StructField]], modes: Sequence[int]) -> DataFrame:
    """k, distinct (the number of its values), level (all values are equally frequent) and, of the columns in modes, mode: the text of the most
    frequent value, the least of several; null where the column is level, whose mode is its least value."""
    counts = value_counts(df, fields)
    figures = counts.groupBy("k").agg(F.count(F.lit(1)).alias("distinct"), F.max("n").alias("most"), F.min("n").alias("least"))
    figures = figures.select("k", "distinct", (F.col("most") == F.col("least")).alias("level"), "most")
    wanted = [(k, f) for k, f in fields if k in set(modes)]
    if not wanted:
        return figures.select("k", "distinct", "level", F.lit(None).cast("string").alias("mode"))
    # One row for each column, so a broadcast of it is bounded by the schema.
    tops = counts.where(F.col("k").isin(*modes)).join(F.broadcast(figures.where("not level").select("k", "most")), "k").where("n = most").select("k", "a", "b")
    found = _cells(df, wanted, True).join(tops, ["k", "a", "b"], "left_semi")
    # Equal cells become one by a hash before the least is sought: that has to sort, and a frequent value is most of its column's cells.
    # Their number is asked for since the least needs none, and without a use of it Spark would leave the grouping out.
    found = found.groupBy("k", "rank", "text").agg(F.count(F.lit(1)).alias("n")).where("n > 0").groupBy("k").agg(F.min(F.struct("rank", "text"))["text"].alias("mode"))
    return figures.join(found, "k", "left").select("k", "distinct", "level", "mode")
