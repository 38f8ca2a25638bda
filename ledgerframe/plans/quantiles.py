"""Exact quantiles of columns of any size: by narrowing ranges, or by a distributed sort.

Spark's `percentile` keeps every distinct value of a column in one buffer, which suits summaries of moderate columns in the same pass as all else.

`narrowed_quantiles` reads the columns a few times and shuffles histograms alone. The first pass counts values by sign and power of two, which no outlier can
stretch; each further pass cuts the cells that hold a wanted rank in CELLS equal parts, between the least and the greatest value that was seen in them; a
cell of at most FEW rows is counted value by value. A cell is settled when its least and greatest value are the same. A billion rows take about four passes; what
is shuffled and what reaches the driver is bounded by columns, ranks and cells.

`sorted_quantiles` reads them once: values are counted with map-side combination, ordered over many partitions, and ranked by a
prefix sum over the partitions' sizes; only the rows at the wanted ranks reach the driver. That is for frames whose plan is costly to run again."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

#: Parts that a pass cuts a cell in, and rows of a cell whose values are counted one by one.
CELLS = 256
FEW = 512


@dataclass(frozen=True)
class _Cell:
    """Values of a column between two of its values, and how many of the column's values come before them."""

    low: float
    high: float
    rows: int
    before: int


def _interpolated(total: int, share: float, at_rank: dict[int, float]) -> float:
    """The quantile between the two ranks that it lies between, as `percentile` calculates it."""
    at = (total - 1) * float(share)
    low, high = math.floor(at), math.ceil(at)
    return at_rank[low] if low == high or at_rank[low] == at_rank[high] else (high - at) * at_rank[low] + (at - low) * at_rank[high]


def _magnitude(value: Column) -> Column:
    """A whole number that does not fall as the value rises: its sign and power of two."""
    power = lambda v: F.lit(2000) + F.greatest(F.lit(-1100.0), F.least(F.lit(1100.0), F.floor(F.log2(v)).cast("double"))).cast("int")
    infinite = F.lit(float("inf"))
    return F.when(value == infinite, 4000).when(value == -infinite, -4000).when(value > 0, power(value)).when(value < 0, -power(-value)).otherwise(0)


def _histogram(df: DataFrame, keys: dict[int, tuple[Column, list[_Cell] | None]]) -> dict[int, list[Row]]:
    """For each column its rows by a key (cell, part or value in it; value): cell, rows, low and high, in order of values. One pass for all columns:
    by powers of two, or by the parts of given cells, as all columns of a pass are.

    Values become rows before anything is made of them, so that the code that Spark writes is as short for many columns and cells as for one: methods that are too
    large for the JVM to compile take ten times as long. Missing values are filtered as rows."""
    rows, cells = df.select(F.posexplode(F.array(*[v for v, _ in keys.values()])).alias("c", "v")).where("v is not null"), [own for _, own in keys.values() if own]
    rows = _parted(rows, cells) if cells else rows.select("c", "v", F.lit(0).alias("cell"), _magnitude(F.col("v")).cast("double").alias("at"))
    counts = rows.groupBy("c", "cell", "at").agg(F.count(F.lit(1)).alias("rows"), F.min("v").alias("low"), F.max("v").alias("high"))
    found, out = counts.collect(), {}
    for i, c in enumerate(keys):
        out[c] = sorted((r for r in found if r.c == i), key=lambda r: r.low)
    return out


def _parted(rows: DataFrame, cells: Sequence[Sequence[_Cell]]) -> DataFrame:
    """c, v, cell and at of the values v (of column c) that are in a cell: its number, and the part of it, or where the cell has few rows the value itself."""
    most = max(map(len, cells))

    def told(of: Callable[[_Cell], float], k: int) -> Column:
        """Of a column's cell k, null where it has none."""
        return F.get(F.array(*[F.lit(float(of(own[k])) if k < len(own) else None).cast("double") for own in cells]), F.col("c"))

    def told_all(of: Callable[[_Cell], float]) -> Column:
        """Of the cell `cell` of a column."""
        flat = F.array(*[F.lit(float(of(own[k])) if k < len(own) else None).cast("double") for own in cells for k in range(most)])
        return F.get(flat, F.col("c") * F.lit(most) + F.col("cell"))

    number = F.lit(-1)
    for k in range(most):
        number = number + F.when(F.col("v") >= told(lambda cell: cell.low, k), 1).otherwise(0)
    inside = rows.withColumn("cell", number).where("cell >= 0").where(F.col("v") <= told_all(lambda cell: cell.high))
    part = F.least(F.floor((F.col("v") - told_all(lambda cell: cell.low)) / told_all(lambda cell: cell.high - cell.low) * F.lit(float(CELLS))), F.lit(CELLS - 1)).cast("double")
    return inside.select("c", "v", "cell", F.when(told_all(lambda cell: cell.rows) <= FEW, F.col("v")).otherwise(part).alias("at"))


def narrowed_quantiles(df: DataFrame, values: Sequence[Column], shares: Sequence[float]) -> list[list[float] | None]:
    """For each numeric Column its quantiles with linear interpolation; None where it has no values. df is read some times over."""
    numbers = [v.cast("double") for v in values]
    if not numbers:
        return []
    totals: dict[int, int] = {}
    ranks: dict[int, dict[int, float | None]] = {}
    open_: dict[int, list[_Cell]] = {}
    first = _histogram(df, {c: (v, None) for c, v in enumerate(numbers)})
    for c, rows in first.items():
        totals[c] = sum(r.rows for r in rows)
        if totals[c]:
            ranks[c] = {k: None for p in shares for at in [(totals[c] - 1) * float(p)] for k in (math.floor(at), math.ceil(at))}
            open_[c] = _settled(ranks[c], _placed(rows, 0))
    while any(open_.values()):
        found = _histogram(df, {c: (numbers[c], cells) for c, cells in open_.items() if cells})
        for c, rows in found.items():
            parts = [cell for k, whole in enumerate(open_[c]) for cell in _placed([r for r in rows if r.cell == k], whole.before)]
            open_[c] = _settled(ranks[c], parts)
    return [None if not totals[c] else [_interpolated(totals[c], p, ranks[c]) for p in shares] for c in range(len(numbers))]


def _placed(rows: Sequence[Row], before: int) -> list[_Cell]:
    """Rows of a histogram in order as cells, of which the first has so many values before it."""
    out = []
    for r in rows:
        out.append(_Cell(r.low, r.high, r.rows, before))
        before += r.rows
    return out


def _settled(ranks: dict[int, float | None], cells: Sequence[_Cell]) -> list[_Cell]:
    """Sets the ranks whose cell has one value or begins or ends with them; the cells of the other open ranks."""
    left = []
    for cell in cells:
        own = [k for k, v in ranks.items() if v is None and cell.before <= k < cell.before + cell.rows]
        # A cell's first and last rank are its ends.
        ends = {cell.before: cell.low, cell.before + cell.rows - 1: cell.high}
        ranks.update({k: cell.low if cell.low == cell.high else ends[k] for k in own if cell.low == cell.high or k in ends})
        if any(ranks[k] is None for k in own):
            left.append(cell)
    return left


def sorted_quantiles(df: DataFrame, values: Sequence[Column], shares: Sequence[float]) -> list[list[float] | None]:
    """For each numeric Column its quantiles with linear interpolation; None where it has no values."""
    if not values:
        return []
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), v.cast("double").alias("v")) for i, v in enumerate(values)])).alias("s"))
    counts = cells.select("s.c", "s.v").where("v is not null").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    # Both uses below must see the same partitions.
    ranged = counts.orderBy("c", "v").withColumn("part", F.spark_partition_id()).persist()
    try:
        sizes = ranged.groupBy("c", "part").agg(F.sum("n").alias("size"))
        # One row for each partition and column.
        before = F.coalesce(F.sum("size").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = sizes.select("c", "part", before.alias("before"), F.sum("size").over(Window.partitionBy("c")).alias("total"))
        inside = F.sum("n").over(Window.partitionBy("c", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        placed = ranged.withColumn("inside", inside).join(starts, ["c", "part"])
        first, end = F.col("before") + F.col("inside") - F.col("n"), F.col("before") + F.col("inside")
        hit = F.lit(False)
        for p in shares:
            at = (F.col("total") - 1) * F.lit(float(p))
            for rank in (F.floor(at), F.ceil(at)):
                hit = hit | ((first <= rank) & (rank < end))
        rows = placed.where(hit).select("c", "v", first.alias("first"), end.alias("end"), "total").collect()
    finally:
        ranged.unpersist()
    out: list[list[float] | None] = []
    for i in range(len(values)):
        own = [r for r in rows if r.c == i]
        if not own:
            out.append(None)
            continue
        at_rank = lambda k, own=own: next(r.v for r in own if r.first <= k < r.end)
        spots = {k for p in shares for at in [(own[0].total - 1) * float(p)] for k in (math.floor(at), math.ceil(at))}
        values_at = {k: at_rank(k) for k in spots}
        out.append([_interpolated(own[0].total, p, values_at) for p in shares])
    return out
