"""Joins by ranges alone: a point of one side between bounds of the other, without comparing all rows with all.

Spark has no join for a condition like `x.at BETWEEN y.low AND y.high` but a nested loop. Here the points are cut at quantiles of their own values
into buckets of about equal numbers of rows. A row with a point falls into one bucket; a row with bounds is dealt to each bucket that its range touches, and
the two sides are joined by the bucket, a plain equi-join that Spark spreads and splits. The whole condition is checked on every pair
that meets, so cut points decide the work and never the result. A range that covers a bucket meets the points in it, which are its matches as far as the
bounds say, so the copies of ranges are fewer than the pairs that come out, but for two for each range.

Pairs may be as many as the product of the two tables, which are small beside them, so Spark would broadcast one side or join in a few tasks, by the
bytes that it reads. Both sides are therefore dealt out to partitions by the number of pairs that will meet, PAIRS each. Points of a value that fills several
buckets are dealt to as many ways, and ranges copied to each, so that no single value makes a long task.

The work before that, finding places and making copies, is much for each byte read: a file of a few MB, one task to Spark, may hold a million rows. Rows are
spread over more tasks where one partition holds more than DEALT of them, or makes more than COPIES.

Two ranges overlap if the start of one lies in the other: if the condition is `x.low <= y.high AND y.low <= x.high`, starts of x are sought in ranges of y, and
starts of y, other than those, in ranges of x.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows with points that share a bucket, about, and the most buckets that there are.
ROWS = 256
MOST_CUTS = 1 << 14
#: Pairs that a task compares, about, and the most tasks that a join is dealt to.
PAIRS = 1 << 22
MOST_PARTITIONS = 1 << 14
#: Rows that a task finds the places of, about, and copies that it makes.
DEALT = 1 << 18
COPIES = 1 << 21
#: Share of the rows by which a cut point may be misplaced.
PRECISION = 1e-4

_BELOW = {"LessThan", "LessThanOrEqual"}
_ABOVE = {"GreaterThan", "GreaterThanOrEqual"}


@dataclass(frozen=True)
class Comparison:
    """x <= y, or x < y where strict (above: x >= y, x > y), as SQL over the aliases x and y."""

    x: str
    y: str
    above: bool
    strict: bool


def comparisons(left: DataFrame, right: DataFrame, match: Column) -> list[Comparison] | None:
    """The comparisons of a side's expression with the other's among the parts of a condition over the aliases x and y; None if there are none, or if the
    condition has an equality of both sides, by which Spark joins anyway."""
    node = left.join(right, match, "inner")._jdf.queryExecution().analyzed()
    if node.nodeName() != "Join" or node.condition().isEmpty():
        return None
    sides = {"x": node.left().outputSet(), "y": node.right().outputSet()}
    found, parts = [], [node.condition().get()]

    def compared(a, b, above: bool, strict: bool) -> None:  # noqa: ANN001
        of_a, of_b = side(a), side(b)
        if {of_a, of_b} == {"x", "y"}:
            x, y = (a, b) if of_a == "x" else (b, a)
            found.append(Comparison(x.sql(), y.sql(), above == (of_a == "x"), strict))

    def side(e) -> str | None:  # noqa: ANN001
        inside = [s for s, output in sides.items() if e.references().subsetOf(output)]
        return inside[0] if e.references().size() and len(inside) == 1 else None

    while parts:
        part = parts.pop()
        kind, children = part.nodeName(), part.children()
        if kind == "And":
            parts += [children.apply(i) for i in range(2)]
        elif not part.deterministic():
            continue
        elif kind == "Between":
            compared(part.input(), part.lower(), True, False)
            compared(part.input(), part.upper(), False, False)
        elif kind in ("EqualTo", "EqualNullSafe") and {side(children.apply(0)), side(children.apply(1))} == {"x", "y"}:
            return None
        elif kind in _BELOW | _ABOVE:
            compared(children.apply(0), children.apply(1), kind in _ABOVE, not kind.endswith("OrEqual"))
    return found or None


def _number(frame: DataFrame, sql: str) -> Column | None:
    """The expression as a double that sorts like it, or None where its type has none."""
    try:
        kind = frame.select(F.expr(sql)).schema.fields[0].dataType
    except AnalysisException:
        return None
    value = F.expr(sql)
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("double")
    return None


@dataclass(frozen=True)
class _Buckets:
    """Cut points between buckets, the ways that each bucket's points are dealt to, how many points each way has, about, and the partitions to spread the points over (0: as they are)."""

    cuts: list[float]
    ways: list[int]
    rows: int
    tasks: int


def _share(rows: DataFrame, work: Column, of_a_task: int) -> tuple[int, int]:
    """The work of all rows, and over how many partitions to spread them; 0 if none has more than twice the work of a task as they are."""
    of_each = rows.groupBy(F.spark_partition_id()).agg(F.sum(work).alias("work"))
    total, most = (n or 0 for n in of_each.agg(F.sum("work"), F.max("work")).first())
    return total, min(MOST_PARTITIONS, total // of_a_task + 1) if most > 2 * of_a_task else 0


def _spread(rows: DataFrame, tasks: int) -> DataFrame:
    """The rows over so many partitions, evenly; as they are for 0."""
    return rows.repartition(tasks) if tasks else rows


def _buckets(points: DataFrame) -> _Buckets:
    """Buckets of about ROWS rows, by the values of column p."""
    rows, tasks = _share(points, F.col("p").isNotNull().cast("int"), DEALT)
    buckets = min(MOST_CUTS, rows // ROWS)
    if buckets < 2:
        return _Buckets([], [1], rows, tasks)
    found = _spread(points, tasks).where(~F.isnan("p")).approxQuantile("p", [k / buckets for k in range(1, buckets)], PRECISION)
    often = Counter(q + 0.0 for q in found if math.isfinite(q))
    cuts = sorted(often)
    return _Buckets(cuts, [1, *(often[q] for q in cuts)], rows // buckets, tasks)


def _placed(rows: DataFrame, of: dict[str, tuple[Column | None, _Buckets, int]]) -> DataFrame:
    """rows with, by each name, how many cut points of its buckets are at most the value: NaN comes after all numbers, in the last bucket as in the order. The number where there is no value."""
    searched = {name: f"{name}_of" for name, (value, buckets, _) in of.items() if value is not None and buckets.cuts}
    if searched:
        # By halving, in the order of Java's doubles, where -0.0 comes before 0.0; the sum has no -0.0.
        rows = rows.withColumns({at: of[name][0] + F.lit(0.0) for name, at in searched.items()})
        splits = [[-math.inf, *of[name][1].cuts, math.inf] for name in searched]
        rows = Bucketizer(splitsArray=splits, inputCols=list(searched.values()), outputCols=list(searched), handleInvalid="keep").transform(rows).drop(*searched.values())
    return rows.withColumns({name: F.least(F.col(name).cast("int"), F.lit(len(buckets.cuts))) if name in searched else F.lit(other if value is None else 0) for name, (value, buckets, other) in of.items()})


def _ways(bucket: Column, buckets: _Buckets) -> Column:
    """The number of ways of a bucket."""
    if max(buckets.ways) == 1:
        return F.lit(1)
    return F.get(F.split(F.lit(",".join(map(str, buckets.ways))), ",").cast("array<int>"), bucket)


def _told(rows: DataFrame) -> Column:
    """A long of all that a row holds in plain columns, the same in every reading."""
    held = [F.col("`" + f.name.replace("`", "``") + "`") for f in rows.schema.fields if isinstance(f.dataType, T.AtomicType)]
    return F.xxhash64(*held) if held else F.lit(0).cast("long")


def _way(rows: DataFrame, bucket: Column, buckets: _Buckets) -> Column:
    """The way of a row among those of its bucket, by all that the row holds."""
    return F.pmod(_told(rows), _ways(bucket, buckets)) if max(buckets.ways) > 1 else F.lit(0)


def _slot(bucket: Column, buckets: _Buckets) -> Column:
    """The number of a bucket's first way, where the ways of all buckets are numbered through; for the number after the last bucket, that of all ways."""
    if max(buckets.ways) == 1:
        return bucket.cast("long")
    return F.get(F.split(F.lit(",".join(map(str, accumulate(buckets.ways, initial=0)))), ",").cast("array<long>"), bucket)


def _partitions(pairs: float | None) -> int:
    """Over how many partitions so many pairs are spread."""
    return int(min(MOST_PARTITIONS, max(1, (pairs or 0) // PAIRS + 1)))


def _copied(bucket_from: Column, bucket_to: Column, buckets: _Buckets) -> Column:
    """The number of copies of a range that touches these buckets: one for each of their ways."""
    return _slot(bucket_to + F.lit(1), buckets) - _slot(bucket_from, buckets)


def _within(points: DataFrame, point: Column, ranges: DataFrame, lows: list[Column], highs: list[Column], match: Column, kind: str, points_left: bool) -> DataFrame:
    """points and ranges joined by `match`, where the point is at least all lows and at most all highs in every match."""
    found = _buckets(points.select(point.alias("p")))
    # Null matches nothing, and its row meets no other: such rows are spread.
    at = F.col("__at")
    slot = F.when(point.isNotNull(), _slot(at, found) + _way(points, at, found)).otherwise(F.lit(-1) - F.pmod(_told(points), F.lit(1 << 40)))
    dealt = _placed(points, {"__at": (point, found, 0)}).withColumn("__at", slot)
    low = F.greatest(*lows) if len(lows) > 1 else lows[0] if lows else None
    high = F.least(*highs) if len(highs) > 1 else highs[0] if highs else None
    there = F.lit(True)
    for bound in (*lows, *highs):
        there = there & bound.isNotNull()
    ranges = ranges.where(there)
    tasks = _share(ranges, F.lit(1), DEALT)[1]

    def placed(tasks: int) -> DataFrame:
        return _placed(_spread(ranges, tasks), {"__first": (low, found, 0), "__last": (high, found, len(found.cuts))}).where("__first <= __last")

    made, more = _share(placed(tasks), _copied(F.col("__first"), F.col("__last"), found), COPIES)
    parts = _partitions(made * found.rows)
    slots = F.sequence(_slot(F.col("__first"), found), _slot(F.col("__last") + F.lit(1), found) - F.lit(1))
    copies = placed(max(tasks, more)).withColumn("__on", F.explode(slots)).drop("__first", "__last")
    if parts > 1:
        dealt, copies = dealt.repartition(parts, "__at").hint("merge"), copies.repartition(parts, "__on").hint("merge")
    on = (F.col("__at") == F.col("__on")) & match
    return dealt.join(copies, on, kind) if points_left else copies.join(dealt, on, kind)


def _overlaps(left: DataFrame, right: DataFrame, x: tuple[Column, Column], y: tuple[Column, Column], match: Column) -> DataFrame:
    """left and right joined by `match`, where in every match the ranges x and y (start, end) of the sides overlap.

    Each row is in the table once by its start, and in each bucket of the other side's starts that its range touches. Two rows meet by the start that
    comes later, x's where they are equal, so no pair meets twice."""
    found = {"x": _buckets(left.select(x[0].alias("p"))), "y": _buckets(right.select(y[0].alias("p")))}

    def placed(rows: DataFrame, own: str, other: str, start: Column, end: Column, tasks: int) -> DataFrame:
        there = _spread(rows.where(start.isNotNull() & end.isNotNull()), tasks)
        there = _placed(there, {"__own": (start, found[own], 0), "__first": (start, found[other], 0), "__last": (end, found[other], 0)})
        return there.withColumn("__way", _way(rows, F.col("__own"), found[own]))

    def dealt(rows: DataFrame, own: str, other: str, start: Column, end: Column) -> tuple[DataFrame, int]:
        """The rows with their places, and the pairs of them with starts of the other side, about."""
        tasks = found[own].tasks
        at = placed(rows, own, other, start, end, tasks)
        copies, more = _share(at, F.when(F.col("__first") <= F.col("__last"), _copied(F.col("__first"), F.col("__last"), found[other])), COPIES)
        return placed(rows, own, other, start, end, more) if more > tasks else at, copies * found[other].rows

    def keyed(rows: DataFrame, own: str, other: str) -> DataFrame:
        # Even keys are of x's starts, odd ones of y's.
        key = lambda side, slot: slot * F.lit(2) + F.lit("xy".index(side))
        touched = F.sequence(key(other, _slot(F.col("__first"), found[other])), key(other, _slot(F.col("__last") + F.lit(1), found[other]) - F.lit(1)), F.lit(2).cast("long"))
        itself = key(own, _slot(F.col("__own"), found[own]) + F.col("__way"))
        keys = F.when(F.col("__first") <= F.col("__last"), F.array_append(touched, itself)).otherwise(F.array(itself))
        return rows.withColumn(f"__{own}", F.explode(keys)).drop("__own", "__first", "__last", "__way")

    by_x = F.col("__x") % 2 == 0
    on = (F.col("__x") == F.col("__y")) & match & (by_x == (y[0] <= x[0]))
    (xs, of_x), (ys, of_y) = dealt(left, "x", "y", *x), dealt(right, "y", "x", *y)
    parts = _partitions(of_x + of_y)
    xs, ys = keyed(xs, "x", "y"), keyed(ys, "y", "x")
    if parts > 1:
        xs, ys = xs.repartition(parts, "__x").hint("merge"), ys.repartition(parts, "__y").hint("merge")
    return xs.join(ys, on, "inner")


def range_join(left: DataFrame, right: DataFrame, match: Column, kind: str) -> DataFrame | None:
    """left (alias x) joined with right (alias y) by a condition of comparisons; with helper columns besides those of the two. None where this way has no answer:
    there is an equality to join by, no comparison of numbers, dates or moments, or rows of ranges would have to stay without a match.

    Inner joins are made for points on either side and for overlaps; joins that keep unmatched rows of one side, and semi and anti joins, for points on that side.
    Finding the cut points reads the points once."""
    found = comparisons(left, right, match)
    if found is None:
        return None
    numbers = {(s, getattr(c, s)): _number(left if s == "x" else right, getattr(c, s)) for c in found for s in "xy"}
    usable = [c for c in found if numbers["x", c.x] is not None and numbers["y", c.y] is not None]
    if not usable:
        return None

    def options(side: str) -> dict[str, list[Comparison]]:
        """The comparisons by the expression of this side that they share."""
        out: dict[str, list[Comparison]] = {}
        for c in usable:
            out.setdefault(getattr(c, side), []).append(c)
        return out

    keeps = {"inner": "xy", "left": "x", "left_semi": "x", "left_anti": "x", "right": "y"}.get(kind, "")
    best: tuple[int, str, str] | None = None
    for side in keeps:
        for sql, own in options(side).items():
            both = len({c.above for c in own})
            if best is None or both > best[0]:
                best = both, side, sql

    def sought(side: str, sql: str, own: list[Comparison], on: Column) -> DataFrame:
        other = "y" if side == "x" else "x"
        point, bounds = numbers[side, sql], {up: [numbers[other, getattr(c, other)] for c in own if (c.above == (side == "x")) != up] for up in (False, True)}
        points, ranges = (left, right) if side == "x" else (right, left)
        return _within(points, point, ranges, bounds[False], bounds[True], on, kind, side == "x")

    if best is None:
        return None
    if best[0] == 2 or kind != "inner" or len({c.above for c in usable}) < 2:
        return sought(best[1], best[2], options(best[1])[best[2]], match)
    below, above = (next(c for c in usable if c.above == up) for up in (False, True))
    # An overlap: x.low <= y.high and y.low <= x.high.
    x, y = (numbers["x", below.x], numbers["x", above.x]), (numbers["y", above.y], numbers["y", below.y])
    return _overlaps(left, right, x, y, match)
