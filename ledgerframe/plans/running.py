"""Running sums and first rows in a global order, without a window over all rows.

Rows are range-partitioned by the order, summed inside their partitions, and shifted by a prefix sum over the partitions' totals: one row for
each partition is all that ever meets in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(rows: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with `position` (from 1) in this order and, for each name, the sum of its column up to the row itself.

    The ordered rows are persisted, because the totals and the sums must see the same partitions."""
    ordered = rows.select("*", *[c.alias(f"__s{i}") for i, c in enumerate(sums.values())]).orderBy(*order)
    ordered = ordered.withColumn("__m", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__m", 33)).persist()
    measures = {"position": F.lit(1), **{s: F.col(f"__s{i}") for i, s in enumerate(sums)}}
    totals = ordered.groupBy("__part").agg(*[F.sum(c).alias(f"__t{k}") for k, c in enumerate(measures.values())])
    # One row for each partition.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__part", *[F.coalesce(F.sum(f"__t{k}").over(before), F.lit(0)).alias(f"__b{k}") for k in range(len(measures))])
    inside = Window.partitionBy("__part").orderBy("__m").rowsBetween(Window.unboundedPreceding, 0)
    placed = ordered.join(F.broadcast(starts), "__part")
    out = [(F.sum(c).over(inside) + F.col(f"__b{k}")).alias(s) for k, (s, c) in enumerate(measures.items())]
    return placed.select(*rows.columns, *out)


def first_of_each(rows: DataFrame, group: Column, order: Sequence[Column], most: int) -> DataFrame:
    """The first `most` rows of each group in this order, whatever the sizes of `most` and of the groups.

    Up to Spark's own threshold a window with a limit does it, which each task applies before the shuffle. Beyond it rows are ordered over
    all partitions and the groups' places come from a prefix sum over partitions, so that no task holds a group. The groups must be few: there is one
    row for each partition and group."""
    if most <= int(rows.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
        return rows.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")
    # The ordered rows are persisted, because the sizes and the places must see the same partitions.
    ordered = rows.withColumn("__group", group).orderBy(F.col("__group"), *order)
    ordered = ordered.withColumn("__m", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__m", 33)).persist()
    sizes = ordered.groupBy(F.col("__group").alias("__g"), F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("n"), F.min("__m").alias("__first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__g", "__p", "__first", before.alias("__before")).where(F.col("__before") < most)
    placed = ordered.join(starts, F.col("__group").eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    return placed.where(F.col("__m") - F.col("__first") + F.col("__before") < most).select(*rows.columns)


def with_total(rows: DataFrame, column: str, total: str) -> DataFrame:
    """rows with the sum of a column over all of them, from a subquery of one value."""
    return rows.withColumn(total, rows.agg(F.sum(column)).scalar())
