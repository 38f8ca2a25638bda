"""Margins of crosstabs: from one grouping, joined back without a window."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerframe.operators.tabulate import crosstab_df


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("weight", [None, "w"])
def test_margins_equal_sums_in_python(spark, weight):
    random.seed(4)
    # One row value has most of the cells, and one column value of its own has many rows.
    rows = [("hot", f"c{k}", 1.0) for k in range(3000)] + [(random.choice(["x", "y", None]), random.choice(["c1", "c2", None]), random.choice([0.5, 2.0])) for _ in range(500)] + [(f"r{k}", "c0", 0.0) for k in range(1500)]
    df = spark.createDataFrame(rows, "a string, b string, w double").repartition(4)
    out = crosstab_df(df, "a", "b", wt=weight)
    text = plan_of(out)
    assert "Window" not in text and text.count("Expand") >= 1
    cells, down, across = Counter(), Counter(), Counter()
    for a, b, w in rows:
        size = w if weight else 1
        for counter, key in ((cells, (a, b)), (down, a), (across, b)):
            counter[key] += size
    total = sum(cells.values())
    pct = lambda n, whole: pytest.approx(100 * n / whole if whole else 0.0)
    found = out.collect()
    assert len(found) == len(cells)
    for r in found:
        key = (None if r.row_special else r.row_value, None if r.col_special else r.col_value)
        n = cells[key]
        assert (r.n, r.row_pct, r.col_pct, r.total_pct) == (pytest.approx(n), pct(n, down[key[0]]), pct(n, across[key[1]]), pct(n, total))


def test_cells_of_a_hot_value_are_split(spark):
    """A row value with nearly all cells: its cells are not one task of the join, where partitions count as large."""
    df = spark.range(40_000).select(F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(-1).alias("a"), F.col("id").alias("b"))
    options = {"coalescePartitions.enabled": "false", "skewJoin.skewedPartitionThresholdInBytes": "16k", "advisoryPartitionSizeInBytes": "16k", "skewJoin.skewedPartitionFactor": "1.5", "forceOptimizeSkewedJoin": "true"}
    for k, v in options.items():
        spark.conf.set(f"spark.sql.adaptive.{k}", v)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = crosstab_df(df, "a", "b")
        out.write.format("noop").mode("overwrite").save()
        assert out.count() == 40_000
        joined = crosstab_df(df, "a", "b").select("row_value", "row_pct")
        joined.collect()
        assert "skew=true" in plan_of(joined)
    finally:
        for k in options:
            spark.conf.unset(f"spark.sql.adaptive.{k}")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tables_without_rows(spark):
    assert crosstab_df(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0
