"""Joins by ranges alone: the rows of a nested loop, without one in the plan."""

import datetime
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import ledgerframe as lf
from ledgerframe.operators.joins import KINDS, join_frames
from ledgerframe.plans import ranges

X, Y = "xid long, p double, a double, b double, day date, s string, n int", "yid long, low double, high double, since date, s string, m bigint"


def some(value):
    return None if random.random() < 0.08 else value


@pytest.fixture(scope="module")
def tables(spark):
    random.seed(8)
    day = lambda: datetime.date(2021, 1, 1) + datetime.timedelta(days=random.randrange(60))
    x, y = [], []
    for k in range(700):
        # A third of the points are one value; some are not numbers.
        p = 5.0 if k % 3 == 0 else float("nan") if k % 50 == 1 else float("inf") if k % 50 == 2 else random.uniform(-20, 20)
        a = random.uniform(-20, 20)
        x.append((k, some(p), some(a), some(a + random.uniform(-1, 3)), some(day()), f"s{k % 7}", some(random.randrange(40))))
    for k in range(300):
        low = 5.0 if k % 40 == 0 else random.uniform(-25, 25)
        y.append((k, some(low), some(low + random.choice([0.0, 0.2, 2.0, 30.0, -1.0])), some(day()), f"s{k % 7}", some(random.randrange(40))))
    return spark.createDataFrame(x, X).repartition(3), spark.createDataFrame(y, Y).repartition(3)


@pytest.fixture
def few_rows_a_bucket(monkeypatch):
    monkeypatch.setattr(ranges, "ROWS", 8)


def counted(df):
    return Counter(str(tuple(r)) for r in df.collect())


def plain(x, y, on, kind):
    joined = x.alias("x").join(y.alias("y"), F.expr(on), kind)
    return joined.select("x.*") if kind in ("left_semi", "left_anti") else joined


def nested(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return "NestedLoop" in text or "Cartesian" in text


POINT_IN_X = ["x.p BETWEEN y.low AND y.high", "x.p > y.low AND x.p < y.high", "y.low <= x.p AND x.p <= y.high AND x.s <> y.s", "x.p >= y.low", "x.n + 1 < y.m", "x.day >= y.since AND x.day <= date_add(y.since, 2)", "x.p >= y.low AND x.p <= y.high AND x.a > y.low"]
POINT_IN_Y = ["y.low BETWEEN x.a AND x.b", "x.a < y.low AND y.low < x.b AND x.s <> 's1'"]
OVERLAPS = ["x.a <= y.high AND y.low <= x.b", "x.a < y.high AND x.b > y.low AND x.s <> y.s"]


@pytest.mark.parametrize("how", ["inner_join", "left_join", "semi_join", "anti_join"])
@pytest.mark.parametrize("on", POINT_IN_X)
def test_points_of_x_between_bounds_of_y(tables, few_rows_a_bucket, on, how):
    joined = join_frames(*tables, on=on, how=how)
    assert not nested(joined)
    assert counted(joined) == counted(plain(*tables, on, KINDS[how]))


@pytest.mark.parametrize("how", ["inner_join", "right_join"])
@pytest.mark.parametrize("on", POINT_IN_Y)
def test_points_of_y_between_bounds_of_x(tables, few_rows_a_bucket, on, how):
    joined = join_frames(*tables, on=on, how=how)
    assert not nested(joined)
    assert counted(joined) == counted(plain(*tables, on, KINDS[how]))


@pytest.mark.parametrize("on", OVERLAPS)
def test_overlaps(tables, few_rows_a_bucket, on):
    joined = join_frames(*tables, on=on, how="inner_join")
    assert not nested(joined)
    assert counted(joined) == counted(plain(*tables, on, "inner"))


@pytest.mark.parametrize(("on", "how"), [("x.p BETWEEN y.low AND y.high", "full_join"), ("x.p BETWEEN y.low AND y.high", "right_join"), ("x.s < y.s", "inner_join"), ("x.p * y.low > 3", "inner_join"), ("x.n = y.m AND x.p >= y.low", "left_join"), ("x.p > 3 AND y.low < 2", "inner_join"), ("x.p BETWEEN y.low AND y.high OR x.n > y.m", "inner_join")])
def test_other_conditions_are_left_to_spark(tables, on, how):
    assert counted(join_frames(*tables, on=on, how=how)) == counted(plain(*tables, on, KINDS[how]))


def test_conditions_of_columns_and_tables_without_rows(spark, tables, few_rows_a_bucket):
    x, y = tables
    joined = join_frames(x, y, (x["p"] >= y["low"]) & (x["p"] <= y["high"]), how="inner_join")
    assert counted(joined) == counted(plain(x, y, POINT_IN_X[0], "inner"))
    for a, b in ((x.limit(0), y), (x, y.limit(0))):
        for how in ("inner_join", "left_join", "anti_join"):
            assert join_frames(a, b, on=POINT_IN_X[0], how=how).count() == (a.count() if how != "inner_join" else 0)


def test_a_tap_records_the_join(tables):
    trail = lf.audit_trail("t")
    joined = lf.inner_join_tap(*tables, on=POINT_IN_X[0], trail=trail)
    assert trail.snapshots[0].nrow == joined.count() and "relation" not in trail.snapshots[0].diagnostics
    assert joined.columns == ["xid", "p", "a", "b", "day", "s_x", "n", "yid", "low", "high", "since", "s_y", "m"]


def test_hundreds_of_thousands_of_rows_a_side(spark):
    n = 200_000
    x = spark.range(n).select(F.col("id").alias("xid"), (F.col("id") * 7919 % 1_000_003).cast("double").alias("at"))
    y = spark.range(n).select(F.col("id").alias("yid"), (F.col("id") * 104_729 % 1_000_003).cast("double").alias("low"))
    joined = join_frames(x, y, on="x.at >= y.low AND x.at < y.low + 10", how="inner_join")
    assert not nested(joined)
    # The same by an equality on the offset.
    offsets = y.select("yid", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"), "low")
    assert joined.count() == x.join(offsets, F.col("at") == F.col("low") + F.col("k")).count() > n


@pytest.fixture
def few_pairs_a_task(monkeypatch, few_rows_a_bucket):
    monkeypatch.setattr(ranges, "PAIRS", 64)


@pytest.mark.parametrize("how", ["inner_join", "left_join", "semi_join", "anti_join"])
def test_pairs_are_dealt_to_many_tasks(tables, few_pairs_a_task, how):
    x, y = tables
    on = "x.p BETWEEN y.low AND y.high"
    joined = join_frames(x, y, how=how, on=on)
    kind = {"inner_join": "inner", "left_join": "left", "semi_join": "left_semi", "anti_join": "left_anti"}[how]
    ids = [c for c in ("xid", "yid") if c in joined.columns]
    assert Counter(joined.select(ids).collect()) == Counter(x.alias("x").join(y.alias("y"), F.expr(on), kind).select(ids).collect())
    sizes = [r.n for r in joined.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 16
    # A third of the points have one value and meet a fortieth of the ranges and more: no task has more than a part of the pairs.
    assert how == "anti_join" or max(sizes) < sum(sizes) / 4


def test_overlaps_are_dealt_to_many_tasks(tables, few_pairs_a_task):
    x, y = tables
    on = "x.a <= y.high AND y.low <= x.b"
    joined = join_frames(x, y, how="inner_join", on=on)
    expected = x.alias("x").join(y.alias("y"), F.expr(on)).select("xid", "yid")
    assert Counter(joined.select("xid", "yid").collect()) == Counter(expected.collect())
    sizes = [r.n for r in joined.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 16 and max(sizes) < sum(sizes) / 4


def spread_over(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    # The tables' own partitions are three.
    return [int(n) for n in re.findall(r"RoundRobinPartitioning\((\d+)\)", plan) if n != "3"]


@pytest.mark.parametrize(("on", "sides"), [("x.a <= y.high AND y.low <= x.b", 2), ("x.p BETWEEN y.low AND y.high", 1)])
@pytest.mark.parametrize(("limit", "few"), [("DEALT", 50), ("COPIES", 300)])
def test_one_partition_does_not_deal_all_rows(tables, few_rows_a_bucket, monkeypatch, on, sides, limit, few):
    # As a file of a few MB is, one task to Spark; either many rows or rows with many copies.
    x, y = (df.coalesce(1) for df in tables)
    monkeypatch.setattr(ranges, limit, few)
    joined = join_frames(x, y, how="inner_join", on=on)
    assert len(found := spread_over(joined)) == sides and min(found) > 3
    assert counted(joined) == counted(plain(x, y, on, "inner"))


def test_rows_in_many_partitions_stay_there(tables, few_rows_a_bucket, monkeypatch):
    monkeypatch.setattr(ranges, "DEALT", 300)
    assert not spread_over(join_frames(*tables, how="inner_join", on="x.a <= y.high AND y.low <= x.b"))


@pytest.mark.parametrize("on", ["x.p BETWEEN y.low AND y.high", "x.p <= y.high AND y.low <= x.p + 1 AND x.p + 1 >= y.low"])
def test_zero_with_either_sign(spark, few_rows_a_bucket, on):
    x = spark.createDataFrame([(k, [-0.0, 0.0, -1.0, 1.0][k % 4]) for k in range(80)], "xid long, p double")
    y = spark.createDataFrame([(k, *[(0.0, 0.0), (-0.0, -0.0), (0.0, -0.0), (-0.0, 2.0), (-2.0, -0.0), (1.0, float("nan"))][k % 6]) for k in range(60)], "yid long, low double, high double")
    assert counted(join_frames(x, y, how="inner_join", on=on)) == counted(plain(x, y, on, "inner"))
