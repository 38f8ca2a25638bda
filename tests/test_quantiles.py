"""Exact quantiles by narrowing ranges: those of `percentile`, in a few passes that shuffle histograms."""

import math
import random

import pytest
from pyspark.sql import functions as F

import ledgerframe as lf
from ledgerframe.plans import profile, quantiles

SHARES = (0.0, 0.25, 0.5, 0.75, 1.0)


@pytest.fixture
def passes(monkeypatch):
    seen = []
    kept = quantiles._histogram
    monkeypatch.setattr(quantiles, "_histogram", lambda df, keys: seen.append(len(keys)) or kept(df, keys))
    return seen


def columns_of(spark, columns):
    names = [f"c{k}" for k in range(len(columns))]
    df = spark.createDataFrame(list(zip(*columns, strict=True)), ", ".join(f"{n} double" for n in names)).repartition(3)
    return df, [F.col(n) for n in names]


def percentiles(df, values, shares=SHARES):
    row = df.agg(*[F.percentile(v, F.array(*map(F.lit, shares))).alias(f"q{k}") for k, v in enumerate(values)]).first()
    return [None if q is None else list(q) for q in row]


def test_hard_columns_equal_percentile(spark, passes, monkeypatch):
    random.seed(9)
    monkeypatch.setattr(quantiles, "FEW", 4)
    n = 600
    columns = [
        [random.gauss(0, 1) for _ in range(n)],
        [random.choice([0.0, -0.0, 5e-324, -5e-324, 1e-310]) for _ in range(n)],
        [10.0 ** random.randint(-300, 300) * random.choice([-1, 1]) for _ in range(n)],
        [1e15 + k for k in range(n)],
        [float("inf") if k % 3 == 0 else float("-inf") if k % 3 == 1 else 2.5 for k in range(n)],
        [7.25] * n,
        [None] * n,
        [None if k else -3.0 for k in range(n)],
        [random.choice([1.0, math.nextafter(1.0, 2), math.nextafter(1.0, 0), 1 + 2**-30]) for _ in range(n)],
        [1.7976931348623157e308 * random.choice([-1, 1, 0.5]) for _ in range(n)],
        [2.0**k if k < 60 else 3.0 for k in range(n)],
    ]
    df, values = columns_of(spark, columns)
    shares = (0.0, 0.01, 0.25, 0.333, 0.5, 0.75, 0.999, 1.0)
    assert quantiles.narrowed_quantiles(df, values, shares) == percentiles(df, values, shares)
    assert len(passes) <= 9


def test_moderate_columns_take_few_passes(spark, passes):
    df = spark.range(200_000).select((F.rand(1) * 1e6).alias("a"), F.exp(F.randn(2) * 5).alias("b"), (F.col("id") % 10).cast("double").alias("c"), F.col("id").alias("d"))
    values = [F.col(c).cast("double") for c in df.columns]
    assert quantiles.narrowed_quantiles(df, values, SHARES) == percentiles(df, values)
    assert len(passes) <= 4
    assert quantiles.narrowed_quantiles(df, [], SHARES) == []
    assert quantiles.narrowed_quantiles(df.limit(0), values, SHARES) == [None] * 4


def test_every_way_gives_the_same_summaries(spark):
    df = spark.createDataFrame([(k % 17, None if k % 5 == 0 else k / 7, float("nan")) for k in range(300)], "i int, x double, n double")
    for make in (lambda way: lf.get_summary_table(df, quantiles=way).collect(), lambda way: profile.snapshot_df(df, quantiles=way).collect()):
        assert make("narrowed") == make("sorted") == make("exact") == make("auto")


def test_frames_of_unknown_size_count_as_large(spark, passes):
    held = spark.createDataFrame([(float(k),) for k in range(9)], "x double")
    unknown = spark.range(9).select(F.col("id").cast("double").alias("x")).rdd.toDF()
    files = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert [profile.resolved_way(f, "auto") for f in (held, files, unknown, held.join(unknown, "x"))] == ["exact", "exact", "narrowed", "narrowed"]
    trail = lf.audit_trail("t")
    lf.audit_tap(held, trail, "held")
    assert passes == []
    lf.audit_tap(unknown, trail, "unknown")
    assert len(passes) == 2 and [s.numeric_summary[0]["median"] for s in trail.snapshots] == [4.0, 4.0]


def test_values_of_larger_inputs_are_not_merged_in_one_task(spark, monkeypatch):
    """Inputs of over some megabytes are narrowed: their distinct values would all be read and ranked by one task."""
    from ledgerframe.plans import profile, quantiles

    df = spark.range(1_200_000).select((F.col("id") * 7 % 1_000_003).alias("v"))
    assert profile.resolved_way(df, "auto") == "narrowed"
    passes, histogram = [], quantiles._histogram
    monkeypatch.setattr(quantiles, "_histogram", lambda df, keys: passes.append(keys) or histogram(df, keys))
    found, exact = profile.snapshot_df(df).first(), profile.snapshot_df(df, quantiles="exact").first()
    assert found == exact and 1 < len(passes) < 8


def test_no_method_of_a_pass_is_too_large_to_compile(spark, monkeypatch):
    """The JVM interprets methods of over 8,000 bytes of code, which made passes over five columns ten times as long."""
    seen, frame = [], type(spark.range(1))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: seen.append(df) or collect(df))
    df = spark.range(100_000).select(*[F.when(F.col("id") % k != 0, F.exp(F.rand(k) * k)).alias(f"v{k}") for k in range(2, 10)])
    values = [F.col(c) for c in df.columns]
    found = quantiles.narrowed_quantiles(df, values, SHARES)
    passes, debug = list(seen), getattr(spark._jvm, "org.apache.spark.sql.execution.debug.package$").__getattr__("MODULE$")
    assert found == percentiles(df, values) and len(passes) > 1
    for df in passes:
        parts = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
        assert parts.size() and max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())) < 8000


def test_the_least_and_the_greatest_value_take_one_pass(spark, passes):
    df = spark.range(10_000).select((F.rand(1) * 1e6).alias("a"))
    assert quantiles.narrowed_quantiles(df, [F.col("a")], (0.0, 1.0)) == percentiles(df, [F.col("a")], (0.0, 1.0))
    assert len(passes) == 1
