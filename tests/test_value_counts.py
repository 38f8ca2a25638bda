"""Distinct counts and most frequent values: for all columns in one pass, in bounded memory."""

import datetime
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import ledgerframe as lf


def least_mode(values):
    counts = Counter(v for v in values if v is not None)
    return min(counts, key=lambda v: (-counts[v], v), default=None)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_figures_of_every_class_equal_counts_in_python(spark):
    random.seed(1)
    day = lambda k: datetime.date(2020, 1, 1) + datetime.timedelta(days=k)
    moment = lambda k: datetime.datetime(1969, 12, 31, 23, 0) + datetime.timedelta(seconds=k * 0.5)
    pick = lambda make, n: [None if random.random() < 0.1 else make(random.randrange(n)) for _ in range(400)]
    columns = {
        "word string": pick(lambda k: f"w{k}", 30),
        "all_once string": [f"{k:03d}" for k in range(400)],
        "twice string": [f"{k % 200:03d}" for k in range(400)],
        "some_twice string": [f"{k if k < 300 else k - 100:03d}" for k in range(400)],
        "day date": pick(day, 9),
        "moment timestamp": pick(moment, 40),
        "local timestamp_ntz": pick(moment, 40),
        "flag boolean": pick(lambda k: k > 4, 9),
        "none string": [None] * 400,
        "k word` int": pick(lambda k: k, 50),
        "x double": [float("nan") if random.random() < 0.1 else random.choice([0.0, -0.0, 1.5, 2.5]) for _ in range(400)],
        "long bigint": [(1 << 62) + k % 7 for k in range(400)],
    }
    names = [c.rsplit(" ", 1)[0] for c in columns]
    schema = ", ".join("`{}` {}".format(n.replace("`", "``"), c.rsplit(" ", 1)[1]) for n, c in zip(names, columns, strict=True))
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), schema).repartition(3)
    table = {r.variable: r for r in lf.get_summary_table(df).collect()}
    assert list(table) == names
    for n, values in zip(names, columns.values(), strict=True):
        there = [v for v in values if v is not None and v == v]
        assert (table[n].n_unique, table[n].missing) == (len(set(there)), len(values) - len(there)), n
        if n in ("k word`", "x", "long"):
            assert table[n].most_frequent is None
            continue
        mode = least_mode(values)
        text = None if mode is None else str(mode).lower() if isinstance(mode, bool) else str(mode).removesuffix("00000") if isinstance(mode, datetime.datetime) else str(mode)
        assert table[n].most_frequent == text, n
    rough = {r.variable: r for r in lf.get_summary_table(df, approximate=True).collect()}
    assert {n: r.most_frequent for n, r in rough.items()} == {n: r.most_frequent for n, r in table.items()}


def test_lists_and_bytes(spark):
    df = spark.createDataFrame([([1], b"a", {"x": 1}), ([1], b"b", None), ([2, 3], b"b", {"x": 1})], "l array<int>, b binary, m map<string,int>")
    table = {r.variable: r for r in lf.get_summary_table(df).collect()}
    assert [(table[c].n_unique, table[c].missing, table[c].most_frequent) for c in "lbm"] == [(2, 0, '{"l":[1]}'), (2, 0, "b"), (1, 1, '{"m":{"x":1}}')]


def test_wide_frames_are_counted_in_one_pass_without_expanding_rows(spark):
    df = spark.range(50).select(*[(F.col("id") % (k + 1)).cast("string").alias(f"c{k}") for k in range(54)])
    out = lf.get_summary_table(df)
    text = plan_of(out)
    assert "Expand" not in text and "mode(" not in text
    # One scan for the aggregates, one for the counts (its exchange is used again), one for the values.
    assert text.count("Range (0, 50") <= 5
    rows = out.collect()
    assert [r.n_unique for r in rows] == [min(k + 1, 50) for k in range(54)] and rows[1].most_frequent == "0"


@pytest.mark.parametrize("rows", [0, 1])
def test_empty_and_single_rows(spark, rows):
    df = spark.createDataFrame([("a", 1, None)][:rows], "s string, i int, position date")
    table = {r.variable: r for r in lf.get_summary_table(df).collect()}
    assert [(table[c].n_unique, table[c].most_frequent) for c in ("s", "i", "position")] == [(rows, "a" if rows else None), (rows, None), (0, None)]


def test_long_distinct_texts_do_not_fill_a_task(spark):
    """A million texts of a kilobyte each: one buffer with all of them would be a gigabyte in one of this session's small tasks."""
    df = spark.range(0, 1_000_000, 1, 8).select(F.concat(F.col("id"), F.repeat(F.lit("x"), 1000)).alias("text"))
    row = lf.get_summary_table(df.union(df.where("id = 77"))).first()
    assert row.n_unique == 1_000_000 and row.most_frequent == "77" + "x" * 1000


def test_most_frequent_values_are_sought_without_sorting_cells(spark):
    """Equal cells become one by a hash before the least is sought."""
    from ledgerframe.plans.values import value_figures

    df = spark.createDataFrame([(i % 3 != 0, f"t{i // 2 if i < 40 else 1000 + i}", "b" if i % 2 else "a") for i in range(100)], "large boolean, rare string, tied string")
    found = value_figures(df, list(enumerate(df.schema.fields)), [0, 1, 2])
    assert {r.k: (r.distinct, r.level, r.mode) for r in found.collect()} == {0: (2, False, "true"), 1: (80, False, "t0"), 2: (2, True, None)}
    assert re.search(r"Aggregate \[k#\d+, rank#\d+L?, text#\d+\], \[", found._jdf.queryExecution().optimizedPlan().toString())
