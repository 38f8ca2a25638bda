import pytest
from pyspark.sql import functions as F

import ledgerframe as lf
from ledgerframe.operators.joins import join_frames


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def df10(spark):
    return spark.createDataFrame([(i, i * 100.0, i % 2 == 1) for i in range(1, 11)], "id int, amount double, flag boolean")


def test_keep_and_drop(df10, capsys):
    assert lf.filter_keep(df10, "amount > 300").count() == 7
    out = capsys.readouterr().out
    assert "Dropped 3 of 10 rows (30.00%)" in out
    assert lf.filter_drop(df10, "amount > 300", quiet=True).count() == 3
    assert lf.filter_keep(df10, F.col("amount") > 300, "flag", quiet=True).count() == 3
    assert lf.filter_drop(df10, quiet=True).count() == 10


def test_rows_with_missing_predicates(spark):
    df = spark.createDataFrame([(1, 10.0), (2, None), (3, 30.0)], "id int, v double")
    assert lf.filter_keep(df, "v > 20", quiet=True).count() == 1
    assert {r.id for r in lf.filter_drop(df, "v > 20", quiet=True).collect()} == {1, 2}


def test_drop_by_several_predicates(spark):
    df = spark.createDataFrame([(i, 7 - i) for i in range(1, 7)], "a int, b int")
    assert lf.filter_drop(df, "a > 2", "b < 5", quiet=True).count() == 2


def test_stat_and_threshold(df10, capsys):
    lf.filter_keep(df10, "amount > 500", stat="amount")
    assert "1,500.00 of 5,500.00" in capsys.readouterr().out
    with pytest.warns(UserWarning, match="exceeds threshold"):
        lf.filter_keep(df10, "amount > 900", quiet=True, warn_threshold=0.5)
    for bad in (2, -0.1, "x", float("nan"), True):
        with pytest.raises(ValueError):
            lf.filter_keep(df10, "amount > 1", warn_threshold=bad)
    with pytest.raises(TypeError):
        lf.filter_keep(df10, "id > 1", stat="flag")


def test_empty_table_says_na(df10, capsys):
    lf.filter_keep(df10.limit(0), "amount > 1", stat="amount")
    assert capsys.readouterr().out.count("N/A") == 2


def test_filter_tap(df10):
    t = lf.audit_trail("t")
    out = lf.filter_tap(df10, "amount > 500", trail=t, stat="amount", quiet=True)
    assert rows(out) == rows(df10.where("amount > 500"))
    d = t.snapshots[0].diagnostics
    assert d == {"filter_type": "keep", "expr_label": "amount > 500", "n_dropped": 5, "n_total": 10, "pct_dropped": 50.0, "stat_dropped": 1500.0, "stat_total": 5500.0, "stat_col": "amount", "n_na_in_filter": 0}
    assert t.snapshots[0].nrow == 5 and t.snapshots[0].numeric_summary[1]["min"] == 600.0
    lf.filter_out_tap(df10, "amount > 500", "flag", trail=t, quiet=True)
    assert t.labels == ["filter_1", "filter_out_2"]
    assert t.snapshots[1].diagnostics["expr_label"] == "amount > 500 & flag" and t.snapshots[1].nrow == 8


def test_filter_tap_counts_missing_predicates(spark):
    df = spark.createDataFrame([(1, 10.0), (2, None), (3, 30.0), (4, None), (5, 50.0), (6, 60.0)], "id int, val double")
    t = lf.audit_trail("t")
    lf.filter_tap(df, "val > 20", trail=t, quiet=True)
    assert (t.snapshots[0].diagnostics["n_na_in_filter"], t.snapshots[0].nrow) == (2, 3)
    lf.filter_tap(df.limit(0), "val > 20", trail=t, quiet=True)
    assert t.snapshots[1].diagnostics["pct_dropped"] == 0.0
    lf.filter_tap(df, trail=t, quiet=True)
    assert t.snapshots[2].diagnostics["n_dropped"] == 0


def test_filter_tap_without_trail(df10, capsys):
    assert lf.filter_tap(df10, "id > 3").count() == 7
    assert capsys.readouterr().out == ""
    lf.filter_tap(df10, "id > 3", stat="amount")
    assert "Dropped" in capsys.readouterr().out
    with pytest.warns(UserWarning, match="label"):
        lf.filter_tap(df10, "id > 3", label="x")


def test_one_scan_for_a_filter_tap(spark, df10):
    """Diagnostics and snapshot come from one job's aggregate."""
    tracker, t = spark.sparkContext.statusTracker(), lf.audit_trail("t")
    spark.sparkContext.setJobGroup("one-scan", "")
    lf.filter_tap(df10, "amount > 300", trail=t, stat="amount", quiet=True)
    jobs = tracker.getJobIdsForGroup("one-scan")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 1 <= len(jobs) <= 2


@pytest.fixture
def orders(spark):
    return spark.createDataFrame([(1, 100.0), (2, 200.0), (3, 300.0), (4, 400.0)], "id int, amount double")


@pytest.fixture
def customers(spark):
    return spark.createDataFrame([(2, "A"), (3, "B"), (5, "C")], "id int, name string")


@pytest.mark.parametrize(("kind", "how"), [("left", "left"), ("right", "right"), ("inner", "inner"), ("full", "full"), ("anti", "left_anti"), ("semi", "left_semi")])
def test_six_joins(orders, customers, kind, how):
    t = lf.audit_trail("t")
    tap = getattr(lf, f"{kind}_join_tap")
    out = tap(orders, customers, "id", trail=t)
    assert rows(out) == rows(orders.join(customers, "id", how))
    s = t.snapshots[0]
    assert (s.label, s.type) == (f"{kind}_join_1", "join")
    d = s.diagnostics
    assert (d["relation"], d["n_only_x"], d["n_only_y"], d["match_rate"]["x"]) == ("one-to-one", 2, 1, 50.0)
    assert rows(tap(orders, customers, "id")) == rows(out)


def test_missing_keys_match(spark):
    x = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    y = spark.createDataFrame([(None, "n"), (2, "m")], "k int, w string")
    assert rows(join_frames(x, y, "k", "inner_join")) == [(None, "b", "n")]
    assert rows(join_frames(x, y, "k", "full_join")) == sorted([(1, "a", None), (None, "b", "n"), (2, None, "m")], key=str)


def test_named_pairs_suffix_and_natural(spark, orders, customers):
    x = spark.createDataFrame([(1, 5), (2, 6)], "key_x int, value int")
    y = spark.createDataFrame([(2, 7), (3, 8)], "key_y int, value int")
    t = lf.audit_trail("t")
    out = lf.left_join_tap(x, y, {"key_x": "key_y"}, trail=t, suffix=("_left", "_right"))
    assert out.columns == ["key_x", "value_left", "value_right"] and rows(out) == [(1, 5, None), (2, 6, 7)]
    assert t.snapshots[0].diagnostics["relation"] == "one-to-one"
    lf.inner_join_tap(orders, customers, trail=t)
    assert t.snapshots[1].diagnostics == {"join_type": "inner_join", "y_name": "y"}


def test_theta_join(spark):
    x = spark.createDataFrame([(1, 1), (2, 5), (3, 10)], "id int, start int")
    y = spark.createDataFrame([(1, 2), (2, 4), (3, 8)], "id int, threshold int")
    t = lf.audit_trail("t")
    out = lf.inner_join_tap(x, y, on="x.id = y.id AND x.start >= y.threshold", trail=t)
    assert rows(out) == [(2, 5, 2, 4), (3, 10, 3, 8)]
    assert "relation" not in t.snapshots[0].diagnostics


def test_stat_in_taps(orders, customers, capsys):
    t = lf.audit_trail("t")
    lf.left_join_tap(orders, customers, "id", trail=t, stat="amount", y_name="customers")
    stat = t.snapshots[0].diagnostics["stat"]
    assert (stat["stat_x_total"], stat["stat_x_matched"], stat["stat_x_rate"]) == (1000.0, 500.0, 50.0)
    lf.left_join_tap(orders, customers, "id", stat="amount")
    assert "Join validation" in capsys.readouterr().out
    with pytest.warns(UserWarning, match="could not be validated"):
        assert lf.left_join_tap(orders, customers, "id", stat="nope").count() == 4
    lf.left_join_tap(orders, customers, "id", trail=t, stat="nope")
    assert "validation_error" in t.snapshots[1].diagnostics


def test_unmatched_and_multiple(spark, orders, customers):
    twice = customers.union(customers)
    with pytest.raises(ValueError):
        join_frames(orders, customers, "id", unmatched="error")
    with pytest.raises(ValueError):
        join_frames(orders, twice, "id", multiple="error")
    assert join_frames(orders, twice, "id", multiple="any").count() == 4


def test_mixed_pipeline(orders, customers):
    t = lf.audit_trail("t")
    a = lf.audit_tap(orders, t, "raw")
    b = lf.left_join_tap(a, customers, "id", trail=t)
    c = lf.filter_tap(b, "name is not null", trail=t, quiet=True)
    assert c.count() == 2
    assert [s.nrow for s in t.snapshots] == [4, 4, 2]
    d = t.snapshots[2].diagnostics
    assert d["n_dropped"] + t.snapshots[2].nrow == d["n_total"]
