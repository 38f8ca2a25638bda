import json
from datetime import timezone

import pytest
from pyspark.sql import functions as F

import ledgerframe as lf
from ledgerframe.operators.diff import resolve_snapshot
from ledgerframe.sources.serialize import df_to_trail, list_to_trail


@pytest.fixture
def orders(spark):
    return spark.createDataFrame([(1, 100.0), (2, 200.0), (3, 300.0), (4, 400.0)], "id int, amount double")


@pytest.fixture
def lookup(spark):
    return spark.createDataFrame([(2, "A"), (3, "B"), (5, "C")], "id int, name string")


@pytest.fixture
def trail(orders, lookup):
    t = lf.audit_trail("export")
    raw = lf.audit_tap(orders, t, "raw")
    joined = lf.left_join_tap(raw, lookup, "id", trail=t, label="joined")
    kept = lf.filter_tap(joined, "amount > 100", trail=t, label="filtered", quiet=True)
    lf.audit_tap(kept, t, "final", fns={"n": lambda d: d.count(), "top": F.max("amount")})
    return t


def test_snapshot_counts_and_summary(spark):
    df = spark.createDataFrame([(1, "a", 1.1), (2, "b", 2.2), (3, "c", None), (4, None, 4.4), (5, "e", 5.5)], "x int, y string, z double")
    t = lf.audit_trail("t")
    assert lf.audit_tap(df, t, "s") is df
    s = t.snapshots[0]
    assert (s.nrow, s.ncol, s.total_nas) == (5, 3, 2)
    assert s.schema == [{"column": "x", "type": "integer", "n_na": 0}, {"column": "y", "type": "character", "n_na": 1}, {"column": "z", "type": "numeric", "n_na": 1}]
    x = s.numeric_summary[0]
    assert (x["min"], x["q25"], x["median"], x["mean"], x["q75"], x["max"]) == (1, 2, 3, 3, 4, 5)


def test_nan_is_missing_and_left_out(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "v double")
    t = lf.audit_trail("t")
    lf.audit_tap(df, t)
    assert t.snapshots[0].total_nas == 2
    assert t.snapshots[0].numeric_summary[0]["mean"] == 2.0 and t.snapshots[0].numeric_summary[0]["max"] == 3.0


@pytest.mark.parametrize("rows", [[], [(None,)] * 5])
def test_all_missing_and_zero_rows(spark, rows):
    t = lf.audit_trail("t")
    lf.audit_tap(spark.createDataFrame(rows, "x double"), t)
    s = t.snapshots[0]
    assert (s.nrow, s.total_nas) == (len(rows), len(rows))
    assert s.numeric_summary == [{"column": "x", **dict.fromkeys(("min", "q25", "median", "mean", "q75", "max"))}]


def test_no_numeric_columns_and_no_summary(spark, orders):
    t = lf.audit_trail("t")
    lf.audit_tap(spark.createDataFrame([("a",)], "x string"), t)
    lf.audit_tap(orders, t, numeric_summary=False)
    assert [s.numeric_summary for s in t.snapshots] == [None, None]


def test_labels(orders):
    t = lf.audit_trail("t")
    lf.audit_tap(orders, t)
    lf.audit_tap(orders, t, "two")
    assert t.labels == ["step_1", "two"]
    with pytest.raises(ValueError):
        lf.audit_tap(orders, t, "two")
    with pytest.raises(TypeError):
        lf.audit_tap(orders, "trail")
    with pytest.raises(TypeError):
        lf.audit_tap([1, 2], t)
    with pytest.raises(TypeError):
        lf.audit_tap(orders.groupBy("id"), t)


def test_custom_functions(orders):
    t = lf.audit_trail("t")
    lf.audit_tap(orders, t, fns=[lambda d: d.count(), F.avg("amount")])
    lf.audit_tap(orders, t, fns={"named": lambda d: {"a": 1, "b": 2}})
    assert t.snapshots[0].custom == {"fn_1": 4, "fn_2": 250.0}
    assert "a=1, b=2" in str(t)
    with pytest.raises(TypeError):
        lf.audit_tap(orders, t, fns={"x": 3})


def test_scope(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    t = lf.audit_trail("t")
    lf.audit_tap(df, t, cols_include=["a", "b"])
    lf.audit_tap(df, t, cols_include=["a", "c"])
    lf.audit_tap(df, t, cols_exclude=["a"])
    assert [[c["column"] for c in s.schema] for s in t.snapshots] == [["a", "b"], ["a", "c"], ["b", "c"]]
    assert t.snapshots[1].changes.cols_added == t.snapshots[1].changes.cols_removed == []
    assert t.snapshots[0].ncol == 3
    with pytest.warns(UserWarning, match="don't exist"):
        lf.audit_tap(df, t, cols_include=["a", "zz"])
    with pytest.raises(ValueError):
        lf.audit_tap(df, t, cols_include=["a"], cols_exclude=["b"])


def test_changes(spark):
    t = lf.audit_trail("t")
    df = lf.audit_tap(spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "x int, y double"), t)
    lf.audit_tap(df.where("y is not null").withColumn("x", F.col("x").cast("string")).withColumn("z", F.lit(1)), t)
    c = t.snapshots[1].changes
    assert (c.row_delta, c.col_delta, c.na_delta, c.cols_added, c.cols_removed) == (-1, 1, -1, ["z"], [])
    assert c.type_changes == [{"column": "x", "from": "integer", "to": "character"}]
    assert t.snapshots[0].changes is None


def test_wide_frames_are_summarised_in_parts(spark, monkeypatch):
    monkeypatch.setattr("ledgerframe.plans.profile.QUANTILE_COLUMNS", 3)
    df = spark.range(5).select(*[(F.col("id") * k).alias(f"c{k}") for k in range(8)])
    t = lf.audit_trail("t")
    lf.audit_tap(df, t)
    assert [s["max"] for s in t.snapshots[0].numeric_summary] == [4.0 * k for k in range(8)]


def test_diff(trail):
    d = lf.audit_diff(trail, "raw", "final")
    assert (d.changes.row_delta, d.changes.col_delta) == (-1, 1)
    assert d.changes.cols_added == ["name"]
    shift = {x["column"]: x["delta"] for x in d.numeric_shifts}
    assert shift == {"id": 0.5, "amount": 50.0}
    assert lf.audit_diff(trail, 1, 2).na_changes is None
    assert lf.audit_diff(trail, 2, 3).na_changes == [{"column": "name", "from": 2, "to": 1, "delta": -1}]
    assert "From 'raw' to 'final'" in str(d)
    for wrong, error in (("nope", KeyError), (9, IndexError), (0, IndexError), (1.5, TypeError), (True, TypeError)):
        with pytest.raises(error):
            resolve_snapshot(trail, wrong)


def test_diff_frame(spark, trail):
    rows = {(r.kind, r.column): r.delta for r in lf.audit_diff(trail, "raw", "final").to_df(spark).collect()}
    assert rows["rows", None] == -1 and rows["mean", "amount"] == 50.0


def test_report_and_prints(trail, capsys):
    text = lf.audit_report(trail)
    assert capsys.readouterr().out.strip() == text
    for part in ("raw", "joined", "left_join (one-to-one)", "filter (keep)", "Final profile", "Custom diagnostics", "Changes"):
        assert part in text
    assert "no snapshots" in str(lf.audit_trail("none"))
    assert "Snapshot 'raw'" in str(trail.snapshots[0])
    with pytest.raises(ValueError):
        lf.audit_report(trail, format="pdf")


def test_long_custom_values_are_cut(orders):
    t = lf.audit_trail("t")
    lf.audit_tap(orders, t, fns={"many": lambda d: {f"key{i}": i for i in range(20)}, "frame": lambda d: d})
    assert "..." in str(t) and "<DataFrame>" in str(t)


def test_plain_form(trail):
    data = lf.trail_to_list(trail)
    assert data["n_snapshots"] == 4 and list(data["snapshots"]) == ["raw", "joined", "filtered", "final"]
    assert data["created_at"].endswith("Z")
    json.dumps(data)


def test_frame_form(spark, trail):
    df = lf.trail_to_df(trail, spark)
    assert df.count() == 4 and len(df.columns) == 17
    assert lf.trail_to_df(lf.audit_trail("e"), spark).columns == df.columns
    back = df_to_trail(df)
    assert back.labels == trail.labels and back.snapshots[2].changes == trail.snapshots[2].changes


@pytest.mark.parametrize("file", ["t.json", "t.trail"])
def test_round_trips(spark, trail, tmp_path, file):
    path = str(tmp_path / file)
    assert lf.write_trail(trail, path) is trail
    back = lf.read_trail(path)
    assert (back.name, back.created_at, back.labels) == (trail.name, trail.created_at, trail.labels)
    for a, b in zip(trail.snapshots, back.snapshots, strict=True):
        assert (a.nrow, a.schema, a.numeric_summary, a.changes, a.custom, a.timestamp, a.diagnostics, a.controls) == (b.nrow, b.schema, b.numeric_summary, b.changes, b.custom, b.timestamp, b.diagnostics, b.controls)


@pytest.mark.parametrize("file", ["e.json", "e.trail"])
def test_empty_round_trips(spark, tmp_path, file):
    path = str(tmp_path / file)
    lf.write_trail(lf.audit_trail("nothing yet"), path)
    back = lf.read_trail(path)
    assert back.name == "nothing yet" and len(back) == 0 and back.created_at.tzinfo == timezone.utc


def test_formats(trail, tmp_path):
    with pytest.raises(ValueError):
        lf.write_trail(trail, str(tmp_path / "t.txt"))
    with pytest.raises(FileNotFoundError):
        lf.read_trail(str(tmp_path / "absent.json"))
    lf.write_trail(trail, str(tmp_path / "t.txt"), format="json")
    assert lf.read_trail(str(tmp_path / "t.txt"), format="json").labels == trail.labels


def test_zero_columns_round_trip(spark):
    t = lf.audit_trail("z")
    lf.audit_tap(spark.range(3).select(), t)
    assert (t.snapshots[0].nrow, t.snapshots[0].ncol, t.snapshots[0].schema) == (3, 0, [])
    assert list_to_trail(lf.trail_to_list(t)).snapshots[0].schema == []


def test_html(trail, tmp_path, orders):
    lf.audit_tap(orders, trail, "odd", fns={"x": lambda d: "</script><b>", "nan": lambda d: float("nan")})
    path = lf.audit_export(trail, str(tmp_path / "t.html"))
    page = open(path, encoding="utf-8").read()
    assert page.count("</script>") == 2 and "@@TRAIL@@" not in page
    data = page.split('id="trail">')[1].split("</script>")[0]
    assert list(json.loads(data)["snapshots"]) == trail.labels
    assert lf.audit_export(lf.audit_trail("e")).endswith(".html")


def test_cache_and_release(orders):
    t = lf.audit_trail("t")
    held = lf.audit_tap(orders, t, cache=True)
    assert held.is_cached
    t.release()
    assert not held.is_cached


@pytest.mark.parametrize("way", ["sorted", "approximate"])
def test_ways_to_quantiles(spark, way):
    df = spark.range(1001).select(F.col("id"), (F.col("id") % 7).cast("double").alias("ties"), F.lit(None).cast("double").alias("none")).repartition(5)
    exact, other = lf.audit_trail("a"), lf.audit_trail("b")
    lf.audit_tap(df, exact)
    lf.audit_tap(df, other, quantiles=way)
    assert exact.snapshots[0].numeric_summary == other.snapshots[0].numeric_summary
    lf.filter_tap(df, "id >= 500", trail=exact, quiet=True)
    lf.filter_tap(df, "id >= 500", trail=other, quiet=True, quantiles="sorted")
    assert exact.snapshots[1].numeric_summary == other.snapshots[1].numeric_summary
    with pytest.raises(ValueError):
        lf.audit_tap(df, other, quantiles="guess")


def test_sorted_quantiles_interpolate(spark):
    t = lf.audit_trail("t")
    lf.audit_tap(spark.createDataFrame([(1.0,), (2.0,), (10.0,), (float("nan"),)], "v double"), t, quantiles="sorted")
    s = t.snapshots[0].numeric_summary[0]
    assert (s["min"], s["q25"], s["median"], s["q75"], s["max"]) == (1.0, 1.5, 2.0, 6.0, 10.0)
