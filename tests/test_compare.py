import math

import pytest

import ledgerframe as lf


def pair(spark, a, b, kind="double", column="value"):
    make = lambda vs: spark.createDataFrame(list(enumerate(vs, 1)), f"id int, {column} {kind}")
    return make(a), make(b)


def test_shifted_values(spark):
    c = lf.compare_tables(*pair(spark, [10.0, 20.0, 30.0], [10.5, 20.0, 30.5]))
    assert c.comparison_method == "keys"
    assert c.match_summary["matched_with_disc"] == 2 and c.numeric_summary[0]["n_over_tol"] == 2
    assert c.total_discrepancies == 2


def test_tolerance_top_n_and_pct(spark):
    x, y = pair(spark, [10.0, 20.0, 30.0, 40.0], [10.1, 20.0, 30.5, 40.2])
    assert lf.compare_tables(x, y, tol=0.15).total_discrepancies == 2
    c = lf.compare_tables(x, y, top_n=1)
    assert c.total_discrepancies == 3 and c.discrepancies.count() == 1
    assert c.discrepancies.first().abs_diff == pytest.approx(0.5)
    rows = {r.id: r.pct_diff for r in lf.compare_tables(*pair(spark, [20.0, 0.0, None], [25.0, 5.0, 5.0])).discrepancies.collect()}
    assert rows == {1: 0.2, 2: 1.0, 3: None}


def test_missing_values(spark):
    c = lf.compare_tables(*pair(spark, [10.0, None, 30.0, None], [10.0, 20.0, 30.0, None]))
    assert c.total_discrepancies == 1 and c.discrepancies.first().abs_diff is None
    nan = lf.compare_tables(*pair(spark, [float("nan"), math.inf, 1.0], [None, math.inf, float("nan")]))
    assert nan.total_discrepancies == 1
    order = lf.compare_tables(*pair(spark, [10.0, None, 30.0, 40.0], [15.0, 20.0, 30.0, 42.0]), top_n=5).discrepancies.collect()
    assert [r.id for r in sorted(order, key=lambda r: (r.abs_diff is None, -(r.abs_diff or 0)))] == [1, 4, 2]


@pytest.mark.parametrize(("kind", "a", "b"), [("string", ["a", "b", "c", "d"], ["a", "x", "c", "z"]), ("boolean", [True, False, True, None], [True, True, True, True])])
def test_categorical(spark, kind, a, b):
    c = lf.compare_tables(*pair(spark, a, b, kind), key_cols=["id"])
    s = c.categorical_summary[0]
    assert (s["n_compared"], s["n_mismatched"], s["pct_mismatched"]) == (4, 2, 0.5)
    assert c.categorical_discrepancies.count() == 2


def test_schema_differences(spark):
    x = spark.createDataFrame([(1, 5, 1.0)], "id int, mixed int, a double")
    y = spark.createDataFrame([(1, "5", 1.0)], "id bigint, mixed string, b double")
    c = lf.compare_tables(x, y, key_cols=["id"])
    assert c.type_mismatches == [{"column": "mixed", "type_x": "integer", "type_y": "character"}]
    assert c.plan.only_x_columns == ["a"] and c.plan.only_y_columns == ["b"]
    assert c.comparison_method is None
    with pytest.raises(TypeError):
        lf.compare_tables(x, y, key_cols=["mixed"])
    with pytest.raises(ValueError):
        lf.compare_tables(x, spark.createDataFrame([(1,)], "zz int"))


def test_keys_only_in_one(spark):
    x = spark.createDataFrame([(1, 5.0), (2, 20.0), (3, 7.0), (4, 8.0)], "id int, v double")
    y = spark.createDataFrame([(2, 25.0), (3, 7.0), (5, 1.0)], "id int, v double")
    c = lf.compare_tables(x, y)
    assert c.key_summary == {"matches": 2, "only_x": 2, "only_y": 1}
    assert c.match_summary == {"only_x": 2, "only_y": 1, "matched_no_disc": 1, "matched_with_disc": 1, "pct_no_disc": 0.5, "pct_with_disc": 0.5}
    assert sorted(r.id for r in c.only_x_keys.collect()) == [1, 4]


def test_duplicate_keys_warn(spark):
    x = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0)], "id int, v double")
    with pytest.warns(UserWarning, match="not unique"):
        lf.compare_tables(x, x.where("v > 1"))


def test_column_choice(spark):
    x = spark.createDataFrame([(1, 1.0, 2.0)], "id int, a double, b double")
    y = spark.createDataFrame([(1, 2.0, 3.0)], "id int, a double, b double")
    assert lf.compare_tables(x, y, compare_cols=["a"]).plan.values == ["a"]
    assert lf.compare_tables(x, y, exclude_cols=["a"]).plan.values == ["b"]
    with pytest.raises(ValueError):
        lf.compare_tables(x, y, compare_cols=["id"])
    with pytest.warns(UserWarning, match="exclude_cols"):
        lf.compare_tables(x, y, exclude_cols=["zz"])
    for bad in ({"tol": -1}, {"tol": "a"}, {"top_n": 0}, {"compare_cols": ["a"], "exclude_cols": ["b"]}):
        with pytest.raises(ValueError):
            lf.compare_tables(x, y, **bad)


def test_row_index(spark):
    x = spark.createDataFrame([(float(v),) for v in range(10, 60, 10)], "value double").repartition(3)
    y = spark.createDataFrame([(10.0,), (21.0,), (30.0,)], "value double")
    c = lf.compare_tables(x, y, order_by=["value"])
    assert c.comparison_method == "row_index"
    assert [tuple(r) for r in c.discrepancies.select("row_index", "value_x", "value_y").collect()] == [(2, 20.0, 21.0)]
    assert c.match_summary["only_x"] == 2 and sorted(r.row_index for r in c.only_x_keys.collect()) == [4, 5]
    c.release()


def test_zero_rows_and_text(spark):
    x = spark.createDataFrame([], "id int, value double")
    c = lf.compare_tables(x, x)
    assert c.numeric_summary is None and c.match_summary["pct_no_disc"] is None
    full = lf.compare_tables(*pair(spark, [1.0] * 9, [2.0] * 9))
    assert "... and 7 more\n" in full.text(show_n=2) and "Numeric differences" in str(full)
    assert "... and 7 more (4 stored)" in lf.compare_tables(*pair(spark, [1.0] * 9, [2.0] * 9), top_n=4).text(show_n=2)
    tidy = full.to_df()
    assert tidy.columns == ["id", "column", "type", "value_x", "value_y", "abs_diff", "pct_diff"] and tidy.count() == 9
    assert c.to_df().count() == 0
