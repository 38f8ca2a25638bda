"""Random small tables against pandas, and invariants between operators."""

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import ledgerframe as lf
from ledgerframe.operators.joins import join_frames

SOME = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
keys = st.lists(st.one_of(st.none(), st.integers(0, 5)), max_size=12)
values = st.one_of(st.none(), st.floats(-100, 100), st.just(float("nan")))


def ids(spark, found):
    return spark.createDataFrame([(k,) for k in found], "id int")


@SOME
@given(keys, keys)
def test_validation_equals_a_join(spark, x, y):
    a, b = ids(spark, x), ids(spark, y)
    v = lf.validate_join(a, b, "id")
    left, right = pd.Series(x, dtype="object"), pd.Series(y, dtype="object")
    pairs = sum(1 for i in x for j in y if i == j)
    assert v.n_matched_pairs == pairs == join_frames(a, b, "id", "inner_join").count()
    assert v.n_only_x == sum(i not in y for i in x) == join_frames(a, b, "id", "anti_join").count()
    assert v.n_only_y == sum(j not in x for j in y)
    assert v.n_only_x + join_frames(a, b, "id", "semi_join").count() == v.x_rows == len(left)
    assert (v.x_unique, v.y_unique) == (left.nunique(dropna=False), right.nunique(dropna=False))
    assert join_frames(a, b, "id", "full_join").count() == pairs + v.n_only_x + v.n_only_y


@SOME
@given(st.lists(st.tuples(values, values), min_size=1, max_size=15))
def test_comparison_equals_pandas(spark, rows):
    x = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "id int, v double")
    y = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(rows)], "id int, v double")
    c = lf.compare_tables(x, y, tol=0.5)
    frame = pd.DataFrame(rows, columns=["a", "b"], dtype="float64")
    d = (frame.a - frame.b).abs()
    bad = (d > 0.5) | (frame.a.isna() != frame.b.isna())
    assert c.total_discrepancies == int(bad.sum()) == c.to_df().count() == c.match_summary["matched_with_disc"]
    if d.notna().any():
        s = c.numeric_summary[0]
        assert s["n"] == d.notna().sum()
        assert (s["median"], s["max"]) == (pytest.approx(d.median()), pytest.approx(d.max()))


@SOME
@given(st.lists(st.one_of(st.none(), st.sampled_from("abcdef")), min_size=1, max_size=40), st.integers(1, 4))
def test_tables_add_up(spark, found, top):
    df = spark.createDataFrame([(v,) for v in found], "v string")
    whole, cut = lf.tab(df, "v"), lf.tab(df, "v", cutoff=top)
    want = pd.Series(found, dtype="object").value_counts(dropna=False)
    assert {r["value"]: r["freq"] for r in whole.rows} == {("<NA>" if k is None or k != k else k): n for k, n in want.items()}
    assert whole.total == cut.total == len(found)
    assert len(cut.rows) == min(top, len(want)) + (len(want) > top) and cut.n_other == max(0, len(want) - top)
    assert cut.rows[-1]["cum_percent"] <= 100.0


@SOME
@given(st.lists(values, min_size=1, max_size=20), st.floats(-100, 100))
def test_filters_add_up(spark, found, at):
    df = spark.createDataFrame([(v,) for v in found], "v double")
    predicate = f"NOT isnan(v) AND v > {at!r}D"
    t = lf.audit_trail("t")
    kept, left = lf.filter_tap(df, predicate, trail=t, quiet=True), lf.filter_out_tap(df, predicate, trail=t, quiet=True)
    a, b = t.snapshots
    assert a.nrow + b.nrow == len(found) == a.diagnostics["n_dropped"] + a.nrow
    assert a.nrow == kept.count() == sum(v is not None and v > at for v in found)
    assert b.nrow == left.count()
    assert a.diagnostics["n_na_in_filter"] == sum(v is None for v in found)
