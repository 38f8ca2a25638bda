"""Keys and columns called like anything that the diagnostics use inside or give back, in either case."""

import pytest

import ledgerframe as lf
from ledgerframe.operators import joins

NAMES = ["n_x", "n_y", "s_x", "m_y", "n", "missing", "k0", "j0", "x0", "y0", "column", "type", "value_x", "value_y", "abs_diff", "pct_diff", "row_index", "__before", "__m", "rank", "c", "m", "part"]
CASES = [str.lower, str.upper]


@pytest.fixture(params=CASES, ids=["lower", "upper"])
def frames(spark, request):
    names = [request.param(n) for n in NAMES]
    schema = ", ".join(f"`{n}` int" for n in names) + ", v double, w string"
    x = spark.createDataFrame([(*[i] * len(names), float(i), f"t{i}") for i in (1, 2, 2, 3)], schema)
    y = spark.createDataFrame([(*[i] * len(names), float(i * 10), f"t{i}") for i in (2, 3, 4)], schema)
    return names, x, y


def test_validate_join(frames):
    names, x, y = frames
    found = lf.validate_join(x, y, names, stat="v")
    assert (found.n_only_x, found.n_only_y, found.n_key_overlap, found.relation, found.stat_x_matched) == (1, 1, 2, "many-to-one", 7.0)
    twice = found.duplicates_x
    assert twice.columns[: len(names)] == names and len({c.lower() for c in twice.columns}) == len(twice.columns)
    assert [r[: len(names)] for r in map(tuple, twice.collect())] == [(2,) * len(names)]
    assert found.keys_only_in_y.count() == 1


def test_primary_keys(frames):
    names, x, _ = frames
    found = lf.validate_primary_keys(x, names)
    assert (found.n_rows, found.n_unique_keys, found.n_duplicate_keys, found.is_primary_key) == (4, 3, 1, False)
    assert tuple(found.duplicate_keys.first()) == (*[2] * len(names), 2)


@pytest.mark.parametrize("by_index", [False, True])
def test_compare_tables(frames, by_index):
    names, x, y = frames
    x = x.dropDuplicates([names[0]]).orderBy(names[0])
    found = lf.compare_tables(x, y, [] if by_index else names, order_by=[names[0]] if by_index else None)
    assert found.match_summary["matched_with_disc"] == (3 if by_index else 2)
    cells, tidy = found.discrepancies, found.to_df()
    assert len({c.lower() for c in cells.columns}) == len(cells.columns) and len({c.lower() for c in tidy.columns}) == len(tidy.columns)
    assert cells.count() and tidy.count() and found.only_x_keys.count() == (0 if by_index else 1)
    if by_index:
        # A column called row_index is compared like any other.
        assert next(n for n in names if n.lower() == "row_index") in found.plan.values
        found.release()


def test_joins_keep_all_columns(frames):
    names, x, y = frames
    out = joins.join_frames(x, y, names, "full_join")
    assert out.columns == [*names, "v_x", "w_x", "v_y", "w_y"] and out.count() == 5
    assert joins.join_frames(x, y, names, "anti_join").columns == x.columns


def test_suffixes_are_repeated_until_names_differ(spark):
    x = spark.createDataFrame([(1, 2, 3)], "k int, v int, v_x int")
    y = spark.createDataFrame([(1, 4)], "k int, v int")
    out = joins.join_frames(x, y, "k")
    assert out.columns == ["k", "v_x_x", "v_x", "v_y"] and tuple(out.first()) == (1, 2, 3, 4)
    assert joins.join_frames(x, y, "k", suffix=("", "_y")).columns == ["k", "v", "v_x", "v_y"]
    with pytest.raises(ValueError):
        joins.join_frames(x, y, "k", suffix=("", ""))


def test_transform(frames):
    names, x, _ = frames
    for n in names[:4] + [m for m in names if m.lower() == "__before"]:
        found = lf.audit_transform(x, n, lambda c: c + 1)
        assert found.n_changed == 4 and found.cleaned.columns == x.columns


def test_ways_to_quantiles_agree(spark, monkeypatch):
    from ledgerframe.plans import profile

    df = spark.createDataFrame([(float(i % 97), i) for i in range(500)], "a double, b int").coalesce(1)
    plain = [tuple(r) for r in lf.get_summary_table(df).collect()]
    assert [tuple(r) for r in lf.get_summary_table(df, quantiles="sorted").collect()] == plain
    monkeypatch.setattr(profile, "AUTO_BYTES", -1)
    assert [tuple(r) for r in lf.get_summary_table(df).collect()] == plain
    assert lf.compare_tables(df, df.withColumn("a", df.a + 1), ["b"]).numeric_summary[0]["median"] == 1.0
    assert lf.audit_transform(df, "a", lambda c: c * 2).median_after == 2 * lf.audit_transform(df, "a", lambda c: c * 2, quantiles="exact").median_before


def test_tables_of_many_values_stay_lazy(spark):
    df = spark.range(2000).selectExpr("id % 1500 as v", "id % 7 as w")
    with pytest.warns(UserWarning):
        t = lf.tab(df, "v")
    assert t.n_rows == 1500 and "and 1,000 more" in str(t) and "rows" not in t.__dict__
    rows = t.rows
    assert [r["position"] for r in rows] == list(range(1, 1501)) and rows[-1]["cum_percent"] == min(100.0, round(sum(r["percent"] for r in rows), 1))
    with pytest.warns(UserWarning):
        assert "more; see to_df()" in str(lf.tab(df, "v", "w"))
