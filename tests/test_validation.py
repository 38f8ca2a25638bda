import pytest

import ledgerframe as lf


def ids(spark, values, name="id"):
    return spark.createDataFrame([(v,) for v in values], f"{name} int")


@pytest.mark.parametrize(
    ("x", "y", "relation"),
    [([1, 2, 3], [2, 3, 4], "one-to-one"), ([1, 2, 2, 3], [2, 3], "many-to-one"), ([1, 2], [2, 2], "one-to-many"), ([1, 1], [1, 1], "many-to-many"), ([1, 2, 3], [4, 5, 6], "no matches"), ([1, None], [None, None], "one-to-many"), ([], [], "no matches")],
)
def test_relations(spark, x, y, relation):
    assert lf.validate_join(ids(spark, x), ids(spark, y)).relation == relation


def test_counts_and_rates(spark):
    v = lf.validate_join(ids(spark, range(1, 11)), ids(spark, range(6, 16)), "id")
    assert (v.match_rate_x, v.match_rate_y, v.n_key_overlap, v.n_only_x, v.n_only_y, v.n_matched_pairs) == (50.0, 50.0, 5, 5, 5, 5.0)
    v = lf.validate_join(ids(spark, [1, 2, 3, 3]), ids(spark, [2, 3, 4]))
    assert (v.x_rows, v.y_rows, v.x_unique, v.y_unique, v.n_key_overlap, v.n_matched_pairs, v.n_only_x, v.n_only_y, v.relation) == (4, 3, 3, 3, 2, 3.0, 1, 1, "many-to-one")
    assert [tuple(r) for r in v.duplicates_x.collect()] == [(3, 2, 1)]
    assert [r.id for r in v.keys_only_in_x.collect()] == [1] and [r.id for r in v.keys_only_in_y.collect()] == [4]
    empty = lf.validate_join(ids(spark, []), ids(spark, [1]))
    assert empty.match_rate_x is None and empty.match_rate_y == 0.0


def test_no_cartesian_product(spark):
    v = lf.validate_join(ids(spark, [1] * 3000), ids(spark, [1] * 4000))
    assert v.n_matched_pairs == 12_000_000.0


def test_stats(spark):
    x = spark.createDataFrame([(i, i * 100.0) for i in range(1, 5)], "id int, revenue double")
    y = spark.createDataFrame([(i, (i - 1) * 10.0) for i in range(2, 6)], "id int, revenue double")
    v = lf.validate_join(x, y, "id", stat="revenue")
    assert (v.stat_x_total, v.stat_y_total, v.stat_x_matched, v.stat_x_only, v.stat_x_rate) == (1000.0, 100.0, 900.0, 100.0, 90.0)
    one = lf.validate_join(x, y, "id", stat_x="revenue")
    assert one.stat_x_total == 1000.0 and not hasattr(one, "stat_y_total")
    with pytest.raises(TypeError):
        lf.validate_join(x, y.withColumn("revenue", y.revenue.cast("string")), "id", stat="revenue")
    with pytest.raises(ValueError):
        lf.validate_join(x, y, "id", stat="nope")


def test_composite_keys_named_n(spark):
    x = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "N int, b string")
    y = spark.createDataFrame([(1, "x"), (2, "x")], "N int, b string")
    v = lf.validate_join(x, y, ["N", "b"])
    assert (v.n_key_overlap, v.n_only_x) == (2, 1)
    assert len(v.summary()) == 13 and "Relation" in str(v)
    with pytest.raises(ValueError):
        lf.validate_join(x, y, "zz")
    with pytest.raises(TypeError):
        lf.validate_join(x, [1])


def test_primary_keys(spark):
    df = spark.createDataFrame([(1, "A", 1.0), (2, "A", 2.0), (3, "B", 3.0), (4, "B", 4.0)], "id int, group string, d double")
    assert lf.validate_primary_keys(df, "id").is_primary_key
    bad = lf.validate_primary_keys(df, ["group"])
    assert (bad.is_primary_key, bad.n_unique_keys, bad.n_duplicate_keys) == (False, 2, 2)
    assert sorted(tuple(r) for r in bad.duplicate_keys.collect()) == [("A", 2), ("B", 2)]
    with pytest.warns(UserWarning, match="floating-point"):
        lf.validate_primary_keys(df, ["d"])
    hole = lf.validate_primary_keys(ids(spark, [1, None, 3]), "id")
    assert not hole.is_primary_key and hole.has_missing_key
    assert lf.validate_primary_keys(ids(spark, []), "id").is_primary_key
    assert "Primary key" in str(bad)
    for keys in ([], ["zz"]):
        with pytest.raises(ValueError):
            lf.validate_primary_keys(df, keys)


@pytest.mark.parametrize(
    ("pairs", "relation"),
    [([("a", 1), ("b", 2)], "one-to-one"), ([("a", 1), ("a", 2)], "one-to-many"), ([("a", 1), ("b", 1)], "many-to-one"), ([("a", 1), ("a", 2), ("b", 1)], "many-to-many"), ([("a", 1), ("a", None)], "one-to-many")],
)
def test_var_relationship(spark, pairs, relation):
    df = spark.createDataFrame(pairs, "a string, b int")
    v = lf.validate_var_relationship(df, "a", "b")
    assert v.relation == relation and relation in str(v)


def test_var_relationship_rejects_doubles(spark):
    with pytest.raises(TypeError):
        lf.validate_var_relationship(spark.createDataFrame([(1.0, 1)], "a double, b int"), "a", "b")
