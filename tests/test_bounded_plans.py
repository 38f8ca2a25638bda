"""Plans whose tasks stay small: examples of large groups, the largest of many cells, and row numbers by file."""

import random

import pytest

import ledgerframe as lf
from ledgerframe.operators.compare import discrepancies_df, plan_comparison, row_indexed
from ledgerframe.operators.strings import case_variants_df
from ledgerframe.plans.rowids import file_numbered
from ledgerframe.plans.running import first_of_each


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_group_of_many_spellings(spark):
    letters = 15
    bits = ", ".join(f"if(shiftright(id, {k}) % 2 = 0, 'a', 'A')" for k in range(letters))
    df = spark.range(2**letters).selectExpr(f"concat({bits}) AS s").union(spark.createDataFrame([("x",), ("x",), ("Q",), ("q",), (None,), (" ",), ("",)], "s string"))
    found = {r.lower: (r.n_variants, r.examples) for r in case_variants_df(df, "s").collect()}
    least = sorted("".join(w) for w in (("A" * 15,), ("A" * 14 + "a",), ("A" * 13 + "aA",)))
    assert found == {"a" * 15: (2**15, ", ".join(least)), "q": (2, "Q, q")}
    assert plan_of(case_variants_df(df, "s")).count("WindowGroupLimit") >= 2


def test_no_values_have_no_variants(spark):
    assert case_variants_df(spark.createDataFrame([], "s string"), "s").count() == 0


@pytest.mark.parametrize("most", [1, 7, 100, 10_000])
@pytest.mark.parametrize("threshold", [0, 1000])
def test_first_of_each_group(spark, most, threshold):
    draw = random.Random(3)
    rows = [(draw.choice(["hot"] * 8 + ["b", "c", None]), draw.choice([None, 1.0, 2.0, 3.0]), k) for k in range(600)]
    df = spark.createDataFrame(rows, "g string, v double, k long").repartition(5)
    from pyspark.sql import functions as F

    before = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", threshold)
    try:
        got = sorted((tuple(r) for r in first_of_each(df, F.col("g"), [F.col("v").desc_nulls_last(), F.col("k")], most).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", before)
    want = []
    for g in {r[0] for r in rows}:
        want += sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))[:most]
    assert got == sorted(want, key=str)


def test_a_large_top_n_has_no_window_over_a_column(spark):
    x = spark.range(5000).selectExpr("id", "CAST(id AS double) AS v", "CAST(id AS string) AS s")
    y = spark.range(5000).selectExpr("id", "CAST(id + id % 101 AS double) AS v", "'z' AS s")
    p = plan_comparison(x, y, ["id"], top_n=2000)
    cells = discrepancies_df(p, True)
    assert "Window [row_number" not in plan_of(cells)
    got = [(r.id, r.abs_diff) for r in cells.collect()]
    want = sorted(((k, float(k % 101)) for k in range(5000) if k % 101), key=lambda c: (-c[1], c[0]))[:2000]
    assert sorted(got) == sorted(want)
    assert sorted(r.id for r in discrepancies_df(p, False).collect()) == list(range(2000))


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("numbered") / "t")
    spark.range(0, 3000, 1, 6).selectExpr("id", "CAST(id * 2 AS double) AS v").write.parquet(path)
    return path


def test_row_numbers_come_from_files_however_they_are_split(spark, files):
    found = []
    settings = {"spark.sql.files.maxPartitionBytes": ("134217728", "2000"), "spark.sql.leafNodeDefaultParallelism": ("1", "64")}
    for k in (0, 1):
        for key, values in settings.items():
            spark.conf.set(key, values[k])
        try:
            rows = row_indexed(spark.read.parquet(files), None)
            assert not rows.is_cached and "InMemoryTableScan" not in plan_of(rows)
            found.append([tuple(r) for r in rows.orderBy("row_index").collect()])
        finally:
            for key in settings:
                spark.conf.unset(key)
    assert found[0] == found[1] and [r[2] for r in found[0]] == list(range(1, 3001))
    assert [r[0] for r in found[0]] == list(range(3000))


def test_what_is_no_plain_read_is_numbered_otherwise(spark, files):
    table = spark.read.parquet(files)
    for other in (table.where("id > 5"), table.distinct(), table.union(table), table.limit(3), spark.range(3).toDF("id"), spark.read.parquet(files, files)):
        assert file_numbered(other, [f"c{i}" for i in range(len(other.columns))], "n") is None
    assert sorted(r.row_index for r in row_indexed(table.where("id >= 2990"), None).collect()) == list(range(1, 11))
    picked = row_indexed(table.selectExpr("v AS row", "id AS __path"), None, "n")
    assert picked.columns == ["row", "__path", "n"] and picked.where("n = __path + 1 AND row = 2 * __path").count() == 3000


def test_rows_of_files_are_compared_by_index(spark, files):
    x = spark.read.parquet(files).select("v")
    y = spark.read.parquet(files).selectExpr("v + if(id = 77, 5, 0) AS v")
    found = lf.compare_tables(x, y, key_cols=[])
    assert found.comparison_method == "row_index" and found.key_summary == {"matches": 3000, "only_x": 0, "only_y": 0}
    assert [tuple(r) for r in found.discrepancies.collect()] == [(78, "v", 154.0, 159.0, 5.0, 5.0 / 159.0)]
