import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as contract
import ledgerframe as lf
from ledgerframe.queries import ORACLES, QUERIES
from ledgerframe.streaming.taps import observed, stream_tap, windowed_counts

SF = "/root/testdata/sf0.001"


def test_stream_tap_records_each_batch_once(spark, tmp_path):
    source = tmp_path / "in"
    for k in range(2):
        spark.range(k * 5, k * 5 + 5).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(source))
    trail, seen = lf.audit_trail("s"), []
    query = stream_tap(stream, trail, sink=lambda df, n: seen.append(df.count())).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert sum(s.nrow for s in trail.snapshots) == sum(seen) == 10
    assert trail.labels[0] == "batch_0"


def test_windowed_counts(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("2024-01-01 00:00:10", "a"), ("2024-01-01 00:00:50", "a"), ("2024-01-01 00:01:10", "b")], "ts string, k string").write.parquet(source)
    stream = spark.readStream.schema("ts string, k string").parquet(source)
    query = windowed_counts(stream, "ts", "1 minute", "10 minutes", ["k"]).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.k, r.n) for r in spark.table("windows").collect()) == [("a", 2), ("b", 1)]


def test_observed(spark, tmp_path):
    df, observation = observed(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double"), "seen")
    df.write.parquet(str(tmp_path / "o"))
    assert observation.get == {"n_rows": 3, "na_v": 2}


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_queries_have_the_rows_of_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    assert sorted(got.columns) == sorted(d[0] for d in want.description)
    assert got.count() == len(want.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() == 4
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_the_rest_imports_without_the_training_data_subpackage(tmp_path):
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("ledgerframe.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "trail_df" in e.queries() and not any(n.startswith("op") for n in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=".")
