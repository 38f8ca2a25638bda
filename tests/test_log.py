"""Trails as logs: several writers, lost drivers, frames among the customs; and the graph of steps that a tap records."""

import json
import threading

import pytest
from pyspark.sql import functions as F

import ledgerframe as lf
from ledgerframe.operators.pipeline import pipeline_of
from ledgerframe.sources import log as logs
from ledgerframe.sources.serialize import FRAME_ROWS, trail_to_list
from ledgerframe.streaming.taps import stream_tap


@pytest.fixture(params=["disk", "hadoop"])
def store(request, monkeypatch, spark):
    """Both ways of putting files; the second is made to serve the local folder too."""
    if request.param == "hadoop":
        monkeypatch.setattr(logs, "_Disk", lambda path: logs._Hadoop("file://" + path, spark))
    return request.param


def test_a_file_is_put_once(spark, tmp_path, store):
    folder = logs.TrailLog(str(tmp_path / "l"), spark)._store
    assert folder.put("000000000001.json", "für") and not folder.put("000000000001.json", "other")
    assert folder.read("000000000001.json") == "für"
    assert [n for n in folder.names() if not n.startswith(".")] == ["000000000001.json"]


def test_taps_go_on_where_a_lost_driver_stopped(spark, tmp_path, store):
    path = str(tmp_path / "l")
    first = lf.open_trail(path, "kept", spark)
    df = lf.audit_tap(spark.range(10).toDF("v"), first, "raw")
    # Nothing was written but by the tap; a new driver opens the same folder.
    again = lf.open_trail(path, "other name", spark)
    assert again.name == "kept" and trail_to_list(again) == trail_to_list(first)
    with pytest.raises(ValueError, match="already has"):
        lf.audit_tap(df, again, "raw")
    lf.filter_tap(df, "v > 3", trail=again, label="large", quiet=True)
    assert [s.nrow for s in again.snapshots] == [10, 6] and again.snapshots[1].changes.row_delta == -4
    assert trail_to_list(lf.read_trail(path, "log", spark)) == trail_to_list(again)


def test_two_writers_lose_nothing(spark, tmp_path, store):
    path, made = str(tmp_path / "l"), lf.audit_trail("w")
    for k in range(8):
        lf.audit_tap(spark.range(k + 1).toDF("v"), made, f"s{k}", numeric_summary=False)
    opened = [logs.TrailLog(path, spark) for _ in range(4)]
    taken, errors, gate = [], [], threading.Barrier(4)

    def write(which):
        try:
            gate.wait()
            for s in made.snapshots[which * 2 : which * 2 + 2]:
                opened[which].commit(s)
            # All of them try this one.
            opened[which].commit(lf.Snapshot(**{**made.snapshots[0].__dict__, "label": "common"}))
        except logs.LabelTaken:
            taken.append(which)
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(4)]
    [t.start() for t in threads], [t.join() for t in threads]
    found = logs.TrailLog(path, spark).trail()
    assert not errors
    if store == "disk":
        # The local file system has no rename that is atomic against other writers; HDFS has.
        assert sorted(found.labels) == sorted([*made.labels, "common"]) and len(taken) == 3
    assert [s.index for s in found.snapshots] == list(range(1, len(found) + 1))
    assert all(s.changes.row_delta == s.nrow - b.nrow for b, s in zip(found.snapshots, found.snapshots[1:], strict=False))


def test_write_trail_appends_what_is_new(spark, tmp_path):
    path, trail = str(tmp_path / "t.log"), lf.audit_trail("t")
    lf.audit_tap(spark.range(3).toDF("v"), trail, "a")
    lf.write_trail(trail, path)
    lf.audit_tap(spark.range(2).toDF("v"), trail, "b")
    lf.write_trail(trail, path)
    assert trail_to_list(lf.read_trail(path)) == trail_to_list(trail)
    assert lf.read_trail(str(tmp_path / "empty.log")).labels == []


def test_frames_keep_their_rows(spark, tmp_path):
    trail = lf.audit_trail("f")
    lf.audit_tap(spark.range(3).toDF("v"), trail, "a", fns={"all": lambda df: df.orderBy("v"), "many": lambda df: spark.range(FRAME_ROWS + 5), "none": lambda df: df.limit(0), "n": lambda df: df.count()})
    custom = trail_to_list(trail)["snapshots"]["a"]["custom"]
    assert custom["all"] == {"columns": ["v"], "n_rows": 3, "rows": [[0], [1], [2]]}
    assert custom["many"] == {"columns": ["id"], "n_rows": FRAME_ROWS + 5, "rows": None}
    assert custom["none"] == {"columns": ["v"], "n_rows": 0, "rows": []} and custom["n"] == 3
    for kind in ("json", "trail"):
        lf.write_trail(trail, str(tmp_path / f"t.{kind}"))
        assert trail_to_list(lf.read_trail(str(tmp_path / f"t.{kind}"))) == trail_to_list(trail)
    lf.write_trail(trail, str(tmp_path / "t.log"))
    log = logs.TrailLog(str(tmp_path / "t.log"))
    kept = log.trail().snapshots[0].custom
    assert log.frame(kept["many"]).count() == FRAME_ROWS + 5 and log.frame(kept["none"]).columns == ["v"]
    assert json.loads(json.dumps(trail_to_list(trail)))["name"] == "f"


def test_a_stream_that_is_killed_has_each_batch_once(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "l")
    for k in range(4):
        spark.range(k * 5, k * 5 + 5 + k).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)

    def run(sink):
        # A new trail each time, as in a new driver.
        query = stream_tap(stream, lf.open_trail(path, "s", spark), sink=sink).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
        query.awaitTermination()

    def dies(df, number):
        # After the snapshot has been recorded and before the batch is done.
        if number == 2:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(dies)
    assert lf.open_trail(path, spark=spark).labels == ["batch_0", "batch_1", "batch_2"]
    seen = []
    run(lambda df, number: seen.append(number))
    trail = lf.open_trail(path, spark=spark)
    assert trail.labels == ["batch_0", "batch_1", "batch_2", "batch_3"] and seen == [2, 3]
    assert sum(s.nrow for s in trail.snapshots) == 5 + 6 + 7 + 8


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), spark.read.parquet("/root/testdata/sf0.001/customer.parquet")


def test_a_tap_after_a_join_shows_both_inputs(spark, tables):
    orders, customers = tables
    trail = lf.audit_trail("j")
    lf.left_join_tap(orders, customers.where("c_acctbal > 0"), {"o_custkey": "c_custkey"}, trail=trail, numeric_summary=False)
    steps = trail.snapshots[0].pipeline
    assert {"read orders", "read customer", "filter c_acctbal > 0", "left join on o_custkey <=> c_custkey"} <= set(steps)
    assert steps.index("read customer") < steps.index("filter c_acctbal > 0") < steps.index("left join on o_custkey <=> c_custkey")


def test_the_latest_steps_in_order(tables):
    orders, customers = tables
    one = orders.where("o_totalprice > 5").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t")).orderBy("t").limit(3)
    assert pipeline_of(one) == ["read orders", "filter o_totalprice > 5", "aggregate by o_custkey", "sort by t ASC NULLS FIRST", "limit 3"]
    assert pipeline_of(one, 2) == ["...", "sort by t ASC NULLS FIRST", "limit 3"]
    both = pipeline_of(orders.join(orders.where("o_custkey > 1").select("o_custkey").where("o_custkey < 9"), "o_custkey", "left_semi"), 9)
    assert both.count("read orders") == 1 and both[0] == "read orders" and any(s.startswith("semi join on") for s in both)
    assert pipeline_of(orders.toDF(*"abcdef")) == ["read orders"]
    wide = pipeline_of(orders.selectExpr(*[f"o_custkey + {i} AS a_rather_long_name_{i}" for i in range(50)]))
    assert len(wide[1]) == 120 and wide[1].endswith("…")


def test_deep_plans_are_not_walked_whole(tables):
    doubled = tables[0].select("o_custkey")
    for _ in range(12):
        doubled = doubled.union(doubled)
    assert pipeline_of(doubled)[-1] == "union"
