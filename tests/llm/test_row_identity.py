"""Passes over the same files, split into tasks in different ways, know the same rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerframe.llm import chat, exact_dedup, shared, similar, warc

DEALT = "spark.sql.leafNodeDefaultParallelism"


@pytest.fixture
def fewer_later(spark, monkeypatch):
    """Splits the files for six cores in the first pass, and for one in all later ones."""
    kept = shared.written
    spark.conf.set(DEALT, "6")

    def write(df, label):
        out = kept(df, label)
        spark.conf.set(DEALT, "1")
        return out

    for module in (exact_dedup, similar, warc, chat, shared):
        monkeypatch.setattr(module, "written", write)
    yield
    spark.conf.unset(DEALT)


def saved(spark, tmp_path, rows, schema):
    path = str(tmp_path / "rows.parquet")
    spark.createDataFrame(rows, schema).repartition(6).write.parquet(path)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    return spark.read.parquet(path)


def test_rows_of_files_keep_their_names_when_split_in_other_ways(spark, tmp_path):
    docs = saved(spark, tmp_path, [(i, f"t{i}") for i in range(1000)], "doc_id long, text string")
    seen = []
    for cores in ("6", "1"):
        spark.conf.set(DEALT, cores)
        rows = shared.identified(docs, "x")
        assert rows.columns == ["c0", "c1", "rid"]
        seen.append((rows.rdd.getNumPartitions(), {(r.c0, r.rid) for r in rows.collect()}))
    spark.conf.unset(DEALT)
    assert seen[0][1] == seen[1][1] and len({rid for _, rid in seen[0][1]}) == 1000
    assert seen[0][0] > seen[1][0]


def test_rows_of_other_plans_are_numbered_once(spark, tmp_path):
    docs = saved(spark, tmp_path, [(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    path = docs.inputFiles()[0]
    frames = [
        docs.select("doc_id", F.explode(F.array("text", "text")).alias("text")),
        docs.union(docs),
        docs.join(docs.withColumnRenamed("text", "other"), "doc_id"),
        docs.where(F.rand(3) < 2),
        spark.read.parquet(path, path),
        docs.sample(True, 2.0, 3),
        spark.createDataFrame([(1, "a"), (1, "a")], "_metadata long, rid string"),
    ]
    for frame in frames:
        rows = shared.identified(frame, "x")
        ids = [r.rid for r in rows.collect()]
        assert len(ids) == len(set(ids)) == rows.count() > 1
        assert set(ids) == {r.rid for r in rows.collect()}


def test_exact_dedup_takes_the_same_rows_in_both_passes(spark, tmp_path, fewer_later):
    rows = [(i, f"text number {i % 900}") for i in range(1000)]
    kept = exact_dedup.drop_repeats(saved(spark, tmp_path, rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == list(range(900))


def test_near_dedup_takes_the_same_rows_in_both_passes(spark, tmp_path, fewer_later):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(i, words(i % 200) + (" tail" if i >= 200 else "")) for i in range(230)]
    kept = similar.drop_similar(saved(spark, tmp_path, rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == list(range(200))


def test_archives_keep_every_payload(spark, tmp_path, fewer_later):
    rows = [(i, f"http://x/{i}", f"<p>{i % 250}</p>") for i in range(300)]
    warc.write_archives(saved(spark, tmp_path, rows, "page_id long, url string, html string"), str(tmp_path / "warc"))
    records = warc.read_archives(spark, str(tmp_path / "warc")).collect()
    assert len(records) == 300
    assert {bytes(r.payload).decode() for r in records if r.record_type == "response"} == {f"<p>{k}</p>" for k in range(250)}
    assert Counter(r.record_type for r in records) == {"response": 250, "revisit": 50}
    assert {(int(r.record_id), int(r.refers_to)) for r in records if r.record_type == "revisit"} == {(k, k + 250) for k in range(50)}


def test_replies_are_those_of_the_messages_that_quote(spark, tmp_path, fewer_later):
    rows = [(k % 40, k // 40, "user", f"message {k}" if k < 200 else f"> message {k - 200}\nanswer {k}") for k in range(400)]
    out = chat.link_replies(saved(spark, tmp_path, rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(out) == 400
    for r in out:
        k = r.conv_id + 40 * r.turn
        assert (r.text, r.reply_to) == ((f"message {k}", None) if k < 200 else (f"answer {k}", (k - 200) // 40))
