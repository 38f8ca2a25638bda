import pytest
from pyspark.sql import functions as F

from ledgerframe.llm import bloom
from ledgerframe.llm.exact_dedup import drop_repeats, exact_dedup


@pytest.mark.parametrize("most", [1 << 28, 1 << 17], ids=["broadcast", "too large to be broadcast"])
def test_few_unique_rows_are_suspected_however_many_there_are(spark, monkeypatch, most):
    # The bound scaled down some two-thousandfold: 100,000 rows stand for 0.2 billion.
    monkeypatch.setattr(bloom, "MAX_BITS", most)
    rows = spark.range(100_000).select(F.when(F.col("id") % 100 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), "id")
    found = bloom.bloom(rows, F.col("k"), 100_000, least=2)
    assert found.broadcast == (most > 1 << 20)
    out = bloom.probed(rows, F.col("k"), found, "suspect")
    assert out.columns == ["k", "id", "suspect"] and out.count() == 100_000
    assert out.where("k = 0 and not suspect").count() == 0
    assert out.where("k > 0 and suspect").count() < 0.05 * 99_000


@pytest.mark.parametrize("most", [1 << 28, 1 << 15, 8])
def test_sparse_joins_are_left_joins(spark, monkeypatch, most):
    monkeypatch.setattr(bloom, "MAX_BITS", most)
    rows = spark.range(5000).withColumn("k", F.col("id") % 1000)
    table = spark.createDataFrame([(i, i * 2) for i in range(0, 1000, 7)], "k long, v long")
    out = {(r.id, r.v) for r in bloom.left_join_sparsely(rows, table, "k").select("id", "v").collect()}
    assert out == {(i, (i % 1000) * 2 if (i % 1000) % 7 == 0 else None) for i in range(5000)}


def test_dedup_beyond_the_broadcast_bound(spark, documents, monkeypatch):
    want = sorted(map(tuple, exact_dedup(documents).collect()))
    kept = sorted(r.doc_id for r in drop_repeats(documents).collect())
    monkeypatch.setattr(bloom, "MAX_BITS", 1)
    assert sorted(map(tuple, exact_dedup(documents).collect())) == want
    assert sorted(r.doc_id for r in drop_repeats(documents).collect()) == kept
