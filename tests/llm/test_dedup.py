import hashlib
import re
from collections import defaultdict

from ledgerframe.llm import bloom
from ledgerframe.llm import exact_dedup as op
from ledgerframe.llm.queries import QUERIES
from ledgerframe.llm.shared import checkpointed
from tests.llm.conftest import EDGE_TEXTS


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_query_equals_brute_force(spark, texts):
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[normal(t)].append(i)
    rows = QUERIES["op1_exact_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = groups[normal(texts[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept) == (min(own), len(own), r.doc_id == min(own))
        assert r.text_sha256 == hashlib.sha256(normal(texts[r.doc_id]).encode()).hexdigest()


def test_edges(edge):
    rows = op.exact_dedup(edge).collect()
    assert len(rows) == len(EDGE_TEXTS)
    groups = defaultdict(list)
    for i, t in EDGE_TEXTS:
        groups[hashlib.sha256(normal(t).encode()).hexdigest()].append(i)
    for r in rows:
        own = groups[r.text_sha256]
        assert r.group_size == len(own)
        assert r.keep_id == min((i for i in own if i is not None), default=None)
    kept = [r for r in rows if r.kept]
    assert len(kept) == len(groups)


def test_drop_repeats_keeps_columns_and_one_row_of_each_text(edge):
    out = op.drop_repeats(edge)
    assert out.columns == edge.columns
    rows = out.collect()
    assert len(rows) == len({normal(t) for _, t in EDGE_TEXTS})
    assert {r.doc_id for r in rows} == {1, 3, 5, 8, 9, 10}


def test_empty(empty):
    assert op.exact_dedup(empty).count() == 0
    assert op.drop_repeats(empty).count() == 0


def test_filter_has_no_false_negatives_when_it_is_far_too_small(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MAX_BITS", 1 << 15)
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('text ', id % 15000) AS text").repartition(3).checkpoint()
    rows = op.exact_dedup(docs)
    assert rows.where("kept").count() == 15_000
    assert rows.where("group_size = 2").count() == 10_000


def test_hot_group(spark):
    docs = spark.range(9_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id) END AS text").repartition(4).checkpoint()
    rows = op.exact_dedup(docs)
    assert rows.where("group_size = 3000").count() == 3_000
    assert rows.where("kept").count() == 6_001


def test_left_join_sparsely(spark):
    rows = spark.range(2_000).selectExpr("id AS k", "concat('v', id) AS v").coalesce(2)
    table = checkpointed(spark.createDataFrame([(5, "five"), (1999, "last"), (7_000, "absent")], "k long, w string"))
    out = {r.k: r.w for r in bloom.left_join_sparsely(rows, table, "k").collect()}
    assert len(out) == 2_000 and {k: w for k, w in out.items() if w} == {5: "five", 1999: "last"}
