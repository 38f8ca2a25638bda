import random
import re
import string

import pytest
from pyspark.sql import functions as F

from ledgerframe.llm import secrets
from tests.llm.test_long_texts import seconds
from tests.llm.test_scans import CAMEL, MARKED


def test_mixed_case_tokens_without_digits(spark):
    random.seed(11)
    tokens = ["".join(random.choice(string.ascii_letters) for _ in range(24)) for _ in range(40)]
    names = ["InternationalBusinessMachines", "Geschwindigkeitsbegrenzung", "getUserAccountBalance", "internationalization", "WIDERSPRUCHSVERFAHREN"]
    docs = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(tokens + names)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secrets.find_secrets(docs).collect()}
    assert [spans[i] for i in range(len(tokens))] == ["entropy:4:28"] * len(tokens)
    assert all(spans[len(tokens) + i] == "" for i in range(len(names)))
    assert all("[SECRET]" in r.text for r in secrets.redact(docs.limit(40)).collect())


def test_words_are_told_as_by_patterns_with_repeated_groups(spark):
    random.seed(12)
    made = ["".join(random.choices("ABabz/_-9", weights=[3, 3, 5, 5, 4, 1, 1, 1, 1], k=random.randint(1, 9))) for _ in range(6000)] + ["", "A", "ab", "ABCde", "ABcd", "a/b-", "a/1", "x_12345", "a//b", "a/b\n"]
    rows = spark.createDataFrame([(v,) for v in made], "v string").select("v", secrets._marked_words(F.col("v")).alias("marked"), secrets._camel_case(F.col("v")).alias("camel")).collect()
    for r in rows:
        assert (r.marked, r.camel) == (bool(re.search(MARKED, r.v)), bool(re.search(CAMEL, r.v))), r.v
    assert sum(r.marked for r in rows) > 100 and sum(r.camel for r in rows) > 100


RUNS = ["Ab/", "Abc", "a_", "ABc", "0a", "deadBEEF01", "AKIA0Z", "password=", "token:a", "x=", "-", "aB3/+", "12345678-", "é1a"]


@pytest.mark.parametrize("work", [secrets.find_secrets, secrets.redact], ids=["find_secrets", "redact"])
def test_candidates_of_any_length(spark, work):
    """One string of 400,000 characters for each kind of run: no recursion, and time in proportion."""

    def taken(size):
        texts = [unit * (size // len(unit)) + end for unit in RUNS for end in ("1", "")]
        docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").repartition(4).persist()
        assert docs.count() == len(texts)
        out = seconds(lambda: work(docs).write.format("noop").mode("overwrite").save())
        docs.unpersist()
        return out

    taken(20_000)
    short, long = taken(100_000), taken(400_000)
    assert long < 4 * 2 * short + 2, (short, long)


def test_spans_of_long_candidates(spark):
    texts = [("Ab/" * 350_000 + "1", ""), ("Abc" * 350_000, ""), ("aB3/+x9Q" * 130_000, None), ("0a" * 500_000, None)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.spans for r in secrets.find_secrets(docs).collect()}
    assert found[0] == found[1] == ""
    assert found[2] == ""  # eight characters in turn have three bits
    assert found[3].startswith("hex:0:1000000")
