"""Doubling a long text may double the time: every operator that looks at places in a text."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerframe.llm import bpe, licenses, secrets


def seconds(work):
    best = float("inf")
    for _ in range(2):
        began = time.perf_counter()
        work()
        best = min(best, time.perf_counter() - began)
    return best


def test_bpe_of_one_long_word(vocab):
    random.seed(4)
    word = "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400_000))
    coder, library = bpe.SpeculativeBpe(vocab), Tokenizer.from_file(vocab)
    for text in (word[:3000], "ab" * 4000, "9" * 3000, "é漢" * 1500):
        assert coder.words([text.encode()])[0] == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert coder.decoded(coder.words([word.encode()])[0]) == word
    short, long = seconds(lambda: coder.words([word[:200_000].encode()])), seconds(lambda: coder.words([word.encode()]))
    assert long < 3 * short, (short, long)


def test_long_words_are_tokens_of_the_vectorised_way(vocab):
    random.seed(5)
    coder = bpe.SpeculativeBpe(vocab)
    words = ["".join(random.choice("etaoin shrdlu") for _ in range(n)).replace(" ", "").encode() for n in (3, 40, 500, 700, 900)]
    together = coder.words(words)
    for word, ids in zip(words, together, strict=True):
        assert b"".join(coder.bytes_of[i] for i in np.frombuffer(ids, "<u4")) == word
        assert np.array(coder._merge_long(word), "<u4").tobytes() == ids


@pytest.mark.parametrize("work", [lambda df: secrets.find_secrets(df), lambda df: secrets.redact(df), lambda df: licenses.scan_licenses(df)], ids=["find_secrets", "redact", "scan_licenses"])
def test_scans_of_many_matches(spark, work):
    random.seed(6)
    unit = "word password=hunter22x deadbeefdeadbeefdeadbeef under the MIT license é "

    def taken(n):
        docs = spark.createDataFrame([(1, unit * n, 0)], "doc_id long, text string, n_chars long").coalesce(1)
        docs = docs.persist()
        docs.count()
        out = seconds(lambda: work(docs).write.format("noop").mode("overwrite").save())
        docs.unpersist()
        return out

    taken(500)
    short, long = taken(3_000), taken(12_000)
    assert long < 4 * 2.2 * short + 1, (short, long)


def test_masked_text_of_many_spans_is_whole(spark):
    text = "".join(f"é{i} password=hunter22 {'x' * (i % 1500)}" for i in range(600)) + " end"
    row = secrets.redact(spark.createDataFrame([(1, text, 0)], "doc_id long, text string, n_chars long")).first()
    assert row.text == text.replace("password=hunter22", "[SECRET]") and row.n_chars == len(row.text)
