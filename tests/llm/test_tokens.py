import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerframe.llm import bpe, packing
from ledgerframe.llm.queries import QUERIES
from tests.llm.conftest import EDGE_TEXTS

PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "é", "é", "1", "²", "Ⅷ", "<|endoftext|>", "<|", "!!", "\xa0", "　", "漢", "😀", "\x1c", "\x85", "the", " the", "\r\n", "don't", "a" * 25, "-" * 12, "ing", "tion", "́", "՘", "࢏"]


@pytest.fixture(scope="module")
def library(vocab):
    return Tokenizer.from_file(vocab)


def ids_of(library, texts):
    return [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def mixed():
    random.seed(3)
    return ["".join(random.choice(PARTS) for _ in range(random.randint(0, 30))) for _ in range(3_000)] + ["a" * 5_000, " " * 3_000, "", "x\n"]


def test_speculative_encoding_equals_the_library(vocab, library, mixed):
    found = [ids for part in bpe.speculative_encoder(vocab).encode(mixed) for ids in part]
    assert found == ids_of(library, mixed)


def test_small_caches_change_nothing(vocab, library, mixed):
    coder = bpe.vocabulary(vocab)
    small = bpe.UnitEncoder(vocab, lambda new: coder.words([w.encode() for w in new]), coder.special, entries=50)
    assert [ids for part in small.encode(mixed[:500]) for ids in part] == ids_of(library, mixed[:500])


def test_speculation_fails_only_where_greedy_is_wrong(vocab):
    coder = bpe.SpeculativeBpe(vocab)
    words = [w.encode() for w in ("the", " thontionhe", " erheouble", " antidisestablishmentarianism", "éèê")]
    coder.words(words)
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    greedy, place = coder._propose(data, start, end)
    exact, counts = coder._merge(data, start, end)
    owner = np.searchsorted(end, place, side="right")
    wrong = sum(greedy[owner == k].tolist() != part.tolist() for k, part in enumerate(np.split(exact, np.cumsum(counts)[:-1])))
    assert coder.failed == wrong > 0


def test_decoding_equals_the_library(vocab, library):
    random.seed(4)
    coder = bpe.vocabulary(vocab)
    for _ in range(300):
        ids = [random.randrange(50257) for _ in range(10)]
        assert coder.decoded(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_op2(spark, texts, library):
    for r in QUERIES["op2_bpe"](spark, "/root/testdata/sf0.001").collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_keeps_columns_and_decodes_back(edge, vocab):
    out = bpe.bpe_decode(bpe.bpe_encode(edge, vocab), vocab)
    assert out.columns == [*edge.columns, "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == len(EDGE_TEXTS)
    assert all(r.decoded == (r.text or "") for r in rows)


def test_pack_edges(edge, vocab, library):
    rows = packing.pack(edge, vocab, sequence=64).collect()
    total = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in EDGE_TEXTS)
    assert sum(r.length for r in rows) == total
    _gapless(rows, 64)


def _gapless(rows, sequence):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length, r.padded))
    assert sorted(by) == list(range(len(by)))
    for k, parts in by.items():
        at = 0
        for offset, length, padded in sorted(parts):
            assert offset == at
            at += length
        assert at == sequence or k == len(by) - 1
        assert padded == (at if at & (at - 1) == 0 else sequence)


def test_offsets_by_shuffle(edge, vocab, monkeypatch):
    rows = sorted(map(str, packing.pack(edge, vocab, sequence=64).collect()))
    monkeypatch.setattr(packing, "BROADCAST_PARTITIONS", 0)
    assert sorted(map(str, packing.pack(edge, vocab, sequence=64).collect())) == rows


def test_op3(spark, texts, library):
    rows = QUERIES["op3_packing"](spark, "/root/testdata/sf0.001").collect()
    _gapless(rows, 2048)
    seen = {}
    for r in rows:
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}


def test_prefix_sums_over_bands(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 3)
    totals = spark.createDataFrame([(k, k * 10) for k in range(11)], "part int, total long")
    assert {r.part: r.base for r in packing.partition_offsets(totals).collect()} == {k: sum(range(0, k * 10, 10)) for k in range(11)}


def test_empty(empty, vocab):
    assert bpe.bpe_encode(empty, vocab).count() == 0
    assert packing.pack(empty, vocab).count() == 0
