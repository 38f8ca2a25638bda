import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerframe.llm import quality
from tests.llm.test_rules import brute, brute_votes
from tests.llm.test_scans import brute_secrets
from tests.llm.test_similar import brute_kept


def brute_redact(text):
    spans = sorted((int(a), int(b)) for a, b in (s.split(":")[1:] for s in brute_secrets(text)[4].split(",") if s))
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_run_equals_stages_by_brute_force(spark, documents, texts, vocab):
    # The estimate itself is held against brute force in test_rules.
    model = quality.fit(documents)
    assert model.share > 0.5
    base = {i: brute(t) for i, t in texts.items()}
    kept = {i: t for i, t in texts.items() if base[i][0] >= 50 and 100 * base[i][4] <= 50 * base[i][0] and model.posterior(brute_votes(quality.features(t))) >= 0.5}
    assert 0 < len(kept) < len(texts)
    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i]), i)
    kept = {i: kept[i] for i in first.values()}
    kept = {i: brute_redact(kept[i]) for i in brute_kept(kept)}
    library = Tokenizer.from_file(vocab)
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in kept.items()}
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in rows} == set(ids)
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens, r.ids_crc32))
    for i, parts in pieces.items():
        at = 0
        for start, length, total, crc in sorted(parts):
            assert start == at and total == len(ids[i])
            assert crc == zlib.crc32(np.array(ids[i][start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids[i])
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.padded))
    assert sorted(sequences) == list(range(len(sequences)))
    for k, parts in sequences.items():
        at = 0
        for offset, length, padded in sorted(parts):
            assert offset == at
            at += length
        # Every sequence but the last is full; that one is padded unless its length is a power of two.
        assert at == 2048 if k + 1 < len(sequences) else padded == (at if at & (at - 1) == 0 else 2048)


def test_stages_keep_columns_and_survive_nothing(spark, edge, empty):
    for docs in (edge, empty):
        now = docs
        for label, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, "")
            if label != "packing":
                assert now.columns == docs.columns
        assert now.count() == 0


def test_stages_alone_on_edges(spark, edge, empty):
    for label, stage in corpus_pipeline.STAGES:
        assert stage(spark, edge, "").count() >= 0, label
        assert stage(spark, empty, "").count() == 0, label
