import random
import re

import numpy as np
import xxhash

from ledgerframe.llm import simhash as op
from ledgerframe.llm.components import components
from ledgerframe.llm.queries import QUERIES
from ledgerframe.llm.shared import checkpointed
from tests.llm.conftest import EDGE_TEXTS


def brute_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    keys = sorted(prints)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_query_equals_brute_force(spark, texts):
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    roots = brute_components(prints)
    rows = QUERIES["op4_simhash"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", roots[i]) for i in texts}


def test_edges(edge):
    rows = op.simhash_groups(edge).collect()
    assert len(rows) == len(EDGE_TEXTS)
    by = {}
    for r in rows:
        by.setdefault(r.fingerprint, set()).add((r.doc_id, r.component_id))
    assert by["0" * 16] == {(3, 3), (4, 3), (5, 3), (6, 3), (None, 3)}
    same = f"{brute_fingerprint('alpha beta gamma delta'):016x}"
    assert by[same] == {(1, 1), (2, 1), (7, 1), (None, 1)}


def test_links_of_crowded_fingerprints_are_complete(spark):
    random.seed(5)
    base = random.getrandbits(63)
    values = {base}
    for _ in range(400):
        values.add(random.choice(sorted(values)) ^ (1 << random.randrange(63)) ^ (1 << random.randrange(63)))
    values |= {random.getrandbits(63) for _ in range(200)}
    values |= {-v for v in list(values)[:50]}
    found = components(op.links(spark.createDataFrame([(v,) for v in values], "fp long")))
    groups = {}
    for r in found.collect():
        groups.setdefault(r.root, set()).add(r.vertex)
    want = {}
    for k, root in brute_components({v: v & (1 << 64) - 1 for v in values}).items():
        want.setdefault(root, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(500)] + [(1000, 1001), (7, 7)], "u long, v long")
    roots = {r.vertex: r.root for r in components(edges).collect()}
    assert len({roots[i] for i in range(501)}) == 1
    assert roots[1000] == roots[1001] != roots[0]


def test_drop_near_copies(spark, empty):
    words = [f"w{i}" for i in range(400)]
    near = " ".join(words[:-1] + ["other"])
    docs = spark.createDataFrame([(5, " ".join(words)), (3, near), (9, "something else entirely here"), (None, "no id at all in this row"), (4, None)], "doc_id long, text string")
    close = (brute_fingerprint(" ".join(words)) ^ brute_fingerprint(near)).bit_count() <= 2
    kept = {r.doc_id for r in op.drop_near_copies(docs).collect()}
    assert kept == ({3, 9, None, 4} if close else {3, 5, 9, None, 4})
    assert op.drop_near_copies(empty).count() == op.simhash_groups(empty).count() == 0


def test_wide_links_equal_brute_force(spark):
    random.seed(11)
    values = {random.getrandbits(63) for _ in range(60)}
    for v in sorted(values):
        for bits in (1, 3, 5, 6, 7, 8, 12):
            values.add(v ^ sum(1 << b for b in random.sample(range(63), bits)))
    values |= {-v for v in list(values)[:50]}
    distinct = checkpointed(spark.createDataFrame([(v,) for v in sorted(values)], "fp long"))
    masks = sorted((v, v & (1 << 64) - 1) for v in values)
    for segments in (2, 3, 4):
        near = {(a, b) for i, (a, x) in enumerate(masks) for b, y in masks[i + 1 :] if (x ^ y).bit_count() <= op.radius_of(segments)}
        assert {tuple(r) for r in op.wide_links(distinct, segments).collect()} == near and near
        # With crowded keys no link is wrong, and some are left.
        few = {tuple(r) for r in op.wide_links(distinct, segments, 2).collect()}
        assert few <= near and few
    assert [op.segments_for(n) for n in (0, 16 << 16, (16 << 16) + 1, 16 << 21, (16 << 21) + 1)] == [4, 4, 3, 3, 2]


def test_fingerprint_of_a_set():
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b c", b"b c d", b"c d e")]
    assert op.fingerprint_of(np.array(hashes, np.uint64)) == op.fingerprint("a b c d e") == brute_fingerprint("a b c d e")
    assert op.fingerprint_of(np.zeros(0, np.uint64)) == 0
