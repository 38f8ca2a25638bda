import random
import re

import corpus_pipeline
from ledgerframe.llm import similar as op
from ledgerframe.llm import simhash
from ledgerframe.llm.components import components, extended
from ledgerframe.llm.shared import checkpointed, shared_root


def brute_similar(texts):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() if (w := t.split())}
    return {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4}


def brute_kept(texts):
    """Ids of the texts that stay: the least of each group of equal words or of five-word Jaccard similarity of 0.8 or more."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])) and (words[i] == words[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in texts if find(i) == i}


def test_near_stage_drops_copies_that_differ_by_some_words(spark):
    random.seed(3)
    base = [f"w{random.randrange(5000)}" for _ in range(300)]
    texts = {1: " ".join(base)}
    for i in range(2, 12):
        changed = list(base)
        for at in random.sample(range(300), i):
            changed[at] = f"x{i}"
        texts[i] = " ".join(changed)
    texts |= {i: " ".join(f"y{random.randrange(5000)}" for _ in range(200)) for i in range(20, 24)}
    pairs = brute_similar(texts)
    assert len(pairs) > 5
    root = {i: i for i in texts}
    for _ in texts:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert kept == {i for i in texts if root[i] == i}


def test_similarity_is_exact_at_four_fifths(spark):
    sets = spark.createDataFrame([(1, list(range(8))), (2, [*range(8), 90, 91]), (3, [*range(100, 108)]), (4, [*range(100, 107), 90, 91])], "vertex long, hashes array<long>")
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "u long, v long")
    assert [tuple(r) for r in op._verified(pairs, sets).collect()] == [(1, 2)]


def test_join_of_crowds_equals_brute_force(spark):
    random.seed(8)
    texts, word = {}, iter(range(10**6))
    passage = [f"p{k}" for k in range(150)]
    for base in range(4):
        own = [f"b{base}w{k}" for k in range(160)]
        for _ in range(60):
            copy = list(own)
            for at in random.sample(range(160), random.choice([0, 1, 2, 3, 4, 6, 9])):
                copy[at] = f"n{next(word)}"
            texts[len(texts)] = " ".join(copy[: random.choice([130, 150, 160])])
    # A passage that many share, with more or less of their own beside it.
    for _ in range(120):
        texts[len(texts)] = " ".join([*passage, *(f"n{next(word)}" for _ in range(random.choice([5, 10, 20, 30, 60, 200])))])
    for _ in range(100):
        texts[len(texts)] = " ".join(f"n{next(word)}" for _ in range(60))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    docs.write.mode("overwrite").parquet(f"{shared_root(spark)}/crowds")
    out = op.drop_similar(spark.read.parquet(f"{shared_root(spark)}/crowds"))
    assert {r.doc_id for r in out.collect()} == brute_kept(texts)


def test_stage_equals_brute_force_on_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in op.drop_similar(docs).collect()} == brute_kept(texts)


def test_rows_without_words_or_ids(spark, edge, empty):
    kept = [r.doc_id for r in op.drop_similar(edge).collect()]
    assert sorted(i for i in kept if i is not None) == [1, 3, 8, 9, 10] and kept.count(None) == 2
    assert op.drop_similar(empty).count() == 0


def test_hamming_balls_find_near_copies_without_suspects(spark, monkeypatch):
    words = [f"w{k}" for k in range(400)]
    texts = {1: words, 2: [*words[:-1], "x"], 3: ["y", *words[1:]], 4: [f"v{k}" for k in range(400)], 5: words[:200]}
    prints = {i: simhash.fingerprint_of(op.shingles(" ".join(w))) for i, w in texts.items()}
    assert all(0 < (prints[1] ^ prints[i]).bit_count() <= simhash.radius_of(4) for i in (2, 3))
    monkeypatch.setattr(op, "_suspects", lambda distinct: distinct.select("vertex", "rid").limit(0))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()} == {1, 4, 5}


def test_pairs_of_equal_or_near_fingerprints_are_verified(spark):
    vertices = checkpointed(spark.createDataFrame([(1, 0), (2, 0), (3, 7), (4, 1 << 20 | 1 << 40), (5, -1)], "vertex long, fp long"))
    assert {tuple(sorted(r)) for r in op._fetched(vertices).collect()} == {(1, 2), (1, 3), (1, 4), (3, 4)}
    # Of these, 1 and 2 have nothing in common, and 1 and 3 all; 6 is like 4 but in no pair of fingerprints.
    sets = [(1, list(range(9))), (2, list(range(20, 29))), (3, list(range(9))), (4, list(range(40, 49))), (6, list(range(40, 50)))]
    sets = checkpointed(spark.createDataFrame(sets, "vertex long, hashes array<long>"))
    roots = {r.vertex: r.root for r in op.near_roots(sets, op._fetched(vertices.where("vertex < 5"))).collect()}
    assert roots[1] == roots[3] != roots[4] == roots[6] and roots.get(2, 2) not in (roots[1], roots[4])


def jobs_of(spark, work):
    """What work() returns, and how many jobs Spark ran for it."""
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("none", "")


def test_near_stage_runs_few_jobs(spark):
    # The driver's garbage and threads follow their number: it was 200 on these documents.
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept, jobs = jobs_of(spark, lambda: op.drop_similar(docs).count())
    assert 0 < kept < docs.count() and jobs < 180


def test_pairs_of_a_set_in_many_are_dealt_to_copies(spark, monkeypatch):
    monkeypatch.setattr(op, "COPY", 3)
    held = {0: range(20)} | {i: range(i % 5, 20 + i % 3) for i in range(1, 30)} | {30: range(50)}
    sets = checkpointed(spark.createDataFrame([(i, list(s)) for i, s in held.items()], "vertex long, hashes array<long>"))
    met = [(0, i) for i in range(1, 31)] + [(i, 30) for i in range(1, 9)] + [(3, 4), (4, 5)]
    pairs = spark.createDataFrame(met, "u long, v long")
    alike = {(i, j) for i, j in met if 5 * len(set(held[i]) & set(held[j])) >= 4 * len(set(held[i]) | set(held[j]))}
    assert 0 < len(alike) < len(met)
    assert sorted(tuple(r) for r in op._verified(pairs, sets).collect()) == sorted(alike)


def test_further_edges_extend_components(spark):
    random.seed(12)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(260)]
    frame = lambda some: spark.createDataFrame(some, "u long, v long")
    whole = {r.vertex: r.root for r in components(frame(edges)).collect()}
    for cut in (0, 130, 260):
        rows = extended(checkpointed(components(frame(edges[:cut]))), frame(edges[cut:])).collect()
        found = {r.vertex: r.root for r in rows}
        assert len(rows) == len(found) and found.keys() == whole.keys()
        assert len(set(found.values())) == len(set(whole.values())) == len({(found[v], whole[v]) for v in whole})
