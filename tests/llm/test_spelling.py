import random
import re
import zlib
from collections import Counter

import pytest

from ledgerframe.llm import spelling as op
from ledgerframe.llm.queries import QUERIES

COLUMNS = "word", "form", "root", "n", "n_near", "form_n"


def brute_words(rows, dropped=199):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if dropped and h % dropped == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 6
    return {w: n for w, n in counts.items() if n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute_variants(words):
    near = {w: [] for w in words}
    order = sorted(words)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.add((w, forms[w], root, words[w], len(near[w]), words.get(forms[w])))
    return out


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "word", 7) for i, t in rows], "doc_id long, text string, word string, `key` int").repartition(3)


def result(df):
    assert tuple(df.columns) == COLUMNS
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("crowd", [64, 2])
def test_words_of_made_texts_equal_brute_force(spark, monkeypatch, crowd):
    random.seed(5)
    letters = "abÀé÷z"
    stems = ["".join(random.choices(letters, k=random.randint(6, 12))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "bababab"]
    counted = Counter()
    for stem in stems:
        counted[stem] += random.choice([5, 30, 200])
        for _ in range(8):
            k = random.randrange(len(stem))
            made = random.choice([stem[:k] + stem[k + 1 :], stem[:k] + random.choice(letters) + stem[k:], stem[:k] + random.choice(letters) + stem[k + 1 :]])
            counted[made] += random.choice([1, 5, 9, 30])
    tokens = [w.upper() if random.random() < 0.1 and w.isascii() else w for w, n in counted.items() for _ in range(n)]
    random.shuffle(tokens)
    rows = [(i, " ".join(tokens[k : k + 50])) for i, k in enumerate(range(0, len(tokens), 50))]
    rows += [(None, "abcdef " * 9), (None, None), (1, ""), (1, ""), (77, "hugging" * 9000 + " "), *[(80 + k, "hugging" * 9000) for k in range(5)]]
    monkeypatch.setattr(op.near_pairs, "__defaults__", (crowd,))
    words = brute_words(rows)
    expected = brute_variants(words)
    assert len(expected) > 100 and any(f for _, f, *_ in expected)
    assert result(op.spelling_variants(docs_of(spark, rows))) == expected


def test_chains_of_forms_are_followed_to_their_end(spark):
    chain = {"abcdefgh" + "x" * k: 5 ** (5 - k) for k in range(5)}
    chain["abcdefghxxxx"] = 5
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(chain.items())]
    found = {r[0]: r for r in result(op.spelling_variants(docs_of(spark, rows), dropped=None))}
    assert found["abcdefghxxx"][1] == "abcdefghxx" and found["abcdefghxxx"][2] == "abcdefgh"
    assert {r[0]: (r[1], r[2]) for r in brute_variants(brute_words(rows, None))} == {w: r[1:3] for w, r in found.items()}


def test_a_form_is_five_times_as_frequent_and_ties_go_to_the_smallest(spark):
    rows = [(1, "planets " * 5 + "planetb " * 25 + "planeta " * 25 + "dragons " * 6 + "dragonz " * 29)]
    found = {r[0]: r for r in result(op.spelling_variants(docs_of(spark, rows), dropped=None))}
    assert found["planets"] == ("planets", "planeta", "planeta", 5, 2, 25)
    assert found["planeta"][1] is None and found["planeta"][4] == 2
    assert found["dragons"] == ("dragons", None, "dragons", 6, 1, None)


def test_crowded_keys_are_split_without_loss(spark):
    words = {f"qx{a}{b}{c}{d}zz": 5 for a in "abcdefg" for b in "abcdefg" for c in "abcd" for d in "abc"}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = {tuple(sorted((r.u, r.v))) for r in op.near_pairs(table, 10).collect()}
    order = sorted(words)
    assert pairs == {(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if one_edit(a, b)}


def test_empty_tables_and_texts_without_words(spark, empty):
    assert result(op.spelling_variants(empty)) == set()
    assert result(op.spelling_variants(docs_of(spark, [(1, None), (None, ""), (3, "a b c 1234567")]))) == set()


def test_query_equals_brute_force_on_the_whole_table(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert result(QUERIES["op13_spelling"](spark, "/root/testdata/sf0.001")) == brute_variants(brute_words(rows))
