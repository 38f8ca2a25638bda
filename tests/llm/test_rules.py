import itertools
import math
import re
import zlib
from collections import Counter

from ledgerframe.llm import quality, toxicity
from ledgerframe.llm.queries import QUERIES
from tests.llm.conftest import EDGE_TEXTS

SF = "/root/testdata/sf0.01"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    counts = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {i + k for i in range(len(words) - 2) if counts[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(marked)


def test_features_equal_brute_force(texts):
    odd = ["a b a b a b a", "x\x0bx\x0cx y\x1cz \x85 \xa0", "l1\nl1\n\nl1 \n#$%&|<>*", *(t for _, t in EDGE_TEXTS if t and len(t) < 1000)]
    for text in [*texts.values(), *odd]:
        assert quality.features(text)[:5] == brute(text)


def test_op5_judges_like_the_labels(spark):
    rows = {r.doc_id: r for r in QUERIES["op5_quality"](spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in rows.values():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    judged = [(rows[i].kept, q) for i, q in labels.items() if not rows[i].base_failed]
    assert sum(k == bool(q) for k, q in judged) / len(judged) > 0.98


def test_estimate_recovers_accuracies():
    # Three good rules and one that says nothing; a third of the documents is bad. (Two rules would not identify the model.)
    patterns = Counter()
    for good, share in ((True, 20_000), (False, 10_000)):
        for votes in itertools.product((1, -1), repeat=4):
            chance = math.prod(0.9 if (v == 1) == good else 0.1 for v in votes[:3])
            patterns[votes] += round(share * chance * 0.5)
    model = quality.estimate(dict(patterns), 4)
    assert abs(model.share - 2 / 3) < 0.02
    assert abs(model.good[0][2] - 0.9) < 0.02 and abs(model.bad[1][0] - 0.9) < 0.02
    assert abs(model.weight(3, 1)) < 0.05


def test_estimate_without_documents_is_the_prior():
    model = quality.estimate({}, 2)
    assert model.share == quality.PRIOR_SHARE
    assert math.isclose(model.good[0][2], quality.PRIOR_GOOD[2])


def test_quality_edges(edge, empty):
    rows = quality.judge(edge).collect()
    assert len(rows) == len(EDGE_TEXTS)
    assert not any(r.kept for r in rows)
    kept = quality.drop_bad(edge)
    assert kept.columns == edge.columns and kept.count() == 0
    assert quality.judge(empty).count() == quality.drop_bad(empty).count() == 0


def test_fold():
    assert toxicity.fold("1d10t, ІDІОT! st00pid 42 $cum") == " idiot idiot stoopid scum "
    assert toxicity.fold("") == "  "


def test_matcher_longest_entry_and_exception_phrases():
    m = toxicity.Matcher(toxicity.Lexicon((("tras", 2.0), ("trashcan", 0.0), ("trash can", 0.0), ("scum", 3.0))))
    assert m.measured("Trash talk")[0] == 2.0
    assert m.measured("the trashcan")[0] == 0.0
    assert m.measured("a trash can, scum")[0] == 3.0
    assert m.measured("extrascum")[0] == 0.0


def test_op7_on_the_held_out_rows(spark):
    rows = {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in rows.items())
    held = [(rows[i].score, y) for i, y in labels.items() if rows[i].held_out]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.8
    clean = [rows[i].predicted for i, y in labels.items() if not y]
    assert sum(clean) / len(clean) < 0.02


def brute_toxicity(lexicon, text):
    """Sum of weights by trying every entry at every word of the folded text, and the score."""
    plain, entries, total, covered = toxicity.fold(text), dict(lexicon.entries), 0.0, -1
    for at in (m.start() for m in re.finditer(" ", plain)):
        fits = [e for e in {plain[at + 1 : at + 1 + n] for n in {len(e) for e in entries}} if e in entries]
        if fits:
            longest = max(fits, key=len)
            total += entries[longest] if at + 1 > covered else 0.0
            if entries[longest] == 0:
                covered = max(covered, at + len(longest) + 1)
    a, b, c = lexicon.curve
    return 1 / (1 + math.exp(-(a + b * math.log1p(total) + c * total / math.sqrt(len(plain.split()) + toxicity.LENGTH_PRIOR))))


def test_op7_equals_brute_force_on_all_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert lexicon.entries
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = QUERIES["op7_toxicity"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert math.isclose(r.score, brute_toxicity(lexicon, texts[r.doc_id] or ""), rel_tol=1e-9, abs_tol=1e-12)


def test_every_exception_stays_in_the_lexicon(spark):
    # More entries than any bound of old, each with an exception of its own.
    toxic = [f"vile{a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrst"]
    rows = [(i, f"{toxic[i % len(toxic)]}x and some words", 1) for i in range(0, 40 * len(toxic), 2)] + [(i, f"{toxic[i % len(toxic)]}okay and some words", 0) for i in range(1, 40 * len(toxic), 2)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lexicon = dict(toxicity.learn(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")).entries)
    m = toxicity.Matcher(toxicity.Lexicon(tuple(lexicon.items())))
    assert all(m.measured(f"{w}okay")[0] == 0 for w in toxic[1::2])


def brute_votes(f):
    """What each rule says of the features, by plain conditions."""
    n, chars, symbols, dup_lines, repeated, lines, stops, plain = f
    said = lambda bad, good: -1 if bad else 1 if good else 0
    return (
        said(n < 50, n >= 100),
        said(chars < 3 * n or chars > 10 * n, 3.5 * n <= chars <= 8 * n),
        said(10 * symbols > n, 50 * symbols <= n),
        said(10 * dup_lines > 3 * lines, dup_lines == 0 and lines > 1),
        said(10 * repeated > 3 * n, 10 * repeated <= n and n > 2),
        said(50 * stops < n, 12 * stops >= n),
        said(10 * plain < 8 * n, 100 * plain >= 95 * n),
    )


def test_op5_posteriors_equal_brute_force_on_all_rows(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    votes = {i: brute_votes(quality.features(t or "")) for i, t in docs.items()}
    # Expectation-maximisation over documents, one by one, from the documented prior.
    share, tables = 0.8, {0: [(0.4, 0.2, 0.4)] * 7, 1: [(0.03, 0.12, 0.85)] * 7}

    def posterior(v):
        like = [math.prod(tables[c][k][x + 1] for k, x in enumerate(v)) for c in (0, 1)]
        return share * like[1] / (share * like[1] + (1 - share) * like[0])

    patterns = Counter(votes.values())
    for _ in range(200):
        q = {v: posterior(v) for v in patterns}
        sums = {c: [[20 * p for p in prior] for _ in range(7)] for c, prior in ((0, (0.4, 0.2, 0.4)), (1, (0.03, 0.12, 0.85)))}
        for v, n in patterns.items():
            for k, x in enumerate(v):
                sums[1][k][x + 1] += n * q[v]
                sums[0][k][x + 1] += n * (1 - q[v])
        share = (16 + sum(n * q[v] for v, n in patterns.items())) / (20 + len(docs))
        tables = {c: [tuple(x / sum(row) for x in row) for row in rows] for c, rows in sums.items()}
    for r in QUERIES["op5_quality"](spark, SF).collect():
        want = posterior(votes[r.doc_id])
        assert math.isclose(r.p_good, want, abs_tol=1e-6)
        assert r.kept == (not r.base_failed and want >= 0.5)


def test_labels_of_held_out_rows_are_never_learned(spark):
    rows = [(i, "poison words here" if zlib.crc32(str(i).encode()) % 5 == 0 else "plain words here") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("poison" in t)) for i, t in rows], "doc_id long, toxic int")
    assert toxicity.learn(docs, labels).entries == ()


def test_toxicity_edges(edge, empty):
    lexicon = toxicity.Lexicon((("scum", 3.0),))
    rows = toxicity.score_toxicity(edge, lexicon).collect()
    assert len(rows) == len(EDGE_TEXTS) and all(0 <= r.score < 0.5 for r in rows)
    assert toxicity.score_toxicity(empty, lexicon).count() == 0
