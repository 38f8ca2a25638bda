import hashlib
import random
import re
import time

import pytest

from ledgerframe.llm import personal as op
from ledgerframe.llm.queries import QUERIES

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and brute_luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def brute_luhn(number):
    total = 0
    for k, d in enumerate(reversed(number)):
        total += int(d) if k % 2 == 0 else sum(map(int, str(2 * int(d))))
    return total % 10 == 0


def brute_base(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, pattern, good) in enumerate(BASE) for m in re.finditer(pattern, text or "") if good(m[0])]
    return sorted(found)


def as_text(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


DISGUISED = [
    ("mail john dot smith at example dot com today", "email", "john dot smith at example dot com", "john.smith@example.com"),
    ("jane (at) site [dot] co.uk", "email", "jane (at) site [dot] co.uk", "jane@site.co.uk"),
    ("Schreib an eva{at}firma{punkt}de!", "email", "eva{at}firma{punkt}de", "eva@firma.de"),
    ("ana arroba correo punto es", "email", "ana arroba correo punto es", "ana@correo.es"),
    ("bob @ mail.example.org!", "email", "bob @ mail.example.org", "bob@mail.example.org"),
    ("аdmin@exаmple.com", "email", "аdmin@exаmple.com", "admin@example.com"),
    ("a​b@ex­ample.com", "email", "a​b@ex­ample.com", "ab@example.com"),
    ("x＠y．net", "email", "x＠y．net", "x@y.net"),
    ("server one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one", "192.168.1.1"),
    ("at 192[.]168[.]1[.]10", "ip", "192[.]168[.]1[.]10", "192.168.1.10"),
    ("10.2O.3.l or 192.168.one.1", "ip", "192.168.one.1", "192.168.1.1"),
    ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１", "4111 1111 1111 1111"),
    ("4l11 1111 1111 1111.", "card", "4l11 1111 1111 1111", "4111 1111 1111 1111"),
    ("card four one one one, " + "one one one one, " * 2 + "one one one one", "card", "four one one one, " + "one one one one, " * 2 + "one one one one", "4" + "1" * 15),
    ("plus four four two zero seven nine four six zero nine five eight", "phone", "plus four four two zero seven nine four six zero nine five eight", "+442079460958"),
    ("+1‑(555)‑010‑0199 now", "phone", "+1‑(555)‑010‑0199", "+1-(555)-010-0199"),
    ("Ruf +49 drei null null double five sechs sieben 0", "phone", "+49 drei null null double five sechs sieben 0", "+49 3005567 0"),
]


@pytest.mark.parametrize("text, kind, source, value", DISGUISED)
def test_disguised_identifiers_are_found_where_they_stand(text, kind, source, value):
    plain, more = op.personal_spans(text)
    assert [(op.KINDS[k], text[s:e], v) for s, k, e, v in more] == [(kind, source, value)]
    assert source not in op.masked(text) and op.MASKS[op.KINDS.index(kind)] in op.masked(text)


@pytest.mark.parametrize("text", ["look at example.com today", "5 apples @ 3.50 each", "he said one two three", "meet at point five", "the best of at most ten", "un deux, six at one dot", "a. b. c (at) d", "dot at dot", "H₂O and x² — y", "version 1.2.3", "at 12:30 @ home"])
def test_clean_texts_are_left_alone(text):
    assert op.personal_spans(text) == ([], []) and op.masked(text) == text


def test_base_equals_the_patterns_on_random_texts():
    random.seed(11)
    parts = ["a@b.c", "1.2.3.4", "4111111111111111", "+1 (5) 55-01.00", "@", ".", "-", " ", "+", "1", "255", "256", "0000.1.2.3", "x", "é", "4111 1111-1111 1111", "a.b@@c.d", "\n", "%", "(9)", "a@b..c", "a@b.c@d.e", "漢"]
    for _ in range(3000):
        text = "".join(random.choices(parts, k=random.randint(0, 12)))
        assert [(s, k, e, op.KINDS[k]) for s, k, e in op.detect(text)] == brute_base(text), text


def test_alignments_map_back_every_span():
    random.seed(2)
    for _ in range(300):
        source = "".join(random.choices("abcdef", k=30))
        cuts = sorted(random.sample(range(31), 8))
        edits = [(a, b, random.choice(["", "X", "XY"])) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        made = op.Aligned.of(source, edits)
        text, at, origin = "", 0, []
        for a, b, new in [*edits, (30, 30, "")]:
            origin += [(k, k + 1) for k in range(at, a)] + [(a, b)] * len(new)
            text, at = text + source[at:a] + new, b
        assert made.text == text
        for _ in range(20):
            i = random.randrange(len(text))
            j = random.randrange(i + 1, len(text) + 1)
            assert made.back(i, j) == (origin[i][0], origin[j - 1][1])


@pytest.mark.parametrize("unit", ["1", "1.", "a", "a@", "a.", "@", "+1", "+", "(", "( ", " at ", " dot ", "one ", "one,", "one", "plus ", "[.]", "4l", "а", "1 ", "a@b", "-"])
def test_time_grows_with_the_text(unit):
    seconds = []
    for size in (100_000, 400_000):
        text = unit * (size // len(unit))
        began = time.perf_counter()
        op.personal_spans(text)
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 0.5 + 8 * seconds[0], seconds


def test_edges(spark, edge, empty):
    assert op.find_personal(empty).count() == 0 and op.mask_personal(empty).columns == empty.columns
    rows = op.personal_digests(op.find_personal(edge)).collect()
    assert len(rows) == edge.count()
    assert all((r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans, r.base_sha256) == (0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in rows)
    assert sorted(map(str, op.mask_personal(edge).collect())) == sorted(map(str, edge.collect()))
    docs = spark.createDataFrame([(None, "me@x.org and me (at) x.org", "s", 26), (2, None, None, None)], "doc_id long, text string, clean string, n_chars long")
    out = op.mask_personal(docs)
    assert out.columns == docs.columns and [tuple(r) for r in out.orderBy("doc_id").collect()] == [(None, "[EMAIL] and [EMAIL]", "s", 19), (2, None, None, None)]
    found = op.find_personal(docs).where("doc_id is null").first()
    assert [(f.kind, f.start, f.end, f.value, f.disguised) for f in found.found] == [("email", 0, 8, "me@x.org", False), ("email", 13, 26, "me@x.org", True)]


def test_query_equals_brute_force_on_the_whole_table(spark, texts):
    rows = QUERIES["op11_personal"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 5
    for r in rows:
        base = brute_base(texts[r.doc_id])
        counts = [sum(b[3] == kind for b in base) for kind in op.KINDS]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == hashlib.sha256(as_text(base).encode()).hexdigest()
        assert set(as_text(base).split(",")) <= set(r.spans.split(","))
        assert len(r.spans.split(",")) == max(1, len(base) + r.n_disguised)
