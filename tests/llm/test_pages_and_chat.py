import base64
import gzip
import hashlib
import io
import random

import pytest

from ledgerframe.llm import chat, warc
from ledgerframe.llm.queries import QUERIES
from ledgerframe.llm.shared import shared_path

PAGES = "page_id long, url string, html string, refers_to string"


def test_archive_of_edges(spark):
    rows = [(1, "http://a\r\nX: y", "<p>é漢</p>"), (2, None, None), (3, "u", ""), (5, "u", "<p>é漢</p>"), (4, "u", "<p>é漢</p>"), (6, "u", "one\r\n\r\nWARC/1.1\r\n\r\nmore"), (6, "u", "one\r\n\r\nWARC/1.1\r\n\r\nmore"), (None, "u", "<p>é漢</p>"), (7, "u", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], PAGES).coalesce(1)
    path = shared_path(spark, "test-warc")
    warc.write_archives(pages, path, files=((100, 4), (1 << 20, 1), (None, 1)))
    back = warc.read_archives(spark, path).collect()
    assert len(back) == len(rows)
    by = {}
    for r in back:
        by.setdefault(r.record_id, []).append(r)
    for i, _, html in rows:
        payload = (html or "").encode()
        for r in by[str(i) if i is not None else ""]:
            assert r.payload_bytes == len(payload)
            assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
            assert bytes(r.payload) == (payload if r.record_type == "response" else b"")
    kinds = {i: sorted((r.record_type, r.refers_to) for r in rs) for i, rs in by.items()}
    assert kinds["5"] == [("response", None)] and kinds["1"] == kinds["4"] == kinds[""] == [("revisit", "5")]
    assert kinds["3"] == [("response", None)] and kinds["2"] == [("revisit", "3")]
    assert sorted(k for k, _ in kinds["6"]) == ["response", "revisit"]
    assert kinds["7"] == [("response", None)]


def test_small_payloads_below_the_bound_are_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab", ""), (2, "u", "ab", "")], PAGES).coalesce(1)
    path = shared_path(spark, "test-warc")
    warc.write_archives(pages, path, min_bytes=3)
    assert {r.record_type for r in warc.read_archives(spark, path).collect()} == {"response"}


def test_empty_and_damaged_archives(spark):
    path = shared_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([], PAGES), path)
    assert warc.read_archives(spark, path).count() == 0
    with pytest.raises(ValueError):
        list(warc.parse_archive(io.BytesIO(b"nothing\r\n\r\n")))


def test_archives_are_plain_warc(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([(1, "http://a/", "hi", "")], PAGES).coalesce(1), str(tmp_path / "w"))
    data = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("*.gz"))
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"hi\r\n\r\n")


def test_op9_query(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    last = {}
    for p in pages:
        last[p.html] = max(p.page_id, last.get(p.html, p.page_id))
    rows = {r.page_id: r for r in QUERIES["op9_warc"](spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == len(pages)
    for p in pages:
        r, own = rows[p.page_id], last[p.html] == p.page_id
        assert (r.payload_bytes, r.record_type, r.refers_to) == (len(p.html.encode()), "response" if own else "revisit", None if own else last[p.html])


TALK = [
    (1, 0, "user", "Hello there my friend\nsecond line"),
    (1, 1, "assistant", "How are you?\n\nI am fine."),
    (1, 2, "user", "On Monday Bob wrote:\n> > hello  there MY friend\n> > second line\n> I am fine.\nGood to hear"),
    (1, 3, "user", "> How are you?\nokay"),
    (1, 4, "user", "> never said\nwhat"),
    (1, 5, None, None),
    (2, 0, "user", "> I am fine.\nother conversation"),
    (None, 0, "user", "x y"),
    (None, 1, "user", ">x  y\nz"),
    (3, None, "user", "> x"),
    (1, 3, "user", "> How are you?\nokay"),
]


def test_quotations():
    clean, quotes = chat.quotations("a\n> b\n>> c\n>> d\n> \n> e\nf")
    assert clean == "a\nf"
    assert [level for level, _ in quotes] == [1, 2, 1]
    assert chat.quotations("plain > text\n x")[1] == []
    assert chat.quotations("")[0] == ""
    assert len(chat.passages("One. Two!\nthree\n\nfour")) == 8


def test_links(spark):
    rows = chat.link_replies(spark.createDataFrame([(*t, 1) for t in TALK], "conv_id long, turn int, role string, text string, reply_to int").coalesce(1)).collect()
    assert len(rows) == len(TALK)
    found = {(r.conv_id, r.turn): (r.text, r.reply_to, r.n_quotes, r.n_linked, r.deepest, r.path) for r in rows}
    assert found[1, 2] == ("Good to hear", 1, 2, 2, 2, [1, 2])
    assert found[1, 3] == ("okay", 1, 1, 1, 1, [1, 3])
    assert found[1, 4] == ("what", None, 1, 0, 1, [4])
    assert found[1, 5] == ("", None, 0, 0, 0, [5])
    assert found[2, 0][1] is None and found[None, 1][1] == 0 and found[3, None][1] is None
    assert sum((r.conv_id, r.turn) == (1, 3) for r in rows) == 2


def test_reply_order(spark):
    rows = chat.ordered_conversations(spark.createDataFrame(TALK[:5], "conv_id long, turn int, role string, text string").coalesce(1)).collect()
    assert [r.turn for r in rows] == [0, 1, 2, 3, 4]
    late = [*TALK[:2], (1, 2, "user", "new topic"), (1, 3, "user", "> How are you?\nlate answer")]
    rows = chat.ordered_conversations(spark.createDataFrame(late, "conv_id long, turn int, role string, text string").coalesce(1)).collect()
    assert [r.turn for r in rows] == [0, 1, 3, 2]


def test_op6_keeps_every_message_and_its_text_without_quotes(spark):
    source = {(r.conv_id, r.turn): r.text for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()}
    rows = QUERIES["op6_chat"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(source)
    assert all(r.text == source[r.conv_id, r.turn] for r in rows if not r.n_quotes)


def test_empty_talk(spark):
    assert chat.ordered_conversations(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_quotes_of_some_lines_of_a_paragraph(spark):
    talk = [
        (1, 0, "user", "one a\nsomething else"),
        (1, 1, "assistant", "one a\ntwo b\nthree c\nfour d"),
        (1, 2, "user", "a new topic"),
        (1, 3, "user", "> one a\n> two b\nfirst lines"),
        (1, 4, "user", "> two b\n> three c\n> four d\nlast lines"),
        (1, 5, "user", "> one a\n> three c\nlines apart"),
        (1, 6, "user", "> one a\n> never said\nin part"),
    ]
    rows = chat.ordered_conversations(spark.createDataFrame(talk, "conv_id long, turn int, role string, text string").coalesce(1)).collect()
    assert {r.turn: (r.reply_to, r.n_quotes, r.n_linked) for r in rows if r.turn > 2} == {3: (1, 1, 1), 4: (1, 1, 1), 5: (1, 1, 1), 6: (None, 1, 0)}
    assert [r.turn for r in rows] == [0, 1, 3, 4, 5, 2, 6]


CHAT = "conv_id long, turn int, role string, text string"


def test_whole_reply_trees(spark):
    talk = [(1, 0, "user", "first"), (1, 1, "user", "new topic"), (1, 2, "user", "> first\nreply one"), (1, 3, "user", "> reply one\nreply two"), (1, 4, "user", "> first\nlate"), (1, 5, "user", "> reply two\ndeep")]
    rows = chat.ordered_conversations(spark.createDataFrame(talk, CHAT).coalesce(1)).collect()
    assert [r.turn for r in rows] == [0, 2, 3, 5, 4, 1]


def test_a_long_thread(spark):
    talk = [(7, 0, "user", "say 0"), *((7, i, "user", f"> say {i - 1}\nsay {i}") for i in range(1, 70)), (7, 70, "user", "other")]
    rows = chat.ordered_conversations(spark.createDataFrame(talk, CHAT)).collect()
    assert [r.turn for r in rows] == list(range(71)) and rows[69].path == list(range(70)) and rows[70].path == [70]


def quoted_talk(seed, conversations, turns):
    """Conversations whose replies quote the whole, some lines or a sentence of a known earlier message, now and then with its own quotes."""
    random.seed(seed)
    rows, parents = [], {}
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(random.randrange(3, 9)))
    for conv in range(conversations):
        said, raw = [], []
        for turn in range(turns):
            own = "\n".join(" ".join(" ".join(word() for _ in range(random.randrange(4, 9))).capitalize() + random.choice(".!?") for _ in range(random.randrange(1, 4))) for _ in range(random.randrange(1, 5)))
            parent = random.randrange(turn) if turn and random.random() < 0.7 else None
            head = ""
            if parent is not None:
                lines, how = said[parent].split("\n"), random.randrange(5)
                first = random.randrange(len(lines))
                part = [said[parent], "\n".join(lines[first : first + 2]), random.choice(lines[first].replace("! ", "!|").replace(". ", ".|").replace("? ", "?|").split("|")), raw[parent], said[parent].upper()][how]
                head = "".join(f"> {x}\n" for x in part.split("\n"))
                head = random.choice(["", "On Monday Bob wrote:\n"]) + head
                parents[conv, turn] = parent
            said.append(own)
            raw.append(head + own)
            rows.append((conv, turn, random.choice(["user", "assistant"]), head + own))
    return rows, parents


def brute_links(rows):
    """reply_to of each message, by comparing its quoted passages with all earlier own texts."""
    even = lambda t: " ".join(t.split()).casefold()
    sentences = lambda t: [s for s in chat._ENDS.split(t) if s.strip()]
    parts, out = {}, {}
    for conv, turn, _, text in rows:
        own, quotes, level = [], [], 0
        lines = text.split("\n")
        for i, line in enumerate(lines):
            depth, rest = 0, line
            while rest.lstrip(" ").startswith(">"):
                depth, rest = depth + 1, rest.lstrip(" ")[1:]
            if not depth:
                if not (line.endswith("wrote:") and i + 1 < len(lines) and lines[i + 1].startswith(">")):
                    own.append(line)
            elif depth == level and quotes and rest.strip():
                quotes[-1][1].append(rest)
            else:
                quotes.append((depth, [rest]))
            level = depth
        pairs = lambda ls: [f"{a} {b}" for a, b in zip(ls, ls[1:], strict=False)]
        heard = {even(x) for x in ["\n".join(own), *own, *pairs(own), *sentences(even("\n".join(own)))]}
        heard |= {even(s) for s in sentences(" ".join("\n".join(own).split()))}
        found = []
        for depth, ls in quotes:
            for kind in ([" ".join(ls)], pairs(ls), ls if len(ls) > 1 else [], sentences(" ".join(ls))):
                firsts = [min((t for (c, t), h in parts.items() if c == conv and t < turn and even(x) in h), default=None) for x in kind]
                if firsts and None not in firsts:
                    found.append((depth, -max(firsts)))
                    break
        parts[conv, turn] = heard
        out[conv, turn] = -min(found)[1] if found else None
    return out


def test_links_of_a_quoting_corpus_by_brute_force_and_recall(spark):
    rows, parents = quoted_talk(11, 12, 25)
    got = {(r.conv_id, r.turn): r for r in chat.link_replies(spark.createDataFrame(rows, CHAT)).collect()}
    want = brute_links(rows)
    assert {k: r.reply_to for k, r in got.items()} == want
    assert sum(got[k].reply_to == p for k, p in parents.items()) >= 0.9 * len(parents)
    assert all(got[k].reply_to is None for k in want if k not in parents)
    order = [(r.conv_id, r.turn) for r in chat.ordered_conversations(spark.createDataFrame(rows, CHAT)).collect()]

    def tree(conv, turn):
        return [(conv, turn), *(x for t in sorted(t for (c, t), p in want.items() if c == conv and p == turn) for x in tree(conv, t))]

    assert order == [x for conv in range(12) for t in range(25) if want[conv, t] is None for x in tree(conv, t)]
