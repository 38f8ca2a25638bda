"""Talks in which one line is quoted, and one turn answered, by most of the messages."""

import random

from ledgerframe.llm import chat, shared
from test_pages_and_chat import brute_links, quoted_talk

CHAT = "conv_id long, turn int, role string, text string"


def test_a_line_that_thirty_thousand_messages_quote(spark, monkeypatch):
    hot = 30_000
    talk = [(1, 0, "user", "the line\nand more")] + [(1, i, "user", f"> the line\nanswer {i}") for i in range(1, hot)]
    talk += [(1, hot + i, "user", f"> answer {hot - 1 if i == 0 else f'on {i - 1}'}\nanswer on {i}") for i in range(5)]
    talk += [(None, 0, "user", "said"), (None, 1, "user", "> said\nback"), (2, 0, "user", "> the line\nelsewhere")]
    random.seed(2)
    random.shuffle(talk)
    seen = []
    original = shared.attach

    def watched(rows, table, key, weight, salt):
        seen.append(table.selectExpr(f"max({weight}) AS m").first().m or 0)
        return original(rows, table, key, weight, salt)

    monkeypatch.setattr(chat, "attach", watched)
    rows = {(r.conv_id, r.turn): (r.reply_to, list(r.path)) for r in chat.link_replies(spark.createDataFrame(talk, CHAT)).collect()}
    assert len(rows) == len(talk) and max(seen) >= hot - 1
    assert all(rows[1, i] == (0, [0, i]) for i in range(1, hot))
    assert [rows[1, hot + i][1] for i in range(3)] == [[0, hot - 1, hot], [0, hot - 1, hot, hot + 1], [0, hot - 1, hot, hot + 1, hot + 2]]
    assert rows[None, 1] == (0, [0, 1]) and rows[2, 0] == (None, [0])


def test_links_where_every_key_is_hot_and_where_none_is(spark, monkeypatch):
    rows, _ = quoted_talk(5, 6, 20)
    want = brute_links(rows)
    for parts in (10**9, 1):
        monkeypatch.setattr(shared, "HEAVY_PARTS", parts)
        assert {(r.conv_id, r.turn): r.reply_to for r in chat.link_replies(spark.createDataFrame(rows, CHAT)).collect()} == want
