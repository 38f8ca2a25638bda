"""Chat formatting by quotation linking.

Each message is parsed into its own text and quoted passages, nested as deep as they go. Normalised passages are hashed and
joined, inside their conversation, to the message that said them first; the nearest level of quotation that finds one names
the message replied to. Conversations are then ordered as reply trees, without the quotes: the sort key of a message is the path
of turns from the first message of its thread down to it, found by pointer doubling in as many rounds as the logarithm of the depth.

Scale. A conversation is never gathered: passages are joined by (conversation, hash), where the originals have one row for each key
after a map-side minimum, and the order is a sort key. A conversation with a third of all messages spreads by its hashes, and a passage that is quoted, or
a turn that is replied to, by as many messages is attached to them where they are (`attach`), so they never meet in a task. What may
be quoted is hashed only in conversations that quote anything. Texts are shuffled once, to be sorted, and once more only where they
reply. A path has one number for each level, so a thread of replies to replies costs the square of its depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.bloom import left_join_sparsely
from ledgerframe.llm.shared import RID, attach, identified, place, sliced, written

_MARKS = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)")
#: A line that announces a quotation, in the four languages.
_SAYS = re.compile(r"^(on|am|le|el)\b.{0,200}\b(wrote|schrieb|écrit|escribió)\s*:\s*$", re.I)
_BLANKS = re.compile(r"\s+")
_PARAGRAPHS = re.compile(r"\n\s*\n")
#: Where a sentence ends, in the four languages.
_ENDS = re.compile(r"(?<=[.!?…])[\"'»”)]*\s+")


def normalised(passage: str) -> str:
    return _BLANKS.sub(" ", passage).strip().casefold()


def _hashed(passages: Iterator[str] | list[str]) -> list[int]:
    found = dict.fromkeys(filter(None, map(normalised, passages)))
    return [xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass")) - (1 << 63) for p in found]


def _line_pairs(lines: list[str]) -> list[str]:
    """Each two lines in a row, blank ones aside."""
    full = [x for x in lines if x.strip()]
    return [f"{a} {b}" for a, b in zip(full, full[1:], strict=False)]


def _sentences(passage: str) -> list[str]:
    return _ENDS.split(passage)


def _parts(lines: list[str]) -> list[list[int]]:
    """Hashes of a quoted passage: of it as a whole; if it has several lines, of its pairs of lines and of its lines; of its sentences."""
    whole = _hashed([" ".join(lines)])
    if not whole:
        return []
    more = [_hashed(_line_pairs(lines)), _hashed(lines)] if len(lines) > 1 else [[], []]
    return [whole, *more, _hashed(_sentences(" ".join(lines)))]


def passages(text: str) -> list[int]:
    """Hashes of all that a later message may quote of an own text: the whole, its paragraphs, pairs of lines, lines and sentences."""
    paragraphs, lines = _PARAGRAPHS.split(text), text.split("\n")
    return _hashed([text, *paragraphs, *_line_pairs(lines), *lines, *(s for p in paragraphs for s in _sentences(_BLANKS.sub(" ", p)))])


def quotations(text: str) -> tuple[str, list[tuple[int, list[list[int]]]]]:
    """The text without quotes; level and hashes (see _parts) of each quoted passage."""
    own: list[str] = []
    quoted: list[tuple[int, list[str]]] = []
    lines = text.split("\n")
    for i, line in enumerate(lines):
        marks = _MARKS.match(line)
        if not marks:
            announces = _SAYS.match(line.strip()) and any(x.strip() for x in lines[i + 1 : i + 3]) and next(bool(_MARKS.match(x)) for x in lines[i + 1 : i + 3] if x.strip())
            if not announces:
                own.append(line)
            quoted.append((0, []))
            continue
        level, rest = marks[1].count(">"), line[marks.end() :]
        if not rest.strip() or not quoted or quoted[-1][0] != level:
            quoted.append((level, []))
        quoted[-1][1].append(rest)
    found = [(level, parts) for level, part in quoted if level and (parts := _parts(part))]
    return (re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n") if found else text), found


def _said(rows: DataFrame, asking: DataFrame) -> DataFrame:
    """conv, hash and first: the turn that first said each passage, in the conversations (hashes in `asking`) that quote any."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole)):
            found = [passages(quotations(t or "")[0]) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["conv", "turn", "own"])

    known = rows.where("turn is not null").select("conv", "turn", "text", F.xxhash64("conv").alias("talk"))
    known = left_join_sparsely(known, asking, "talk").where("quotes is not null").select("conv", "turn", "text")
    said = known.mapInArrow(run, f"conv {kinds['conv']}, turn {kinds['turn']}, own array<long>")
    return said.select("conv", "turn", F.explode("own").alias("hash")).groupBy("conv", "hash").agg(F.min("turn").alias("first"))


def _key(conv: str, at: str) -> Column:
    """A place in a conversation; that of the null conversation equals itself."""
    return F.struct(F.col(conv).alias("conv"), F.col(at).alias("at"))


def _met(rows: DataFrame, table: DataFrame, salt: Column) -> DataFrame:
    """rows (with a `key`) that have a match in `table` (one row for each key), with its other columns in `found`; hot keys don't meet in a task."""
    asks = rows.groupBy("key").agg(F.count(F.lit(1)).alias("asks"))
    return attach(rows, written(table.join(asks, "key"), "met"), "key", "asks", salt).where("found is not null")


def _paths(links: DataFrame) -> DataFrame:
    """conv, turn and path of every turn that replies or is replied to: the turns from the first of its thread down to it.

    links: conv, turn, reply_to. Where several messages of a turn reply, the turn's thread is that of the earliest turn they reply to."""
    up = links.groupBy("conv", "turn").agg(F.min("reply_to").alias("up"))
    ends = links.select("conv", F.col("reply_to").alias("turn")).distinct().join(up.select(F.col("conv").alias("c"), F.col("turn").alias("t")), F.col("conv").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")), "left_anti")
    open_ = written(up.withColumn("path", F.array("turn")), "paths")
    top = written(ends, "threads")
    done = [top.withColumn("path", F.array("turn"))]
    while not open_.isEmpty():
        # The path of a turn gets that of the turn it has come to; a pointer that has come to the first of its thread ends there.
        above = open_.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("up").alias("further"), F.col("path").alias("more"))
        above = above.union(top.select("conv", "turn", F.lit(None), F.array("turn")))
        for ready in done[1:]:
            above = above.union(ready.select("conv", "turn", F.lit(None), "path"))
        above = above.select(_key("c", "t").alias("key"), "further", "more")
        step = _met(open_.withColumn("key", _key("conv", "up")), above, F.struct("conv", "turn"))
        step = written(step.select("conv", "turn", F.col("found.further").alias("up"), F.concat("found.more", "path").alias("path")), "paths")
        done.append(step.where("up is null").select("conv", "turn", "path"))
        open_ = step.where("up is not null")
    out = done[0]
    for ready in done[1:]:
        out = out.union(ready)
    return out


def link_replies(messages: DataFrame, conversation_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """One row for each message: conv_id, turn, role, text (without quotes), reply_to, n_quotes, n_linked, deepest, path, rid.

    reply_to is the turn that first said the nearest quoted passage of the same conversation, if an earlier one did; else null.
    `path` has the turns from the first message of the thread down to this one: sorted by (conv_id, path, rid), a reply follows what it
    answers, after the replies to earlier replies. A passage is one said whole (a text, paragraph, line or sentence), else one whose
    pairs of lines, else one whose lines, else one whose sentences have all been said; the turn is then the one by which they were. Passages are
    compared with white space and case evened out. Null texts are empty; null turns link to nothing; a null conversation
    is one of its own; repeated messages come out each, file by file in the order in which they stand there (rid); other columns are not read, whatever they are
    called; texts of any length are parsed whole; an empty table gives no rows. Passes over the messages know
    them by `identified`, so they may be split into tasks in different ways.
    """
    kinds = [messages.schema[c].dataType.simpleString() for c in (conversation_column, turn_column)]
    quote = pa.struct([("level", pa.int32()), ("parts", pa.list_(pa.list_(pa.int64())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole)):
            found = [quotations(t or "") for t in batch.column(3).to_pylist()]
            columns = [pa.array([c for c, _ in found], pa.string()), pa.array([[{"level": a, "parts": b} for a, b in q] for _, q in found], pa.list_(quote))]
            parsed = pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], *columns], names=["rid", "conv", "turn", "clean", "quotes"])
            yield parsed.filter(pa.array([bool(q) for _, q in found], pa.bool_()))

    at = lambda c: place(messages, c)
    rows = identified(messages, "messages").select("rid", at(conversation_column).alias("conv"), at(turn_column).alias("turn"), at(role_column).cast("string").alias("role"), at(text_column).cast("string").alias("text"))
    # Only what quotes is written; all other messages pass from the source to the sort.
    quoted = rows.select("rid", "conv", "turn", "text").mapInArrow(run, f"rid {RID}, conv {kinds[0]}, turn {kinds[1]}, clean string, quotes array<struct<level:int,parts:array<array<long>>>>")
    quoted = written(quoted, "quoted")
    quoting = quoted.where("turn is not null")
    asking = written(quoting.groupBy(F.xxhash64("conv").alias("talk")).agg(F.count(F.lit(1)).alias("quotes")), "asking")
    asked = quoting.select("rid", F.col("conv").alias("c"), "turn", F.posexplode("quotes").alias("at", "q"))
    asked = asked.select("rid", "c", "turn", "at", F.col("q.level").alias("level"), F.posexplode("q.parts").alias("kind", "hashes"))
    asked = asked.select("rid", "c", "turn", "at", "level", "kind", F.size("hashes").alias("parts"), F.explode("hashes").alias("asked"))
    said = _said(rows, asking).select(_key("conv", "hash").alias("key"), "first")
    met = _met(asked.withColumn("key", _key("c", "asked")), said, F.col("rid")).withColumn("first", F.col("found.first")).where("first < turn")
    # All parts of a kind must have been said; the message is the one that first completes them.
    met = met.groupBy("rid", "c", "turn", "at", "level", "kind", "parts").agg(F.count(F.lit(1)).alias("n"), F.max("first").alias("first")).where("n = parts")
    met = met.groupBy("rid", "c", "turn", "at", "level").agg(F.min(F.struct("kind", "first"))["first"].alias("first"))
    nearest = F.min(F.struct("level", (-F.col("first")).alias("back")))
    links = met.groupBy("rid", "c", "turn").agg(nearest.alias("near"), F.count(F.lit(1)).alias("n_linked"))
    links = written(links.select("rid", F.col("c").alias("conv"), "turn", (-F.col("near.back")).cast(kinds[1]).alias("reply_to"), "n_linked"), "links")
    paths = _paths(links.select("conv", "turn", "reply_to")).toDF("c", "t", "above")
    placed = _met(links.withColumn("key", _key("conv", "reply_to")), paths.select(_key("c", "t").alias("key"), "above"), F.col("rid"))
    placed = placed.select("rid", "reply_to", "n_linked", F.concat("found.above", F.array("turn")).alias("path"))
    deepest = F.array_max(F.transform("quotes", lambda q: q["level"])).alias("deepest")
    answers = written(quoted.select("rid", "clean", F.size("quotes").cast("long").alias("n_quotes"), deepest).join(placed, "rid", "left"), "answers")
    out = left_join_sparsely(rows, answers, "rid")
    return out.select(
        F.col("conv").alias("conv_id"),
        "turn",
        "role",
        F.when(F.col("n_quotes").isNotNull(), F.col("clean")).otherwise(F.coalesce("text", F.lit(""))).alias("text"),
        "reply_to",
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("deepest", F.lit(0)).alias("deepest"),
        F.coalesce("path", F.array("turn")).alias("path"),
        "rid",
    )


def ordered_conversations(messages: DataFrame, **columns: str) -> DataFrame:
    """`link_replies`, in reply order: conversations are range-partitioned, so that a long one spreads over tasks."""
    return link_replies(messages, **columns).orderBy("conv_id", "path", "rid").drop("rid")
