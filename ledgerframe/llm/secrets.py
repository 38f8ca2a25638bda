"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a maximal run of key-like characters that mixes letters and digits, or upper and lower case. A window slides over it with a
count for each character; a step takes one from the count of the character that leaves and adds one to that of the character that
enters, and brings the sum that the entropy needs up to date from these two counts. A candidate is reported if some window
reaches the threshold of its character class and no allow-list pattern holds. Everything is row by row in DataFrame
expressions: no shuffle, no Python, and only rows where a pattern occurs at all pay for positions. Positions are prefix sums by doubling, so
that time grows with the text (and the logarithm of its matches), however many secrets it has.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.shared import name, numbered, place


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])
ASSIGN = rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: As long as the shortest match that counts; a shorter match could not hide a longer one in these two.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])|(?=[a-z+/_-]*[A-Z])(?=[A-Z+/_-]*[a-z]))[A-Za-z0-9+/_-]{16,}={0,2}"
KINDS = ("assign", "access", "hex", "entropy")
LEAST_VALUE = 6

WINDOW = 16
#: Character classes from the narrowest on, with the entropy in bits that a window must reach.
CLASSES = ((r"^[0-9a-f]+$", 2.75), (r"^[0-9A-F]+$", 2.75), (r"^[A-Z0-9]+$", 3.1), (r"^[a-z0-9_-]+$", 3.3), (r"^[A-Za-z0-9+/_-]+=*$", 3.4))
#: Candidates that are no secrets: UUIDs, dates and times, placeholders, alphabets and digits in order, words with a number at their end. No pattern
#: here repeats a group: the regular expressions of the JVM do that by recursion, which a long candidate would exhaust.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(T|_|$)",
    r"(?i)(example|placeholder|changeme|xxxx|0000000|1234567|abcdefg)",
    r"^[A-Za-z]+[0-9]{1,4}$",
)
MASK = "[SECRET]"
#: Bits of a count, and counts in a long.
COUNT_BITS, COUNTS = 5, 12
#: Code points of a text's pieces that a masked text is put together from.
PIECE = 1024

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _none() -> Column:
    return F.array().cast(_SPAN)


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array, op over the values up to it: in each round every place takes in what stands twice as far back."""

    def double(done: Column, k: Column) -> Column:
        return F.transform(done, lambda x, i: F.coalesce(op(x, F.get(done, i - F.call_function("shiftleft", F.lit(1), k))), x))

    rounds = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int")
    return F.when(F.size(values) > 1, F.aggregate(F.sequence(F.lit(0), rounds - 1), values, double)).otherwise(values)


def _spans(text: Column, pattern: str, kind: int, good: Callable[[Column], Column], group: int = 0) -> Column:
    """Where the pattern matches and good(of the group's text) holds: starts and ends in code points, from the gaps between matches."""

    def located(found: Column) -> Column:
        steps = F.transform(found["whole"], lambda whole, i: F.length(F.get(found["gaps"], i)) + F.length(whole))

        def each(ends: Column) -> Column:
            spans = F.transform(ends, lambda end, i: F.struct((end - F.length(F.get(found["whole"], i))).alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
            return F.filter(spans, lambda span, i: good(F.get(found["part"], i)))

        return _let(steps, lambda all_: _let(_running(all_, lambda a, b: a + b), each))

    whole, part = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    found = F.struct(whole.alias("whole"), part.alias("part"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), _let(found, located)).otherwise(_none())


def top_entropy(value: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of a window of this many characters (at most 31); null for shorter values."""
    # n log2 n by n, with 0 for none.
    weights = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)])
    one = lambda place: F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(COUNT_BITS) * (place % F.lit(COUNTS)))
    long_of = lambda place: F.floor(place / F.lit(COUNTS)).cast("int")

    def count(counts: Column, place: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, long_of(place)), F.lit(COUNT_BITS) * (place % F.lit(COUNTS))).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")

    def slid(found: Column) -> Column:
        places = found["places"]

        def step(done: Column, i: Column) -> Column:
            def moved(now: Column) -> Column:
                enters, leaves, left, there = (now[x] for x in ("enters", "leaves", "left", "there"))
                total = done["sum"] - F.when(leaves >= 0, F.get(weights, left) - F.get(weights, left - 1)).otherwise(F.lit(0.0)) + F.get(weights, there + 1) - F.get(weights, there)
                counts = F.transform(done["counts"], lambda c, k: c - F.when(long_of(leaves) == k, one(leaves)).otherwise(F.lit(0)) + F.when(long_of(enters) == k, one(enters)).otherwise(F.lit(0)))
                least = F.when(i >= window - 1, F.least(done["least"], total)).otherwise(done["least"])
                return F.struct(counts.alias("counts"), total.alias("sum"), least.alias("least"))

            enters, leaves = F.get(places, i), F.coalesce(F.get(places, i - window), F.lit(-1))
            left = F.when(leaves >= 0, count(done["counts"], leaves)).otherwise(F.lit(0))
            there = count(done["counts"], enters) - F.when(leaves == enters, F.lit(1)).otherwise(F.lit(0))
            return _let(F.struct(enters.alias("enters"), leaves.alias("leaves"), left.alias("left"), there.alias("there")), moved)

        first = F.struct(F.array_repeat(F.lit(0).cast("long"), long_of(found["kinds"]) + 1).alias("counts"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("least"))
        return F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), first, step, lambda done: F.log2(F.lit(float(window))) - done["least"] / window)

    def placed(x: Column) -> Column:
        # A character stands for its place among the value's distinct ones.
        places = F.transform(x["chars"], lambda c: F.array_position(x["kinds"], c).cast("int"))
        return _let(F.struct(places.alias("places"), F.size(x["kinds"]).alias("kinds")), slid)

    chars = F.split(value, "")
    return F.when(F.length(value) >= window, _let(F.struct(chars.alias("chars"), F.array_distinct(chars).alias("kinds")), placed))


def _marked_words(value: Column) -> Column:
    """Whether the value is words with single `/`, `_` or `-` between them or at their end, and up to four digits."""
    return value.rlike(r"^[A-Za-z][A-Za-z/_-]*[0-9]{0,4}$") & value.rlike("[/_-]") & ~value.rlike("[/_-][/_-]")


def _camel_case(value: Column) -> Column:
    """Whether the value is words in camel case: each capital with two small letters after it at least, but for a word of capitals alone at
    the beginning; small letters at the beginning are two at least."""
    # The last capital of those at the beginning belongs to the next word.
    rest = F.regexp_replace(value, "^[A-Z]{2,}(?=[A-Z])", "")
    return value.rlike("^[A-Za-z]+$") & (value.rlike("^[A-Z]{2,}$") | ~rest.rlike("[A-Z](?![a-z][a-z])|^[a-z](?![a-z])"))


def looks_random(value: Column) -> Column:
    """Whether a candidate string counts as a secret."""
    bare = F.regexp_replace(value, "=+$", "")
    least = F.when(bare.rlike(CLASSES[0][0]), F.lit(CLASSES[0][1]))
    for pattern, bits in CLASSES[1:]:
        least = least.when(bare.rlike(pattern), F.lit(bits))
    allowed = _marked_words(bare) | _camel_case(bare)
    for pattern in ALLOWED:
        allowed = allowed | bare.rlike(pattern)
    return F.coalesce(~allowed & (top_entropy(bare) >= least), F.lit(False))


def secret_spans(text: Column) -> Column:
    """All spans of a text, by start, then kind: an array of start, kind (place in KINDS), end."""
    always = lambda part: F.lit(True)
    found = [_spans(text, ASSIGN, 0, lambda part: F.length(part) >= LEAST_VALUE, 2), _spans(text, ACCESS, 1, always), _spans(text, HEX, 2, always), _spans(text, CANDIDATE, 3, looks_random)]
    return F.sort_array(F.concat(*found))


def _written_out(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"]), s["start"], s["end"])))


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no spans. Positions are code points, end exclusive. Spans of different kinds may overlap.
    Texts of any length are scanned whole; repeated rows come out each; other columns are not read; an empty table gives no rows.
    """
    text = F.coalesce(name(text_column).cast("string"), F.lit(""))
    rows = docs.select(name(id_column).alias("doc_id"), secret_spans(text).alias("found"))
    base = F.filter("found", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(_written_out(base).cast("binary"), 256).alias("base_sha256"), _written_out(F.col("found")).alias("spans"))


def _masked(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans (in order of their starts; at least one) replaced by MASK.

    It is put together from pieces of PIECE code points, so that no part is looked up from the text's beginning."""

    def between(pieces: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
        one = F.substring(F.get(pieces, first), a % PIECE + 1, b - a)
        more = F.concat(F.substring(F.get(pieces, first), a % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(F.get(pieces, last), F.lit(1), (b - 1) % PIECE + 1))
        return F.when(a >= b, F.lit("")).when(first == last, one).otherwise(more)

    def joined(x: Column) -> Column:
        reach, pieces = x["reach"], x["pieces"]
        before = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0))
        opening = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(between(pieces, before(i), s["start"]), F.lit(MASK))))
        return F.concat(F.array_join(opening, ""), between(pieces, F.element_at(reach, -1), x["length"]))

    reach = _running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.when(b.isNotNull(), F.greatest(a, b)))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return _let(F.struct(reach.alias("reach"), pieces.alias("pieces"), F.length(text).alias("length")), joined)


def redact(docs: DataFrame, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """docs with each secret in the text replaced by MASK (overlapping spans by one), and the length column brought up to date.

    All rows stay, also those without a text; rows without secrets are unchanged, nulls included, and so is a length column that is not there.
    Columns of any name are kept as they are; an empty table stays empty; texts of any length are read whole.
    """
    plain, raw = numbered(docs), place(docs, text_column)
    text = F.coalesce(raw.cast("string"), F.lit(""))
    clean = _let(secret_spans(text), lambda spans: F.when(F.size(spans) > 0, _masked(text, spans)))
    own = {text_column: F.coalesce("clean", raw.cast("string")).cast(docs.schema[text_column].dataType)}
    if length_column in docs.columns:
        length = place(docs, length_column)
        own[length_column] = F.when(F.col("clean").isNotNull(), F.length("clean")).otherwise(length).cast(docs.schema[length_column].dataType)
    out = plain.withColumn("clean", clean).select(*[own.get(c, F.col(f"c{i}")).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    return out.toDF(*docs.columns)
