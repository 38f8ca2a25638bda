"""Personal data, also where it is disguised: transducers that keep the offsets of what they rewrite.

A text goes through transducers one after the other. Each rewrites what it knows and remembers an alignment, piece by piece, of its output with its input:
`fold` turns look-alike characters (of other scripts, full width, other digits, dashes and blanks) into plain ones and takes out invisible ones, and reads
letters between digits as the digits they look like; `dots` writes dots for "(dot)", "[.]" or " dot "; `digits` writes digits for runs of spelled
ones; `ats` writes @ for "(at)", "[@]", " @ " or, before a domain with a disguised dot, " at ". Identifiers (e-mail and IP addresses, card and
phone numbers) are detected in the text as it stands and in what comes out at the end; a span found there is mapped back through
the alignments to the characters that it came from, and reported if these read otherwise. What stands in the text plainly is never changed by the method.

Scale. Row by row, with no shuffle. Every pattern is matched in time that grows with the text: what could be tried from many places is anchored or
possessive, e-mail addresses are sought from their @. Transducers without anything to rewrite cost one search.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.shared import numbered, place, sliced

KINDS = ("email", "ip", "card", "phone")
MASKS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NO_DIGITS = re.compile("[^0-9]+")

# Characters that look like plain ones, by script, in the order of the plain ones beside them.
_LOOKALIKES = (
    ("АВЕКМНОРСТУХЅІЈ", "ABEKMHOPCTYXSIJ"),
    ("аеорсухѕіјһԁԛԝ", "aeopcyxsijhdqw"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),
    ("ανορικυ", "avopiku"),
    ("ɑɡıȷⅼ", "agijl"),
    ("‐‑‒–—−﹣", "-------"),
    ("․。｡﹒", "...."),
    ("﹫⁺", "@+"),
)
# Spelled digits from zero on, in four languages.
_SPELLED = (
    ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"),
    ("null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"),
    ("zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"),
    ("cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"),
)
_ALSO = {"oh": "0", "zwo": "2", "fuenf": "5", "une": "1"}
_TIMES = {"double": 2, "triple": 3, "doble": 2, "doppel": 2}
_AT_WORDS = ("at", "arroba", "arobase", "klammeraffe")
_DOT_WORDS = ("dot", "punkt", "point", "punto")
_AS_DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1"}


def _folded() -> dict[str, str]:
    """What each look-alike becomes: those above, full-width forms, and by the Unicode database digits, blanks and invisible characters."""
    table = {a: b for many, plain in _LOOKALIKES for a, b in zip(many, plain, strict=True)}
    table |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    for c in map(chr, range(0x80, 0x20000)):
        kind, digit = unicodedata.category(c), unicodedata.digit(c, None)
        if kind in ("Zs", "Cf") or digit is not None:
            table[c] = " " if kind == "Zs" else "" if kind == "Cf" else str(digit)
    return table


_FOLD = _folded()
#: All that may be a look-alike: what is neither ASCII nor a Latin letter of Europe.
_FOLDABLE = re.compile("[^\x00-\x7F\u00C0-\u0130\u0132-\u0236]")
_BETWEEN = re.compile(r"[0-9]([OolI]{1,2})(?=\.?[0-9])")

_DIGIT_OF = {w: str(k) for words in _SPELLED for k, w in enumerate(words)} | _ALSO
_ONE = "(?:" + "|".join(sorted([*_DIGIT_OF, *_TIMES], key=lambda w: (-len(w), w))) + ")"
_RUN = re.compile(rf"(?<![^\W_])(?:plus[ \t]+)?{_ONE}(?:(?:[ \t]{{1,3}}|,[ \t]|-|\.){_ONE})+(?![^\W_])", re.I)
_PIECE = re.compile(r"[^\W_]+|[^\w]+", re.I)
#: A spelled digit with a figure on the other side of a dot.
_ALONE = re.compile(rf"(?<=[0-9]\.){_ONE}(?![^\W_])|(?<![^\W_]){_ONE}(?=[.][0-9])", re.I)

_OPEN, _SHUT = r"[(\[{<][ \t]*", r"[ \t]*[)\]}>]"
_DOT = re.compile(rf"[ \t]{{0,3}}{_OPEN}(?:\.|{'|'.join(_DOT_WORDS)}){_SHUT}[ \t]{{0,3}}|(?<=[A-Za-z0-9])[ \t]{{1,3}}(?:{'|'.join(_DOT_WORDS)})[ \t]{{1,3}}(?=[A-Za-z0-9])", re.I)
_DOT_HINT = re.compile(rf"{_OPEN}\.")
_AT = re.compile(rf"[ \t]{{0,3}}{_OPEN}(?:@|{'|'.join(_AT_WORDS)}){_SHUT}[ \t]{{0,3}}|(?<=[A-Za-z0-9])(?:[ \t]{{1,3}}@[ \t]{{0,3}}|@[ \t]{{1,3}})(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])[ \t]{{1,3}}(?P<word>{'|'.join(_AT_WORDS)})[ \t]{{1,3}}(?=[A-Za-z0-9])", re.I)
_AT_HINT = re.compile(rf"{_OPEN}(?:@|{'|'.join(_AT_WORDS)})|[ \t]@|@[ \t]", re.I)
#: Bytes as words are told apart by: all but letters, digits and what is beyond ASCII is blank.
_WORD_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
_DIGIT_BYTES, _DOT_BYTES = (frozenset(w.encode() for w in words) for words in ((*_DIGIT_OF, *_TIMES), _DOT_WORDS))
_LAST_LABEL = re.compile(r"\.[A-Za-z]{2,24}$")


@dataclass
class Aligned:
    """A text that came of another by edits: (start, end, replacement), in order and apart. Its places map back to those of the other."""

    text: str
    #: By piece: where it starts in the text, where in the source, where it ends there, and whether it is as it was.
    starts: list[int] = field(default_factory=list)
    pieces: list[tuple[int, int, bool]] = field(default_factory=list)

    @classmethod
    def of(cls, source: str, edits: list[tuple[int, int, str]]) -> Aligned:
        out, parts, at, length = cls(""), [], 0, 0
        for start, end, new in [*edits, (len(source), len(source), "")]:
            for part, a, b, same in ((source[at:start], at, start, True), (new, start, end, False)):
                if part:
                    out.starts.append(length)
                    out.pieces.append((a, b, same))
                    parts.append(part)
                    length += len(part)
            at = end
        out.text = "".join(parts)
        return out

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The span of the source that a span of the text (not empty) came from."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        (a, _, same), (c, d, last) = self.pieces[i], self.pieces[j]
        return (a + start - self.starts[i] if same else a), (c + end - self.starts[j] if last else d)

    def edited(self, start: int, end: int) -> bool:
        """Whether any of the span was rewritten."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        return any(not same for _, _, same in self.pieces[i : j + 1])


def fold(text: str) -> list[tuple[int, int, str]]:
    """Edits that make look-alike characters plain, and letters between digits digits."""
    edits = [(m.start(), m.end(), _FOLD[m[0]]) for m in _FOLDABLE.finditer(text) if m[0] in _FOLD] if not text.isascii() else []
    return sorted(edits + [(m.start(1), m.end(1), "".join(map(_AS_DIGITS.get, m[1]))) for m in _BETWEEN.finditer(text)])


def dots(text: str) -> list[tuple[int, int, str]]:
    """Edits that write dots for disguised ones."""
    return [(m.start(), m.end(), ".") for m in _DOT.finditer(text)]


def digits(text: str) -> list[tuple[int, int, str]]:
    """Edits that write digits for spelled ones: runs of two or more, joined, and single ones beside dots and figures. Dots stay."""
    edits: list[tuple[int, int, str]] = []
    for run in _RUN.finditer(text):
        times = 1
        for piece in _PIECE.finditer(text, run.start(), run.end()):
            word = piece[0].lower()
            if word in _TIMES:
                times, new = _TIMES[word], ""
            elif word in _DIGIT_OF:
                times, new = 1, _DIGIT_OF[word] * times
            else:
                new = "+" if word == "plus" else "." if word == "." else ""
            edits.append((piece.start(), piece.end(), new))
    taken = [(a, b) for a, b, _ in edits]
    for m in _ALONE.finditer(text):
        k = bisect_right(taken, (m.start(), len(text)))
        if m[0].lower() in _DIGIT_OF and not (k and taken[k - 1][1] > m.start()):
            edits.append((m.start(), m.end(), _DIGIT_OF[m[0].lower()]))
    return sorted(edits)


def ats(text: str, dotted: Callable[[int, int], bool]) -> list[tuple[int, int, str]]:
    """Edits that write @ for disguised ones; for a bare word only before a domain in which `dotted` finds a disguised dot."""
    edits = []
    for m in _AT.finditer(text):
        if m["word"]:
            domain = _DOMAIN.match(text, m.end())
            if not domain or not _LAST_LABEL.search(domain[0]) or not dotted(domain.start(), domain.end()):
                continue
        edits.append((m.start(), m.end(), "@"))
    return edits


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARACTERS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def _count(text: str) -> int:
    return sum(map(text.count, "0123456789"))


def _luhn(number: str) -> bool:
    """Whether the check sum of the digits is right: every second one from the right doubled, tens and units added."""
    doubled = [int(d) * 2 for d in number[-2::-2]]
    return (sum(map(int, number[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """start, kind (place in KINDS) and end of each identifier that stands in the text as it is, by start, then kind."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        # A part of more than three digits is at most 255 only with zeros before it.
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(number := _NO_DIGITS.sub("", m[0])) <= 19 and _luhn(number):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= _count(m[0]) <= 15]
    return sorted(found)


def _side_by_side(words: list[bytes]) -> bool:
    """Whether a spelled digit stands next to another, or to a figure."""
    return any(a in _DIGIT_BYTES and (b in _DIGIT_BYTES or b.isdigit()) or b in _DIGIT_BYTES and a.isdigit() for a, b in zip(words, words[1:], strict=False))


def _normalised(text: str) -> list[Aligned]:
    """The alignments of the transducers that rewrite anything, in order."""
    chain: list[Aligned] = []

    def take(edits: list[tuple[int, int, str]]) -> None:
        nonlocal text
        if edits:
            chain.append(Aligned.of(text, edits))
            text = chain[-1].text

    take(fold(text))
    words = text.lower().encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
    known = set(words)
    dotted = not known.isdisjoint(_DOT_BYTES) or _DOT_HINT.search(text) is not None
    spelled = not known.isdisjoint(_DIGIT_BYTES) and (dotted or _side_by_side(words))
    if dotted:
        take(dots(text))
    if spelled:
        take(digits(text))

    def came_of_a_dot(start: int, end: int) -> bool:
        """Whether a rewritten dot is among the dots of a domain."""
        for k in range(start, end):
            if text[k] == ".":
                a, b = k, k + 1
                for step in reversed(chain):
                    if step.edited(a, b):
                        return True
                    a, b = step.back(a, b)
        return False

    if dotted or _AT_HINT.search(text):
        take(ats(text, came_of_a_dot))
    return chain


def personal_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, str]]]:
    """The spans that stand plainly (start, kind, end), and those that are disguised (start, kind, end, what it reads)."""
    plain = detect(text)
    chain = _normalised(text)
    if not chain:
        return plain, []
    last, known, more = chain[-1].text, set(plain), []
    for start, kind, end in detect(last):
        a, b = start, end
        for step in reversed(chain):
            a, b = step.back(a, b)
        value = last[start:end]
        if text[a:b] != value and (a, kind, b) not in known and (kind or _LAST_LABEL.search(value)):
            more.append((a, kind, b, value))
    return plain, sorted(more)


def _written_out(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


_FOUND = "array<struct<kind:string,start:long,end:long,value:string,disguised:boolean>>"


def find_personal(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, found, base_sha256, spans.

    found has each identifier: kind, start and end (code points of the text as it stands, end exclusive), value (what it reads, without its
    disguise) and disguised; plain ones of one kind do not overlap each other, others may. spans are all of them as kind:start:end by start, then kind;
    base_sha256 is the SHA-256 of the plain ones alone, written so. Null and empty texts have none; texts of any length are read whole; repeated rows
    come out each; other columns are not read, whatever they are called; an empty table gives no rows.
    """
    kind = numbered(docs).select(place(docs, id_column).alias("id")).dtypes[0][1]
    entry = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("disguised", pa.bool_())]))

    def row(text: str) -> tuple[list[dict], str, str]:
        plain, more = personal_spans(text)
        if not plain and not more:
            return [], _EMPTY_SHA, ""
        every = sorted([(s, k, e, text[s:e], False) for s, k, e in plain] + [(*m, True) for m in more])
        found = [{"kind": KINDS[k], "start": s, "end": e, "value": v, "disguised": d} for s, k, e, v, d in every]
        return found, hashlib.sha256(_written_out(plain).encode()).hexdigest(), _written_out([x[:3] for x in every])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole)):
            rows = [row(t or "") for t in batch.column(1).to_pylist()]
            columns = [pa.array([r[0] for r in rows], entry), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "found", "base_sha256", "spans"])

    rows = numbered(docs).select(place(docs, id_column).alias("id"), place(docs, text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, found {_FOUND}, base_sha256 string, spans string")


_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def personal_digests(found: DataFrame) -> DataFrame:
    """The result of `find_personal` with counts of the plain identifiers: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_disguised."""
    count = lambda good: F.size(F.filter("found", good)).cast("long")
    plain = lambda kind: count(lambda s: (s["kind"] == kind) & ~s["disguised"]).alias(f"n_{kind}")
    return found.select("doc_id", *map(plain, KINDS), "base_sha256", "spans", count(lambda s: s["disguised"]).alias("n_disguised"))


def masked(text: str) -> str:
    """The text with each run of overlapping identifiers replaced by the mask of the first."""
    plain, more = personal_spans(text)
    out, at = [], 0
    for start, kind, end in sorted(plain + [m[:3] for m in more]):
        if start >= at:
            out += [text[at:start], MASKS[kind]]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def mask_personal(docs: DataFrame, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """docs with personal data in the text masked, disguised or not, and the length column brought up to date.

    All rows stay; rows without any are unchanged, nulls included, and so is a length column that is not there. Columns of any name are kept as they are."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if t is None else masked(t) for t in batch.to_pylist()], pa.string())

    hide = F.arrow_udf(run, "string")
    raw = place(docs, text_column).cast("string")
    plain = numbered(docs).withColumn("clean", hide(raw))
    own = {text_column: F.col("clean").cast(docs.schema[text_column].dataType)}
    if length_column in docs.columns:
        own[length_column] = F.when(F.coalesce(F.col("clean") != raw, F.lit(False)), F.length("clean")).otherwise(place(docs, length_column)).cast(docs.schema[length_column].dataType)
    return plain.select(*[own.get(c, F.col(f"c{i}")).alias(f"c{i}") for i, c in enumerate(docs.columns)]).toDF(*docs.columns)
