"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Texts are folded (case, homoglyphs, digit and symbol substitutions) and cut to letters. The lexicon holds beginnings of words,
learned with their weights from labelled training rows: the log-odds of a toxic document given the beginning. Longer
beginnings that clean documents use, and fixed phrases, are exceptions: the longest entry that starts at a place decides,
and an exception weighs nothing. The matched weights, as a sum and by length, make a score through a logistic curve fitted
on the same rows.

The learning sees at most `sample` labelled rows, a documented bound, chosen by a hash of their id; so its tables are small
whatever the corpus. Scoring is row by row, without a shuffle, and reads whole texts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerframe.llm.shared import name, sliced, written

#: Labelled rows that the lexicon is learned from, at most (in expectation; the bound of the broadcast is twice that).
SAMPLE = 40_000
#: Beginnings of words, in letters.
SHORTEST, LONGEST = 4, 12
#: The least log-odds of an entry, and the least number of toxic rows that have it.
LEAST_WEIGHT, LEAST_ROWS = 2.5, 4
#: The least evidence of an entry, as twice the log-likelihood ratio against an equal share among toxic and clean rows. Among some
#: hundred thousand beginnings this leaves hardly one by chance.
LEAST_EVIDENCE = 24.0
#: Words added to each text's length before normalising, so that short texts don't run to extremes.
LENGTH_PRIOR = 50

#: Characters that look like a Latin letter.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһкмтвнαεοριτυκνӏ", "aeopcyxijsdhkmtbhaeopitukvl", strict=True))
#: Digits and symbols that stand in for letters inside words.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
#: Phrases in which a lexicon word is harmless.
PHRASES = ("trash can", "trash bag", "trash bin", "clown fish", "pond scum", "idiot proof", "sore loser rule", "disgusting smell")

_FOLD = str.maketrans(HOMOGLYPHS)
_STAND_IN = re.compile(r"[0134578@$!|]")
#: A stand-in counts where it touches a letter on both sides, or begins a word before a letter.
_INSIDE = re.compile(r"(?:(?<=[^\W\d_])|(?<!\S))[0134578@$!|]+(?=[^\W\d_])")
_OTHER = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """The text's words in plain letters: each preceded by one blank, with one blank at the end."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_FOLD)
    if _STAND_IN.search(text):
        text = _INSIDE.sub(lambda m: "".join(SUBSTITUTES[c] for c in m[0]), text)
    return " " + _OTHER.sub(" ", text).strip() + " "


def beginnings(words: set[str]) -> set[str]:
    return {w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)}


@dataclass(frozen=True)
class Lexicon:
    """Beginnings of words (or phrases) with weights, zero for exceptions; and the curve: intercept, slope of the sum, slope by length."""

    entries: tuple[tuple[str, float], ...]
    curve: tuple[float, float, float] = (-3.0, 1.0, 1.0)


class Matcher:
    def __init__(self, lexicon: Lexicon) -> None:
        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.entries:
            self.automaton.add_word(" " + entry, (len(entry) + 1, weight))
        self.curve = lexicon.curve
        if lexicon.entries:
            self.automaton.make_automaton()

    def measured(self, text: str) -> tuple[float, float]:
        """The sum of the weights of the longest entries, and that sum by length."""
        plain = fold(text)
        total, at, best, size = 0.0, -1, 0.0, 0
        found: dict[int, tuple[int, float]] = {}
        for end, (size, weight) in self.automaton.iter(plain) if len(self.automaton) else ():
            start = end - size + 1
            if start not in found or found[start][0] < size:
                found[start] = size, weight
        # An exception phrase covers what begins inside it.
        covered = -1
        for at in sorted(found):
            size, best = found[at]
            if at + 1 > covered:
                total += best
            if best == 0:
                covered = max(covered, at + size)
        return total, total / math.sqrt(plain.count(" ") - 1 + LENGTH_PRIOR)

    def score(self, text: str) -> float:
        total, by_length = self.measured(text)
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a + b * math.log1p(total) + c * by_length))))


def held_out(key: Column, parts: int = 5) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % parts == 0


def _training(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, sample: int) -> DataFrame:
    """text and label of the sampled labelled rows outside the held-out part; a row's first label counts."""
    own = labels.select(name(id_column).alias("id"), name(label_column).cast("int").alias("label"))
    own = own.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    total = own.count()
    slots = 1 << 30
    kept = slots if total <= sample else int(slots * sample / total)
    own = own.where(F.pmod(F.xxhash64("id"), F.lit(slots)) < F.lit(kept)).groupBy("id").agg(F.min("label").alias("label"))
    rows = docs.select(name(id_column).alias("id"), F.coalesce(name(text_column).cast("string"), F.lit("")).alias("text"))
    # At most about `sample` rows of an id and a label: a few MB.
    return written(rows.join(F.broadcast(own), "id").select("text", "label"), "toxicity")


def _counts(rows: DataFrame, wanted: set[str] | None) -> DataFrame:
    """Of how many rows each beginning (of the wanted ones) is part, combined batch by batch and then by shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for part in sliced(batch):
                for text in part.column(0).to_pylist():
                    found = beginnings(set(fold(text).split()))
                    counts.update(found if wanted is None else found & wanted)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["part", "n"])

    return rows.select("text").mapInArrow(run, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", sample: int = SAMPLE) -> Lexicon:
    """The lexicon and curve of the labelled rows outside the held-out part. Without such rows, the lexicon is empty."""
    rows = _training(docs, labels, id_column, text_column, label_column, sample)
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon(())
    # Only beginnings that are common enough in toxic rows and far commoner than chance: their number is bounded by the sample.
    toxic = _counts(rows.where("label = 1"), None).where(F.col("n") >= max(LEAST_ROWS, n_toxic // 500))
    in_toxic = {r["part"]: r["n"] for r in toxic.collect()}
    in_clean = {r["part"]: r["n"] for r in _counts(rows.where("label = 0"), set(in_toxic)).collect()}

    def weight(part: str) -> float:
        return math.log((in_toxic[part] + 0.5) / (n_toxic + 1)) - math.log((in_clean.get(part, 0) + 0.5) / (n_clean + 1))

    def evidence(part: str) -> float:
        a, b = in_toxic[part], in_clean.get(part, 0)
        share = n_toxic / (n_toxic + n_clean)
        terms = ((x, (a + b) * q) for x, q in ((a, share), (b, 1 - share)))
        return 2 * sum(x * math.log(x / expected) for x, expected in terms if x)

    chosen: dict[str, float] = {}
    for part in sorted(in_toxic, key=lambda p: (len(p), p)):
        above = next((chosen[part[:n]] for n in range(len(part) - 1, SHORTEST - 1, -1) if part[:n] in chosen), None)
        own = weight(part)
        if above is None and own >= LEAST_WEIGHT and evidence(part) >= LEAST_EVIDENCE:
            chosen[part] = own
        elif above and own < LEAST_WEIGHT:
            chosen[part] = 0.0
    # Every entry and every exception stays: the evidence asked for bounds their number by the sample.
    strongest = sorted(chosen.items(), key=lambda e: (-e[1], e[0]))
    lexicon = Lexicon((*strongest, *((fold(p).strip(), 0.0) for p in PHRASES if fold(p).strip() not in chosen)))
    measured = _measured(rows, lexicon).collect()
    return Lexicon(lexicon.entries, fit_curve(np.array([r["total"] for r in measured]), np.array([r["by_length"] for r in measured]), np.array([r["label"] for r in measured])))


def _measured(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in (part for whole in batches for part in sliced(whole)):
            found = [matcher.measured(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.float64()), pa.array([b for _, b in found], pa.float64()), batch.column(1)], names=["total", "by_length", "label"])

    return rows.select("text", "label").mapInArrow(run, "total double, by_length double, label int")


def fit_curve(total: np.ndarray, by_length: np.ndarray, label: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Logistic regression by Newton's method, with a small ridge so that separable rows have a finite answer."""
    x = np.column_stack([np.ones(len(label)), np.log1p(total), by_length])
    order = np.lexsort(x.T)
    x, y, w = x[order], label[order].astype(float), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        gradient = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(3), gradient)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (0 to 1, higher: likelier toxic), predicted (1 from one half on).

    Null and empty texts get the score of a text without matches. Repeated rows are scored alike; other columns are not read;
    an empty table gives no rows.
    """
    kind = docs.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in (part for whole in batches for part in sliced(whole)):
            scores = [matcher.score(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(name(id_column), name(text_column).cast("string"))
    scored = rows.mapInArrow(run, T.StructType([T.StructField("doc_id", kind), T.StructField("score", T.DoubleType(), False)]))
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
