"""Spelling variants: words one edit apart, by a rare-first prefix filter over positional bigrams, and the root each word comes from.

Words are counted from whole texts (`vocabulary`). Bigrams are ordered by the number of words that have them, rarest first; each word stands in a table at its
PREFIX rarest bigrams, with their positions. One edit spoils at most two bigrams of a word and moves the others by one place at
most, so two words within one edit have one of the PREFIX rarest in common: at the same place where a letter is replaced, and at the same or the
next one in the longer word where a letter is put in. Words that meet at a (bigram, place, length) are verified by their edit distance in the
join itself, so that no pair comes out but near ones.

Crowded keys. Where more than CROWD words stand at a key, all that meet there would be tried against each other. So those keys are split: a word is cut
in SEGMENTS, the edit lies in one of them, and words meet only if all outside of it is equal too. That is exact, and what stands
at such a key grows with the ways to write one segment instead of with the vocabulary. Nothing is capped.

Scale. Texts are not shuffled: words are counted with a map-side combine, so that a frequent word is one row a task. After that, work is of the size of
the vocabulary. There are at most 8,100 bigrams of the alphabet (26 letters and 64 of Latin-1); their ranks alone reach the driver and the tasks. Roots are found by
pointer doubling; each form is five times as frequent as its word, so chains are short.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.shared import attach, numbered, place, written

RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: How many times as frequent a form is as its word, at least.
RATIO = 5
PREFIX = 3
CROWD = 64
SEGMENTS = 3
#: One run in so many loses a letter, by its hash.
DROPPED = 199


def _lowered(run: Column) -> Column:
    """run with A-Z alone lower-cased."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, _UPPER, _UPPER.lower()))


def vocabulary(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", dropped: int | None = DROPPED) -> DataFrame:
    """word and n: runs of letters of whole texts, A-Z lower-cased, of at least LEAST_LENGTH code points and LEAST_COUNT occurrences.

    If `dropped` divides the CRC-32 h of `<id>:<run>`, the run loses its code point h % length first (None: none does). A null text has no words; a null id is
    written as nothing."""
    run = F.explode(F.regexp_extract_all(place(docs, text_column).cast("string"), F.lit(RUN), F.lit(0))).alias("run")
    runs = numbered(docs).select(F.coalesce(place(docs, id_column).cast("string"), F.lit("")).alias("id"), run)
    runs = runs.where(F.length("run") >= LEAST_LENGTH).select("id", _lowered(F.col("run")).alias("word"))
    if dropped is not None:
        h = F.crc32(F.concat("id", F.lit(":"), F.col("word")).cast("binary"))
        at = F.pmod(F.col("h"), F.length("word")).cast("int")
        shorter = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        runs = runs.withColumn("h", h).withColumn("word", F.when(F.col("h") % dropped == 0, shorter).otherwise(F.col("word"))).where(F.length("word") >= LEAST_LENGTH)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _ranks(words: DataFrame) -> dict[str, int]:
    """The place of each bigram in the order of frequency, rarest first: at most 8,100 of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                seen.update(map("".join, zip(word, word[1:], strict=False)))
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["gram", "f"])

    counts = words.select("word").mapInArrow(run, "gram string, f long").groupBy("gram").agg(F.sum("f").alias("f"))
    return {r.gram: k for k, r in enumerate(counts.orderBy("f", "gram").collect())}


def _places(words: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """word, n, m (its length), gram (rank) and at: the PREFIX rarest bigrams of each word, ties by their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("gram", pa.int32()), ("at", pa.int32())]))
        for batch in batches:
            found = [sorted((ranks[w[k : k + 2]], k) for k in range(len(w) - 1))[:PREFIX] for w in batch.column(0).to_pylist()]
            grams = pa.array([[{"gram": g, "at": k} for g, k in f] for f in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), grams], names=["word", "n", "grams"])

    rows = words.select("word", "n").mapInArrow(run, "word string, n long, grams array<struct<gram:int,at:int>>")
    return rows.select("word", "n", F.length("word").alias("m"), F.explode("grams").alias("g")).select("word", "n", "m", "g.gram", "g.at")


def _cuts(length: Column) -> list[Column]:
    """Where the segments of a word of this length begin, and its end."""
    return [F.floor(length * F.lit(s) / F.lit(SEGMENTS)).cast("int") for s in range(SEGMENTS + 1)]


def _outside(word: Column, begin: Column, end: Column) -> Column:
    """word without its letters from `begin` to `end`."""
    return F.concat(F.substring(word, F.lit(1), begin), F.lit(" "), F.substring(word, end + F.lit(1), F.length(word)))


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """u, u_n, v, v_n: each two of the words (word, n; written) that are one inserted, deleted or replaced code point apart, once.

    Words have at least PREFIX bigrams; u is the shorter one, or the lesser of two as long."""
    key = lambda at, m: F.xxhash64("gram", at, m)
    places = _places(words, _ranks(words)).withColumn("key", key(F.col("at"), F.col("m")))
    stand = written(places, "places")
    crowds = written(stand.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > crowd), "crowds")
    marked = lambda rows: attach(rows, crowds, "key", "rows", F.xxhash64("word", "at")).withColumn("crowded", F.col("found").isNotNull()).drop("found")
    stand = written(marked(stand), "standing")
    # What looks for longer words: at the same place, and at the next.
    longer = stand.select("word", "n", "m", "gram", "at", F.explode(F.array(F.lit(0), F.lit(1))).alias("moved"))
    longer = marked(longer.withColumn("key", key(F.col("at") + F.col("moved"), F.col("m") + F.lit(1))))
    word, at = F.col("word"), F.col("at")

    def split(rows: DataFrame, sort: str, base: Column, extra: int, lives: list[Column] | None) -> DataFrame:
        cuts = _cuts(base)
        parts = [F.when(lives[s] if lives else F.lit(True), F.xxhash64(F.lit(sort), F.lit(s), "key", _outside(word, cuts[s], cuts[s + 1] + F.lit(extra)))) for s in range(SEGMENTS)]
        return rows.where("crowded").select("word", "n", F.explode(F.array_compact(F.array(*parts))).alias("key"))

    own, inner = _cuts(F.col("m")), _cuts(F.col("m") - F.lit(1))
    # A bigram survives an edit in a segment if it is not all of it, or, where letters are put in, if it can stand on that side.
    kept = [~((own[s] >= at) & (own[s + 1] <= at + F.lit(2))) for s in range(SEGMENTS)]
    aside = [F.when(F.col("moved") == 1, own[s] <= at).otherwise(own[s + 1] >= at + F.lit(2)) for s in range(SEGMENTS)]
    plain = lambda rows: rows.where("not crowded").select("word", "n", "key")
    same = plain(stand).union(split(stand, "same", F.col("m"), 0, kept))
    looks = same.union(plain(longer)).union(split(longer, "longer", F.col("m"), 0, aside))
    stands = same.union(split(stand, "longer", F.col("m") - F.lit(1), 1, None))
    looks, stands = looks.toDF("u", "u_n", "key"), stands.toDF("v", "v_n", "key")
    ordered = (F.length("u") < F.length("v")) | ((F.length("u") == F.length("v")) & (F.col("u") < F.col("v")))
    met = looks.join(stands.withColumnRenamed("key", "there"), (F.col("key") == F.col("there")) & ordered & (F.levenshtein("u", "v", 1) == 1))
    return met.select("u", "u_n", "v", "v_n").distinct()


def _roots(links: DataFrame) -> DataFrame:
    """word and root of the words that have a form (word, form; written): where following forms ends."""
    open_, done = links.select("word", F.col("form").alias("root")), None
    while True:
        step = open_.join(open_.toDF("via", "further"), F.col("root") == F.col("via"), "left")
        step = written(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        open_, done = step.drop("moved"), step.where("moved").isEmpty()
        if done:
            return open_


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", dropped: int | None = DROPPED) -> DataFrame:
    """One row for each word of `vocabulary`: word, form, root, n, n_near, form_n.

    n_near counts the words that are exactly one code point apart. The form is the most frequent of them (ties: the smallest in code-point order) if it is
    at least RATIO times as frequent as the word, else null, and so is form_n; root is where following forms ends, the word itself if it has none.
    Null and empty texts have no words; texts and words of any length are taken whole; repeated rows count each; other columns are not read,
    whatever they are called; an empty table gives no rows.
    """
    words = written(vocabulary(docs, id_column, text_column, dropped), "vocabulary")
    pairs = written(near_pairs(words), "near-words")
    both = pairs.select(F.col("u").alias("to"), F.col("v").alias("near"), F.col("v_n").alias("near_n"))
    both = both.union(pairs.select("v", "u", "u_n"))
    best = both.groupBy("to").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    out = words.join(best, F.col("word") == F.col("to"), "left").drop("to")
    chosen = -F.col("best.less") >= F.col("n") * F.lit(RATIO)
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n"))
    out = written(out, "forms")
    roots = _roots(out.where("form is not null").select("word", "form")).toDF("to", "root")
    out = out.join(roots, F.col("word") == F.col("to"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
