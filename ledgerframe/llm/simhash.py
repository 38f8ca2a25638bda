"""SimHash near-dedup by multi-index hashing over small Hamming balls.

A fingerprint has two 32-bit segments; two fingerprints within two bits of each other have a segment in which they differ in one bit at most.
Each segment's value is a key of a table with the fingerprint. Each fingerprint enumerates the ball of radius one in each segment, the value itself
and its 32 one-bit neighbours, fetches what stands at these keys, and keeps those whose complete distance is small enough. Balls
are probed in the table's Bloom filter first, so few of their members move.

Crowded buckets (more than CROWD fingerprints at a value) would make pairs with the square of their size. What is in one, or looks into one,
goes by a table that both segments key: the ball in one segment, the other exact. What stands at such a key is one 64-bit mask (which one-bit
neighbours of the key are there) and a flag for the key itself: a fixed-size sum that is combined on the map side. All at one key are
within two bits of each other, and each key links its least member to the others, at most 64 links.

Equal texts share a fingerprint and are one vertex; a group of copies collapses on the map side.

`wide_links` does the same with more and narrower segments for a wider radius; `llm/similar.py` verifies what it fetches on the texts' shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerframe.llm.bloom import bloom, left_join_sparsely, probed
from ledgerframe.llm.components import components
from ledgerframe.llm.shared import attach, checkpointed, counted, name, numbered, place, sliced, written

SEED = 42
SHINGLE = 3
RADIUS = 2
BITS = 64
SEGMENT = 32
#: Fingerprints at a segment value, on the average, up to which `segments_for` takes narrower segments.
LOAD = 16
#: Fingerprints at one segment value that are still fetched from there; more are split by the other segment.
CROWD = 64
#: Hashes whose bits are counted together.
BLOCK = 1 << 16

_BIT = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, from the lowest on."""
    lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(hashes) < 256:
        return np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BIT for k in range(8)])


def _majority(counts: np.ndarray, count: int) -> int:
    return int(np.packbits(counts * 2 > count, bitorder="little").view("<u8")[0])


def fingerprint_of(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of a set of shingle hashes; zero for the empty set."""
    return _majority(_bit_counts(hashes), len(hashes)) if len(hashes) else 0


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text: a bit is set if over half the shingles' hashes have it; zero without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    hashed, count, counts = xxhash.xxh64_intdigest, max(1, len(words) - size + 1), np.zeros(BITS, np.int64)
    for first in range(0, count, BLOCK):
        part = words[first : min(first + BLOCK, count) + size - 1]
        columns = [part[k:] for k in range(min(size, len(part)))]
        counts += _bit_counts(np.array([hashed(b" ".join(s), SEED) for s in zip(*columns, strict=False)], np.uint64))
    return _majority(counts, count)


def fingerprints(docs: DataFrame, id_column: str, text_column: str, size: int) -> DataFrame:
    """id and fp (the fingerprint's bits as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole)):
            fps = np.array([fingerprint(t or "", size) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    rows = docs.select(name(id_column).cast("long").alias("id"), name(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField("id", T.LongType()), T.StructField("fp", T.LongType(), False)]))


def _segment_keys(fp: Column) -> list[Column]:
    """The value of each segment, with the segment's number above it."""
    low = fp.bitwiseAND(F.lit((1 << SEGMENT) - 1))
    return [low, F.shiftrightunsigned(fp, SEGMENT).bitwiseOR(F.lit(1 << SEGMENT))]


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) among distinct fingerprints (column fp, written or checkpointed) that connect any two within RADIUS bits of each other."""
    table, rows = counted(distinct.select("fp", F.explode(F.array(*_segment_keys(F.col("fp")))).alias("key")), "segments")
    crowds = written(table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd), "crowds")
    ball = lambda key: F.concat(F.array(key), F.transform(F.sequence(F.lit(0), F.lit(SEGMENT - 1)), lambda i: key.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    # Each row becomes 66, so the few partitions that so small a table comes in are dealt out first.
    spread = distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    balls = spread.select(F.col("fp").alias("u"), F.explode(F.concat(*map(ball, _segment_keys(F.col("fp"))))).alias("key"))
    hits = written(probed(balls, F.col("key"), bloom(table, F.col("key"), rows), "hit").where("hit").select("u", "key"), "hits")
    inside = left_join_sparsely(table, crowds, "key").select("key", F.col("fp").alias("v"), F.col("n").isNotNull().alias("crowded"))
    fetched = hits.join(inside.where("not crowded"), "key").where("u < v").select("u", "v")
    split = hits.join(crowds.select("key"), "key").select(F.col("u").alias("fp")).union(inside.where("crowded").select(F.col("v").alias("fp"))).distinct()
    return fetched.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS).union(_split_links(split))


def _split_links(distinct: DataFrame) -> DataFrame:
    """`links` of fingerprints (column fp) by keys of both segments: for each fingerprint itself and its one-bit neighbours."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.struct(F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)).alias("key"), F.call_function("shiftleft", F.lit(1).cast("long"), i).alias("mask")))
    itself = F.array(F.struct(F.col("fp").alias("key"), F.lit(0).cast("long").alias("mask")))
    table = distinct.select(F.explode(F.concat(itself, flips)).alias("e")).select("e.key", "e.mask")
    table = table.groupBy("key").agg(F.bit_or("mask").alias("mask"), F.max(F.col("mask") == 0).alias("own"))
    table = table.where(F.bit_count("mask") + F.col("own").cast("int") > 1)
    near = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.call_function("getbit", F.col("mask"), i) == 1)
    near = F.transform(near, lambda i: F.col("key").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    members = table.select(F.when(F.col("own"), F.concat(F.array("key"), near)).otherwise(near).alias("members"))
    pairs = members.select(F.array_min("members").alias("u"), F.explode("members").alias("v"))
    return pairs.where((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS))


def segments_for(rows: int) -> int:
    """How many segments so many fingerprints are keyed by: four, three or two, so that few stand at one segment value by chance."""
    return next((n for n in (4, 3) if rows <= LOAD << (BITS // n)), 2)


def radius_of(segments: int) -> int:
    """The distance within which one of so many segments differs in one bit at most."""
    return 2 * segments - 1


def wide_links(distinct: DataFrame, segments: int, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) among distinct fingerprints (column fp, written or checkpointed) within `radius_of(segments)` bits of each other.

    All such pairs are found but those that meet only at a crowded key (more than `crowd` fingerprints) or one bit beside it: there, all that
    look in meet the key's least fingerprint alone, so that no crowd makes pairs with the square of its size. Callers find the others exactly.
    """
    places = [BITS * i // segments for i in range(segments + 1)]
    widths = [b - a for a, b in zip(places, places[1:], strict=False)]
    keys = lambda fp: [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << w) - 1)).bitwiseOR(F.lit(i << SEGMENT)) for i, (a, w) in enumerate(zip(places, widths, strict=False))]
    ball = lambda key, width: F.concat(F.array(key), F.transform(F.sequence(F.lit(0), width - F.lit(1)), lambda i: key.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    table = written(distinct.select("fp", F.explode(F.array(*keys(F.col("fp")))).alias("key")), "segments")
    crowds = table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd)
    width = F.get(F.array(*map(F.lit, widths)), F.shiftright("key", SEGMENT).cast("int"))
    beside, keys_beside = counted(crowds.select(F.explode(ball(F.col("key"), width)).alias("key"), F.lit(True).alias("crowded")).distinct(), "beside")
    inside = left_join_sparsely(table, beside, "key", keys_beside)
    pivots = written(inside.where("crowded").groupBy("key").agg(F.min("fp").alias("pivot")), "pivots")
    spread = distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    balls = spread.select(F.col("fp").alias("u"), F.explode(F.concat(*(ball(k, F.lit(w)) for k, w in zip(keys(F.col("fp")), widths, strict=False)))).alias("key"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius_of(segments)
    stand = inside.where("crowded is null").select("key", F.col("fp").alias("v"), F.lit(False).alias("alone")).union(pivots.select("key", "pivot", F.lit(True)))
    met = balls.join(stand, "key").where(near & (F.col("u") != F.col("v")) & (F.col("alone") | (F.col("u") < F.col("v"))))
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def simhash_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Words are runs of non-white-space, A-Z lower-cased; shingles are `size` words, repeats included; a text of fewer words is
    one shingle. Fingerprints link at RADIUS or fewer differing bits; component_id is the smallest id that links reach.
    Null and empty texts have fingerprint zero and link like any other. A row without an id belongs to its component but
    never names it (null only where no row of it has an id); repeated rows come out each. Other columns are not read.
    An empty table gives no rows.
    """
    rows = written(fingerprints(docs, id_column, text_column, size), "simhash")
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots.toDF("fp", "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = checkpointed(rooted)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = attach(rooted.select("fp", "root", F.col("n").alias("rows")), checkpointed(least), "root", "n", F.col("fp"))
    named = checkpointed(named.select("fp", F.col("found.component_id").alias("component_id"), "rows"))
    out = attach(rows, named, "fp", "rows", F.coalesce("id", F.lit(0)))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("found.component_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE) -> DataFrame:
    """docs with one document of each component: the one with the smallest id. Rows without an id all stay.

    Of rows that repeat the id that stays, all stay; exact dedup comes first in a pipeline. Texts are not shuffled but for the
    documents that go and the few that their ids' Bloom filter takes for them.
    """
    groups = simhash_groups(docs, id_column, text_column, size)
    lost = checkpointed(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("id"), F.lit(True).alias("lost")).distinct())
    rows = numbered(docs).withColumn("id", place(docs, id_column).cast("long"))
    return left_join_sparsely(rows, lost, "id").where("lost is null").drop("id", "lost").toDF(*docs.columns)
