"""Packing by concatenate and cut.

Documents, each closed by an end id, are laid end to end and cut every SEQUENCE ids. The first pass writes the ids with
each document's place inside its partition and so fixes the partitions' totals. A prefix sum over these totals, in two
levels, gives each partition its global offset. The second pass turns offsets into fixed windows: a document that crosses
a boundary leaves a piece on either side of it. Only totals (one number a partition) are shuffled, never ids.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ledgerframe.llm.bpe import PATTERN, STEADY, SpeculativeBpe
from ledgerframe.llm.shared import checkpointed, name, sliced, written

SEQUENCE = 2048
END_ID = 1
#: Characters between blanks that merging by ranks gets at most; it is slow on longer words.
LONG_WORD = 2000
#: Bytes of ids that are handed on together.
CHUNK_BYTES = 1 << 22
#: Partitions whose totals one task adds up on the first level of the prefix sum.
FAN = 4096
#: Partitions whose offsets (16 bytes each) are broadcast at most; those of more are joined by shuffle.
BROADCAST_PARTITIONS = 1_000_000

_LAID = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])


class LibraryEncoder:
    """Texts to the ids of the tokenizers library, by the quickest way that is sure to give them.

    Merging by ranks gives the library's ids if each token of the vocabulary is what its own bytes merge to, which is verified
    when the vocabulary is read, and if both split words alike: in scripts whose classes all Unicode versions share. Other texts,
    special tokens and overlong words go through the library itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        bpe = SpeculativeBpe(path)
        self._special = tuple(bpe.special)
        ranks = {token: i for i, token in enumerate(bpe.bytes_of) if i not in bpe.special.values()}
        ordered = all(bpe.id_of.get(token) == i for token, i in ranks.items()) and bool((np.diff(bpe.rank[bpe.rank >= 0]) > 0).all())
        self._ranked = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ordered else None

    def ids(self, text: str) -> bytes:
        plain = self._ranked is not None and (text.isascii() or STEADY.fullmatch(text) is not None)
        if plain and not any(s in text for s in self._special) and max(map(len, text.split(" "))) <= LONG_WORD:
            return self._ranked.encode_to_numpy(text).astype("<u4", copy=False).tobytes()
        return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[list[bytes]]:
        """The ids of texts, in chunks of bounded size and in order."""
        chunk, size = [], 0
        for text in texts:
            chunk.append(self.ids(text))
            size += len(chunk[-1]) + 1
            if size > CHUNK_BYTES:
                yield chunk
                chunk, size = [], 0
        if chunk:
            yield chunk


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def laid_out(docs: DataFrame, vocabulary_path: str, id_column: str, text_column: str, end_id: int) -> DataFrame:
    """First pass: doc_id, part, at (ids before the document in its partition), n and ids, closed by end_id."""
    close = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = library_encoder(vocabulary_path), TaskContext.get().partitionId(), 0
        for batch in (part for whole in batches for part in sliced(whole)):
            keys, texts, done = batch.column(0), [t or "" for t in batch.column(1).to_pylist()], 0
            for chunk in encoder.encode(texts):
                ids = [b + close for b in chunk]
                size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                ends = np.cumsum(size)
                yield pa.RecordBatch.from_arrays([keys.slice(done, len(ids)), pa.array(np.full(len(ids), part, np.int32)), pa.array(at + ends - size), pa.array(size), pa.array(ids, pa.binary())], schema=_arrow)
                done, at = done + len(ids), at + int(ends[-1])

    _arrow = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
    return docs.select(name(id_column).cast("long"), name(text_column).cast("string")).mapInArrow(run, _LAID)


def partition_offsets(totals: DataFrame) -> DataFrame:
    """part, total and base: the sum of the totals of all partitions before it. totals: part, total."""
    band = Window.partitionBy("band").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = totals.withColumn("band", (F.col("part") / FAN).cast("int")).withColumn("inside", F.coalesce(F.sum("total").over(band), F.lit(0)))
    # One row for each FAN partitions: few enough for one task at any size.
    bands = inside.groupBy("band").agg(F.sum("total").alias("band_total"))
    before = F.coalesce(F.sum("band_total").over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return inside.join(bands.select("band", before.alias("start")), "band").select("part", "total", (F.col("inside") + F.col("start")).alias("base"))


def pack(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, padded (of the sequence) and ids (binary).

    Documents stand in the order in which they are read. Every sequence but the last is full; the last is padded to `sequence`
    unless its length is a power of two. A null or empty text is its end id alone; repeated rows are packed each; other
    columns are not read; an empty table has no pieces. Texts of any length are packed whole, over as many sequences as needed.
    """
    laid = written(laid_out(docs, vocabulary_path, id_column, text_column, end_id), "packing")
    offsets = checkpointed(partition_offsets(laid.groupBy("part").agg(F.sum("n").alias("total"))))
    ends, few = offsets.agg(F.coalesce(F.max(F.col("base") + F.col("total")), F.lit(0)), F.count(F.lit(1)) <= BROADCAST_PARTITIONS).first()
    tail = ends % sequence
    last, padded = ends // sequence, tail if tail & (tail - 1) == 0 else sequence
    # One row of two numbers for each input partition; broadcast while that is small by count.
    placed = laid.join(F.broadcast(offsets) if few else offsets, "part").withColumn("begin", F.col("base") + F.col("at")).withColumnRenamed("n", "doc_tokens")
    window = F.expr(f"sequence(begin div {sequence}, (begin + doc_tokens - 1) div {sequence})")

    def piece(k):
        first = F.greatest(F.col("begin"), k * F.lit(sequence))
        length = F.least(F.col("begin") + F.col("doc_tokens"), (k + F.lit(1)) * F.lit(sequence)) - first
        start = first - F.col("begin")
        ids = F.substring("ids", (start * 4 + 1).cast("int"), (length * 4).cast("int"))
        return F.struct(start.alias("start"), length.alias("length"), k.alias("sequence_id"), (first - k * F.lit(sequence)).alias("offset"), ids.alias("ids"))

    pieces = placed.select("doc_id", "doc_tokens", F.explode(F.transform(window, piece)).alias("p"))
    pad = F.when(F.col("p.sequence_id") == F.lit(last), F.lit(padded)).otherwise(F.lit(sequence)).cast("long")
    return pieces.select("doc_id", "p.start", "p.length", "doc_tokens", "p.sequence_id", "p.offset", pad.alias("padded"), "p.ids")
