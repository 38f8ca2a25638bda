"""Blocked Bloom filters as tables, built and probed by DataFrame expressions alone.

A key sets two bits of one block. The table has one row for each block and grows with the keys, BITS_PER_KEY for each. While it has at
most MAX_BITS it is broadcast, and rows are probed as they are read. A larger one is met by a shuffle on the block, in which rows
of a hot block spread (see `attach`); so callers probe rows without texts. What is done with members must be exact anyway."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.shared import attach, checkpointed

BLOCK_BITS = 1 << 15
BITS_PER_KEY = 16
#: Bits of a filter that is broadcast: 32 MB.
MAX_BITS = 1 << 28
#: Below so many bits a key, a filter of MAX_BITS lets too many rows through to be worth probing.
LEAST_BITS_PER_KEY = 4


@dataclass(frozen=True)
class Bloom:
    """blocks: block, words (64 bits each) and, if it is too large to be broadcast, n: its rows; count: the blocks that a key may fall into."""

    blocks: DataFrame
    count: int
    broadcast: bool


def _block(h: Column, count: int) -> Column:
    return F.pmod(F.xxhash64(h, F.lit(1)), F.lit(count))


def _bit(h: Column, k: int) -> Column:
    return F.pmod(F.xxhash64(h, F.lit(k)), F.lit(BLOCK_BITS)).cast("int")


def _words(bits: Column) -> Column:
    """A bitmap's bytes as signed longs, so that a bit is found by place instead of by text."""
    word = lambda i: F.conv(F.hex(F.substring(bits, i * 8 + 1, F.lit(8))), 16, -10).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), word)


def bloom(keys: DataFrame, key: Column, rows: int, least: int = 1, bits_per_key: int = BITS_PER_KEY) -> Bloom:
    """The filter of the bits that at least so many of the rows set. With least=2, a key that occurs twice is always a member.

    rows: about how many keys there are, which fixes the size."""
    count = max(1, -(-rows * bits_per_key // BLOCK_BITS))
    small = count * BLOCK_BITS <= max(MAX_BITS, BLOCK_BITS)
    hashed = keys.select(F.xxhash64(key).alias("h"))
    bits = hashed.select(_block(F.col("h"), count).alias("block"), F.explode(F.array(_bit(F.col("h"), 2), _bit(F.col("h"), 3))).alias("bit"))
    often = bits.groupBy("block", "bit").count().where(F.col("count") >= least)
    blocks = often.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).select("block", _words(F.col("bits")).alias("words"))
    if not small:
        blocks = blocks.join(hashed.groupBy(_block(F.col("h"), count).alias("block")).agg(F.count(F.lit(1)).alias("n")), "block")
    return Bloom(checkpointed(blocks), count, small)


def probed(rows: DataFrame, key: Column, found: Bloom, column: str) -> DataFrame:
    """rows with a boolean column: whether the key may be a member. False is certain."""
    h = F.xxhash64(key)

    def is_set(words: Column, k: int) -> Column:
        bit = _bit(h, k)
        # Words are read from their highest byte on, bytes from their lowest bit.
        at = F.lit(56) - F.shiftleft(F.pmod(F.shiftright(bit, 3), F.lit(8)), 3) + F.pmod(bit, F.lit(8))
        return F.coalesce(F.call_function("getbit", F.get(words, F.shiftright(bit, 6)), at) == F.lit(1), F.lit(False))

    if found.broadcast:
        table = found.blocks.select(F.col("block").alias("__block"), F.col("words").alias("__words"))
        words, joined = F.col("__words"), rows.join(F.broadcast(table), _block(h, found.count) == F.col("__block"), "left")
    else:
        words = F.col("found.words")
        joined = attach(rows.withColumn("__block", _block(h, found.count)), found.blocks.withColumnRenamed("block", "__block"), "__block", "n", F.monotonically_increasing_id())
    return joined.withColumn(column, is_set(words, 2) & is_set(words, 3)).drop(*(["__words", "__block"] if found.broadcast else ["__block", "found"]))


def left_join_sparsely(rows: DataFrame, table: DataFrame, key: str, keys: int | None = None) -> DataFrame:
    """rows left-joined with `table` by a key that both call alike, where most rows have no match.

    `table` has been written or checkpointed and has one row for each key. Rows whose key the table's filter excludes are passed on as
    they are read; only the others are shuffled. A table of so many keys that no filter of MAX_BITS tells them apart is joined
    by a shuffle of all rows. rows are read twice, and both readings must give the same keys to the same rows (see `identified`), without columns of the names used here: __block, __words, __maybe and found.
    keys: about how many rows the table has (0 for an empty one alone), where that is known."""
    keys = table.count() if keys is None else keys
    kinds = dict(table.dtypes)
    nulls = {c: F.lit(None).cast(kinds[c]) for c in table.columns if c != key}
    if not keys:
        return rows.withColumns(nulls)
    if keys * LEAST_BITS_PER_KEY > MAX_BITS:
        return rows.join(table, key, "left")
    per_key = max(LEAST_BITS_PER_KEY, min(BITS_PER_KEY, MAX_BITS // max(1, keys)))
    flagged = probed(rows, F.col(key), bloom(table, F.col(key), keys, 1, per_key), "__maybe")
    once = flagged.where(~F.col("__maybe")).drop("__maybe").withColumns(nulls)
    many = flagged.where("__maybe").drop("__maybe").join(table, key, "left")
    return once.unionByName(many.select(*once.columns))
