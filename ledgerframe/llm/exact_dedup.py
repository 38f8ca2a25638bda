"""Exact dedup by two-pass Bloom filtering.

One pass over the texts writes each row's number, id and SHA-256 of the normalised text. The first pass over these sets two bits for each
digest in a blocked Bloom filter (bloom.py) that keeps only bits hit twice or more. The second probes it: a row whose two bits are
both set may be repeated and goes on to an exact grouping by its digest; any other cannot have an equal and passes straight
through, without a shuffle. Everything is a DataFrame expression.

Scale. The filter grows with the rows, so that the share of unique rows that are suspected stays below 2 %. It is broadcast up to 32 MB;
beyond that, rows of 48 bytes meet its blocks by shuffle. Texts are never shuffled for decisions; `drop_repeats` shuffles
those of documents that go. A group of copies collapses on the map side, and its answer comes back through `attach`, so that no task
gets a whole hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.bloom import bloom, left_join_sparsely, probed
from ledgerframe.llm.shared import attach, checkpointed, counted, identified, numbered, place, written

#: Any run of white space but a lone blank, which needs no change.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """text with each run of white space replaced by one blank; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _RUNS, " ")


def _digests(plain: DataFrame, rid: Column, id_: Column, text: Column) -> tuple[DataFrame, int]:
    """rid, id and sha of each row, written, and the number of rows."""
    sha = F.unhex(F.sha2(normalised(text).cast("binary"), 256))
    return counted(plain.select(rid.alias("rid"), id_.alias("id"), sha.alias("sha")), "digests")


def _suspected(slim: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows of slim (rid, id, sha; written) that cannot be repeated, and those that may be."""
    flagged = probed(slim, F.col("sha"), bloom(slim, F.col("sha"), rows, least=2), "suspect")
    return flagged.where("not suspect").drop("suspect"), written(flagged.where("suspect").drop("suspect"), "suspects")


def _decided(suspects: DataFrame) -> DataFrame:
    """The suspects (rid, id, sha) with keep (struct of the row that stays) and n."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("rid").alias("rid")))
    groups = checkpointed(suspects.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), first.alias("keep")).where("n > 1"))
    return attach(suspects, groups, "sha", "n", F.col("rid"))


def repeated(slim: DataFrame, rows: int) -> DataFrame:
    """rid and lost (true) of the rows of slim (rid, id, sha; written; about so many rows) that repeat the row that stays."""
    return checkpointed(_decided(_suspected(slim, rows)[1]).where("found.keep.rid <> rid").select("rid", F.lit(True).alias("lost")))


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (white space runs as one blank, null as empty) the row with the smallest id stays. A row without an id
    comes after all with one. Rows that repeat text and id alike: the first as read stays, so exactly one row of a group
    is kept. Extra columns of any name are not read. An empty table gives no rows. Texts are read once, and numbered in the same pass.
    """
    slim, rows = _digests(numbered(docs), F.monotonically_increasing_id(), place(docs, id_column), place(docs, text_column))
    once, suspects = _suspected(slim, rows)
    hexed = F.lower(F.hex("sha")).alias("text_sha256")
    once = once.select(F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), hexed)
    many = _decided(suspects)
    many = many.select(F.col("id").alias("doc_id"), F.when(F.col("found").isNull(), F.col("id")).otherwise(F.col("found.keep.id")).alias("keep_id"), F.coalesce("found.n", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("found.keep.rid") == F.col("rid"), F.lit(True)).alias("kept"), hexed)
    return once.unionByName(many)


def drop_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without the repeated rows that `exact_dedup` drops: null and empty texts are equal, one row of each group stays.

    Columns of any name are kept as they are; texts of any length are compared whole; an empty table stays empty. The second reading knows the rows
    by `identified`, so it may be split into tasks in another way than the first; the rows of docs themselves must be the same in both.
    """
    plain = identified(docs, "documents")
    lost = repeated(*_digests(plain, F.col("rid"), place(docs, id_column), place(docs, text_column)))
    marked = left_join_sparsely(plain, lost, "rid")
    return marked.where("lost is null").drop("rid", "lost").toDF(*docs.columns)
