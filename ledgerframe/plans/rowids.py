"""Numbers of rows that come from the files they lie in.

A row of a Parquet file has a place in it that no split of the file changes. Files in the order of their paths, with a prefix sum over their rows, number all
rows from 1 without ordering, shuffling or keeping any: what is counted by file comes from a scan of no columns, and the table of the files' first numbers is
broadcast while there are at most FILES of them. Lost or added executors change how files are split, but no number."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Files whose first numbers (a path and a long each) are broadcast.
FILES = 50_000


def _columns_of_files(df: DataFrame) -> tuple[Column, Column] | None:
    """The path and the place of each row of a frame that is whole Parquet files, or columns made from theirs; None for any other."""
    node = df._jdf.queryExecution().analyzed()
    if not node.deterministic():
        return None
    while node.nodeName() in ("Project", "SubqueryAlias"):
        node = node.children().head()
    # A path that is given twice is listed once, and its rows can't be told apart.
    if node.nodeName() != "LogicalRelation" or len(node.relation().location().inputFiles()) != len(df._jdf.inputFiles()):
        return None
    try:
        hidden = df.metadataColumn("_metadata")
        path, place = hidden["file_path"], hidden["row_index"]
        df.select(path, place)
    except AnalysisException:
        return None
    return path, place


def file_numbered(df: DataFrame, names: list[str], number: str) -> DataFrame | None:
    """df with its columns called by names and its rows' numbers from 1 in a further one: by file path, then place in the file. None where df is no plain read of
    Parquet files (a filter, join or any other step after the read)."""
    found = _columns_of_files(df)
    if found is None:
        return None
    path, place = found
    rows = df.select("*", path, place).toDF(*names, "__path", "__place")
    sizes = df.select(path.alias("__file")).groupBy("__file").agg(F.count(F.lit(1)).alias("__rows"))
    # One row for each file.
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__file", before.alias("__before"))
    few = len(df._jdf.inputFiles()) <= FILES
    placed = rows.join(F.broadcast(starts) if few else starts, F.col("__path") == F.col("__file"))
    return placed.select(*names, (F.col("__place") + F.col("__before") + 1).alias(number))
