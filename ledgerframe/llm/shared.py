"""What the training-data operators share: the shared folder, written tables and a join that holds under skew."""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A key is heavy when it holds more than one part in so many of all rows; so there are fewer heavy keys than this.
HEAVY_PARTS = 1000

_LOCAL_ROOT = "/tmp/checkpoints"

#: Values of an Arrow batch that are Python objects at a time.
SLICE = 256


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """An Arrow batch in parts of SLICE rows, so that few of its texts are Python objects at once."""
    return (batch.slice(i, SLICE) for i in range(0, batch.num_rows, SLICE))


def name(column: str) -> Column:
    """The column of exactly this name, dots and blanks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def numbered(docs: DataFrame) -> DataFrame:
    """docs with its columns called c0, c1 and so on, so that no name of theirs meets one that is used here, in either case."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def place(docs: DataFrame, column: str) -> Column:
    """A column of docs, in `numbered(docs)`."""
    return F.col(f"c{docs.columns.index(column)}")


def _deleted_at_exit(spark: SparkSession, path: str) -> None:
    """Has the path deleted when the driver ends: by its JVM, or where that has gone, as a folder of this machine."""
    context = spark.sparkContext

    def clean() -> None:
        try:
            hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(context._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the session may have been stopped by then
            shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)

    atexit.register(clean)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Where the setting is absent, a local master gets a folder of its own, which goes when the driver ends; any other has no
    folder that is sure to be shared, and is told so.
    """
    root, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not root and not context.getCheckpointDir():
        if not (context.master.startswith("local[") or context.master == "local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(_LOCAL_ROOT)
        _deleted_at_exit(spark, context.getCheckpointDir())
    if root and not context.getCheckpointDir():
        # Set while the session was running, so that Spark itself has not seen it.
        context.setCheckpointDir(root)
    return (root or context.getCheckpointDir()).rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    _deleted_at_exit(spark, path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of df, written once as Parquet in the shared folder and read again: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, label: str, figure: Column) -> tuple[DataFrame, int]:
    """`written(df, label)` and an aggregate of its rows (0 where that is null), from the same pass."""
    seen = Observation()
    table = written(df.observe(seen, figure.alias("figure")), label)
    return table, int(seen.get["figure"] or 0)


def counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """`written(df, label)` and its number of rows (about right where tasks were repeated: a figure for sizes; 0 of an empty table alone)."""
    return observed(df, label, F.count(F.lit(1)))


def checkpointed(df: DataFrame) -> DataFrame:
    """df, cut from its lineage by a reliable checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


#: What `identified` calls a row by.
RID = "struct<file:bigint,row:bigint>"


#: Plans that pass the rows of their one child on, each once at most.
_PLAIN = ("Project", "Filter", "SubqueryAlias")


def _is_plain_scan(docs: DataFrame) -> bool:
    """Whether docs are rows of files, each of them once at most, by a plan that makes the same of them in every scan."""
    node = docs._jdf.queryExecution().analyzed()
    if not node.deterministic():
        return False
    while node.nodeName() in _PLAIN:
        node = node.children().head()
    return node.nodeName() == "LogicalRelation" and len(node.relation().location().inputFiles()) == len(docs._jdf.inputFiles())


def identified(docs: DataFrame, label: str) -> DataFrame:
    """`numbered(docs)` with rid: what tells each row apart, and stays the same in every scan, however its rows are dealt to tasks.

    A row of Parquet files is called by its file (a hash of the path) and its place there, which no split of the files changes; the files are
    read again. Rows of any other frame are numbered and written once, and read back with their numbers."""
    names = [*(f"c{i}" for i in range(len(docs.columns))), "rid"]
    try:
        if _is_plain_scan(docs):
            hidden = docs.metadataColumn("_metadata")
            return docs.select("*", F.struct(F.xxhash64(hidden["file_path"]).alias("file"), hidden["row_index"].alias("row")).alias("rid")).toDF(*names)
    except AnalysisException:
        pass
    return written(numbered(docs).withColumn("rid", F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))), label)


def attach(rows: DataFrame, table: DataFrame, key: str, weight: str, salt: Column, total: int | None = None) -> DataFrame:
    """rows, left-joined with `table`, which has one row for each key and has been written or checkpointed.

    `weight` is the column of `table` that counts the rows of its key. Keys that hold more than 1/HEAVY_PARTS of all
    rows are fewer than HEAVY_PARTS whatever the size of the input, so that part of the table is broadcast; rows of
    those keys are spread by `salt` and never meet in one task. All other keys are joined by shuffle.
    The result has the columns of rows and a struct `found` (null where there is no match).
    total: the number of all rows, about; where it is not given, a pass over `table` sums their weights.
    """
    if total is None:
        total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    values = F.struct(*[c for c in table.columns if c != key])
    heavy = table.where(F.col(weight) * F.lit(HEAVY_PARTS) > F.lit(total)).select(F.col(key).alias("__hk"), values.alias("__hv"))
    light = table.where(F.col(weight) * F.lit(HEAVY_PARTS) <= F.lit(total)).select(F.col(key).alias("__lk"), values.alias("__lv"), F.lit(0).cast("long").alias("__ls"))
    out = rows.join(F.broadcast(heavy), F.col(key) == F.col("__hk"), "left")
    out = out.withColumn("__salt", F.when(F.col("__hk").isNotNull(), F.lit(1) + F.abs(F.xxhash64(salt) % F.lit(1 << 20))).otherwise(F.lit(0)).cast("long"))
    out = out.join(light, (F.col(key) == F.col("__lk")) & (F.col("__salt") == F.col("__ls")), "left")
    return out.withColumn("found", F.coalesce("__hv", "__lv")).drop("__hk", "__hv", "__lk", "__lv", "__ls", "__salt")
