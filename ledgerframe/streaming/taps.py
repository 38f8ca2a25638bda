"""Taps on streams: one snapshot for each micro-batch, and running counts that need no second pass."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ledgerframe.functions.types import is_missing, name
from ledgerframe.operators.trail import AuditTrail, audit_tap
from ledgerframe.sources.log import LabelTaken


def stream_tap(stream: DataFrame, trail: AuditTrail, label: str = "batch", sink: Callable[[DataFrame, int], None] | None = None, **tap: object) -> DataStreamWriter:
    """A writer of the stream that records a snapshot of each micro-batch, labelled label_<batch id>, and hands it on to `sink`.

    A batch that is repeated after a failure is recorded once. With a trail from `open_trail` that holds for a driver that is started again as
    well, and for one that is still at work beside it: the log takes a label once. The sink is called for a repeated batch, so it must itself be
    one that writes a batch once, by its number."""

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            if f"{label}_{number}" not in trail.labels:
                with contextlib.suppress(LabelTaken):
                    audit_tap(held, trail, f"{label}_{number}", **tap)
            if sink is not None:
                sink(held, number)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(each)


def observed(df: DataFrame, label: str, extra: Sequence[Column] = ()) -> tuple[DataFrame, Observation]:
    """df with counts (n_rows and na_<column>) that resolve when it is written as a whole; a limit further on would cut them short."""
    observation = Observation(label)
    counts = [F.count(F.lit(1)).alias("n_rows"), *[F.count_if(is_missing(name(f.name), f)).alias(f"na_{f.name}") for f in df.schema.fields]]
    return df.observe(observation, *counts, *extra), observation


def windowed_counts(stream: DataFrame, time_column: str, width: str, late: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows by event-time window (and columns): late rows are awaited for `late`, after which a window is final."""
    moment = F.col(time_column).cast("timestamp")
    timed = stream.withColumn("__time", moment).withWatermark("__time", late)
    return timed.groupBy(F.window("__time", width).alias("window"), *map(name, by)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")
