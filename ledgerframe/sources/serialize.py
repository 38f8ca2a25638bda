"""Trails as dictionaries, frames and files.

"spark" is the native form: Parquet rows with nested types, on any file system that Spark knows. "json" is one file in full
precision, where lists stay lists. "log" appends to a folder of snapshots what it doesn't have (`sources/log.py`). All come back as equal trails."""

from __future__ import annotations

import dataclasses
import json
import os
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession

from ledgerframe.operators.trail import AuditTrail, Changes, Snapshot, check_trail

_SUMMARY = "array<struct<column:string,min:double,q25:double,median:double,mean:double,q75:double,max:double>>"
SNAPSHOT_SCHEMA = (
    "label string, index int, timestamp timestamp, type string, nrow bigint, ncol int, all_columns array<string>, "
    f"schema array<struct<column:string,type:string,n_na:bigint>>, total_nas bigint, numeric_summary {_SUMMARY}, diagnostics string, pipeline array<string>, "
    "changes struct<row_delta:bigint,col_delta:int,na_delta:bigint,cols_added:array<string>,cols_removed:array<string>,type_changes:array<struct<column:string,from:string,to:string>>>, "
    "custom string, controls struct<numeric_summary:boolean,cols_include:array<string>,cols_exclude:array<string>>, trail_name string, created_at timestamp"
)
FIELDS = [f.name for f in dataclasses.fields(Snapshot)]
_FORMATS = {".json": "json", ".parquet": "spark", ".trail": "spark", ".log": "log"}

#: Rows of a frame among a snapshot's customs that are written with it.
FRAME_ROWS = 10_000


def iso(t: datetime) -> str:
    return t.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def parsed_time(text: str) -> datetime:
    return datetime.strptime(text, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc)


def plain(value: Any) -> Any:
    """A value as JSON can hold it."""
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return {f.name: plain(getattr(value, f.name)) for f in dataclasses.fields(value) if not isinstance(getattr(value, f.name), DataFrame)}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, Row):
        return plain(value.asDict())
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if isinstance(value, DataFrame):
        return _frame(value)
    if isinstance(value, datetime):
        return iso(value)
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def _frame(df: DataFrame) -> dict:
    """columns, n_rows and rows of a frame; with more than FRAME_ROWS rows, rows is None (a log keeps such frames whole)."""
    rows = df.limit(FRAME_ROWS + 1).collect()
    if len(rows) > FRAME_ROWS:
        return {"columns": df.columns, "n_rows": df.count(), "rows": None}
    return {"columns": df.columns, "n_rows": len(rows), "rows": [[plain(v) for v in r] for r in rows]}


def trail_to_list(trail: AuditTrail) -> dict:
    """name, created_at, n_snapshots and the snapshots by label, as plain values in order."""
    check_trail(trail)
    return {"name": trail.name, "created_at": iso(trail.created_at), "n_snapshots": len(trail), "snapshots": {s.label: plain(s) for s in trail.snapshots}}


def snapshot_of(entry: dict) -> Snapshot:
    """The snapshot that `plain` has made a dictionary."""
    values = {f: entry.get(f) for f in FIELDS}
    values["timestamp"] = parsed_time(values["timestamp"])
    values["changes"] = Changes(**values["changes"]) if values["changes"] else None
    return Snapshot(**values)


def list_to_trail(data: dict) -> AuditTrail:
    """The trail that trail_to_list has made plain."""
    trail = AuditTrail(data["name"])
    trail.created_at = parsed_time(data["created_at"])
    for entry in data["snapshots"].values():
        trail.append(snapshot_of(entry))
    return trail


def _row(trail: AuditTrail, s: Snapshot) -> dict:
    data = {f: getattr(s, f) for f in FIELDS}
    data["changes"] = plain(s.changes)
    for f in ("diagnostics", "custom"):
        data[f] = None if data[f] is None else json.dumps(plain(data[f]))
    return data | {"trail_name": trail.name, "created_at": trail.created_at}


def trail_to_df(trail: AuditTrail, spark: SparkSession) -> DataFrame:
    """One row for each snapshot, with nested columns; diagnostics and custom are JSON; trail_name and created_at repeat. Typed even when empty."""
    check_trail(trail)
    columns = [*FIELDS, "trail_name", "created_at"]
    return spark.createDataFrame([tuple(_row(trail, s)[c] for c in columns) for s in trail.snapshots], SNAPSHOT_SCHEMA)


def df_to_trail(df: DataFrame, name: str | None = None) -> AuditTrail:
    """The trail that trail_to_df has made a frame; a trail has few snapshots, so they fit the driver."""
    rows = sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: r["index"])
    trail = AuditTrail(rows[0]["trail_name"] if rows else name)
    aware = lambda t: t.astimezone(timezone.utc)
    if rows:
        trail.created_at = aware(rows[0]["created_at"])
    for r in rows:
        values = {f: r[f] for f in FIELDS} | {"timestamp": aware(r["timestamp"]), "changes": Changes(**r["changes"]) if r["changes"] else None}
        for f in ("diagnostics", "custom"):
            values[f] = None if r[f] is None else json.loads(r[f])
        trail.append(Snapshot(**values))
    return trail


def detect_format(file: str, format: str | None) -> str:
    found = format or _FORMATS.get(os.path.splitext(file.rstrip("/"))[1].lower())
    if found not in ("json", "spark", "log"):
        raise ValueError("format must be 'json', 'spark' or 'log', or the file's extension .json, .parquet, .trail or .log")
    return found


def write_trail(trail: AuditTrail, file: str, format: str | None = None, spark: SparkSession | None = None) -> AuditTrail:
    """Writes a trail, in the format given or that of the file's extension, and returns it."""
    check_trail(trail)
    kind = detect_format(file, format)
    if kind == "log":
        from ledgerframe.sources.log import append_trail

        append_trail(trail, file, spark)
        return trail
    if kind == "json":
        with open(file, "w", encoding="utf-8") as out:
            json.dump(trail_to_list(trail), out, indent=2, ensure_ascii=False)
        return trail
    spark = spark or SparkSession.active()
    frame = trail_to_df(trail, spark)
    if not trail.snapshots:
        # One row without a label holds the name of an empty trail.
        frame = spark.createDataFrame([(None,) * len(FIELDS) + (trail.name, trail.created_at)], SNAPSHOT_SCHEMA)
    frame.coalesce(1).write.mode("overwrite").parquet(file)
    return trail


def read_trail(file: str, format: str | None = None, spark: SparkSession | None = None) -> AuditTrail:
    """Reads what write_trail has written."""
    kind = detect_format(file, format)
    if kind == "log":
        from ledgerframe.sources.log import TrailLog

        return TrailLog(file, spark).trail()
    if kind == "json":
        if not os.path.exists(file):
            raise FileNotFoundError(f"no such file: {file}")
        with open(file, encoding="utf-8") as source:
            return list_to_trail(json.load(source))
    rows = (spark or SparkSession.active()).read.schema(SNAPSHOT_SCHEMA).parquet(file)
    trail = df_to_trail(rows.where("label is not null"))
    if not trail.snapshots and (first := rows.first()):
        trail = AuditTrail(first.trail_name)
        trail.created_at = first.created_at.astimezone(timezone.utc)
    return trail
