"""A trail as an append-only log, for writers that may be lost or may be several.

The log is a folder with one JSON file for each snapshot, called by its number; number 0 holds the trail's name. A snapshot is committed by putting the file of the
next number where none is yet. Who finds the number taken reads what has come and tries the next one, so two writers lose nothing, and a label that
has come meanwhile is not put in again. Readers list the folder: they see whole files only, since a file gets its number after it has been written.
Index and changes of a snapshot follow from its place in the log, not from what its writer had seen.

On local disks the number is given by a hard link, elsewhere by a rename that fails where the target exists, as on HDFS; an object store whose rename copies is no
place for a log with several writers."""

from __future__ import annotations

import dataclasses
import json
import os
import re
import uuid
from datetime import datetime
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ledgerframe.operators.trail import AuditTrail, Snapshot, changes_between
from ledgerframe.sources.serialize import iso, parsed_time, plain, snapshot_of

_ENTRY = re.compile(r"(\d{12})\.json")
_FRAMES = "frames"


class LabelTaken(ValueError):
    """The log has a snapshot of this label."""


class _Disk:
    """The folder on a disk of this machine."""

    def __init__(self, path: str) -> None:
        self.path = path
        os.makedirs(path, exist_ok=True)

    def names(self) -> list[str]:
        return os.listdir(self.path)

    def read(self, name: str) -> str:
        with open(os.path.join(self.path, name), encoding="utf-8") as source:
            return source.read()

    def put(self, name: str, text: str) -> bool:
        """Whether the file is there now by this call; False where it had been there before."""
        draft = os.path.join(self.path, f".{uuid.uuid4().hex}")
        with open(draft, "w", encoding="utf-8") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        try:
            os.link(draft, os.path.join(self.path, name))
        except FileExistsError:
            return False
        finally:
            os.remove(draft)
        return True


class _Hadoop:
    """The folder on any file system that Spark's Hadoop libraries know."""

    def __init__(self, path: str, spark: SparkSession) -> None:
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.files = self.jvm.org.apache.hadoop.fs
        self.path = self.files.Path(path)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.system = self.path.getFileSystem(conf)
        self.context = self.files.FileContext.getFileContext(self.system.getUri(), conf)
        self.system.mkdirs(self.path)

    def names(self) -> list[str]:
        return [status.getPath().getName() for status in self.system.listStatus(self.path)]

    def read(self, name: str) -> str:
        source = self.system.open(self.files.Path(self.path, name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def put(self, name: str, text: str) -> bool:
        """Whether the file is there now by this call; False where it had been there before."""
        draft, target = self.files.Path(self.path, f".{uuid.uuid4().hex}"), self.files.Path(self.path, name)
        out = self.system.create(draft, False)
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()
        try:
            # Without the option to overwrite.
            self.context.rename(draft, target, self.gateway.new_array(getattr(self.files, "Options$Rename"), 0))
        except Py4JJavaError as error:
            self.system.delete(draft, False)
            if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
        return True


class TrailLog:
    """The log in a folder; the folder is made where there is none."""

    def __init__(self, path: str, spark: SparkSession | None = None) -> None:
        self.path, self.spark = path.rstrip("/"), spark or SparkSession.active()
        system = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        local = system.getUri().getScheme() == "file"
        self._store = _Disk(self.path.removeprefix("file://").removeprefix("file:")) if local else _Hadoop(self.path, self.spark)
        self._known: dict[int, dict] = {}

    def entries(self) -> dict[int, dict]:
        """What is in the log by number; files that have been read are not read again, since none ever changes."""
        numbers = sorted(int(m[1]) for m in map(_ENTRY.fullmatch, self._store.names()) if m)
        for n in numbers:
            if n not in self._known:
                self._known[n] = json.loads(self._store.read(f"{n:012}.json"))
        return dict(sorted(self._known.items()))

    def begin(self, name: str, created_at: datetime) -> None:
        """Names the trail, where no writer has yet."""
        if 0 not in self.entries():
            self._put(0, {"name": name, "created_at": iso(created_at)})

    def commit(self, snapshot: Snapshot) -> int:
        """Appends the snapshot and returns its number. LabelTaken where its label is in the log, put in by whomever."""
        entry = None
        while True:
            found = self.entries()
            if any(e["label"] == snapshot.label for n, e in found.items() if n):
                raise LabelTaken(f"the trail already has a snapshot labelled {snapshot.label!r}")
            if entry is None:
                entry = plain(dataclasses.replace(snapshot, custom=self._with_frames_written(snapshot.custom), changes=None))
            number = max(found, default=0) + 1
            if self._put(number, {**entry, "index": number}):
                return number

    def trail(self) -> AuditTrail:
        """The whole trail. Customs that were frames are dictionaries; `frame` opens them."""
        return self.onto(AuditTrail("log"))

    def onto(self, trail: AuditTrail) -> AuditTrail:
        """The given trail with the log's name, date and snapshots in place of its own."""
        found = self.entries()
        if head := found.pop(0, None):
            trail.name, trail.created_at = head["name"], parsed_time(head["created_at"])
        trail.snapshots = []
        for entry in found.values():
            s = dataclasses.replace(snapshot_of(entry), index=len(trail.snapshots) + 1)
            trail.snapshots.append(dataclasses.replace(s, changes=changes_between(trail.snapshots[-1], s) if trail.snapshots else None))
        return trail

    def frame(self, value: dict) -> DataFrame:
        """The frame that was among a snapshot's customs, with all its rows."""
        return self.spark.read.parquet(f"{self.path}/{value['frame']}")

    def _with_frames_written(self, custom: dict | None) -> dict | None:
        """Customs with each frame written whole, as Parquet beside the entries; what reaches the driver is its columns."""
        if not custom:
            return custom
        out = {}
        for key, value in custom.items():
            if isinstance(value, DataFrame):
                where = f"{_FRAMES}/{uuid.uuid4().hex}"
                value.write.parquet(f"{self.path}/{where}")
                value = {"columns": value.columns, "frame": where}
            out[key] = value
        return out

    def _put(self, number: int, entry: dict[str, Any]) -> bool:
        return self._store.put(f"{number:012}.json", json.dumps(entry, ensure_ascii=False))


class LoggedTrail(AuditTrail):
    """A trail whose snapshots are in a log before a tap returns. What other writers have put in comes with each append."""

    def __init__(self, path: str, name: str | None = None, spark: SparkSession | None = None) -> None:
        super().__init__(name)
        self.log = TrailLog(path, spark)
        self.log.begin(self.name, self.created_at)
        self.log.onto(self)

    def append(self, snapshot: Snapshot) -> None:
        self.log.commit(snapshot)
        self.log.onto(self)


def open_trail(path: str, name: str | None = None, spark: SparkSession | None = None) -> LoggedTrail:
    """The trail of the log at `path`, to be read and gone on with; a new one, of this name, where there is none."""
    return LoggedTrail(path, name, spark)


def append_trail(trail: AuditTrail, path: str, spark: SparkSession | None = None) -> int:
    """Appends to the log the snapshots whose labels it doesn't have, and returns how many they were."""
    log, n = TrailLog(path, spark), 0
    log.begin(trail.name, trail.created_at)
    for s in trail.snapshots:
        try:
            log.commit(s)
            n += 1
        except LabelTaken:
            continue
    return n
