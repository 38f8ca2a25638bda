"""WARC archives with revisit resolution.

Headers alone (row, id, payload digest) are shuffled by digest; of records with equal payloads the one with the
largest id is the response and every other becomes a revisit of it. The revisits, again headers alone, are joined to the
pages by row: pages that a Bloom filter of these clears are written as they are read, so that of the payloads only those
that go are shuffled. Deduplicated archives are written with fresh headers. The archives are text files of whole records,
written by Spark's own committer to any file system, so a lost task leaves no half record behind. A file has a number of records that
its class of sizes bounds, so that its bytes are bounded too; it is read back as a stream, record by record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerframe.llm.bloom import left_join_sparsely
from ledgerframe.llm.shared import attach, checkpointed, identified, place, written

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Classes of records by bytes of the payload (the last has all others), and the records that a file of the class has at most: 32 MB
#: each, but for payloads that are larger themselves.
FILES = ((1 << 16, 500), (1 << 20, 32), (None, 1))
#: Records, and about how many bytes of payloads, that a reader hands on together.
BATCH_RECORDS, BATCH_BYTES = 64, 1 << 22
DATE = "1970-01-01T00:00:00Z"

_READ = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload binary"


def payload_digest(payload: Column) -> Column:
    """SHA-1 in upper-case base32, from four groups of forty bits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), _HEX32, _BASE32)


def _headers(pages: DataFrame, id_column: str, url_column: str, html_column: str) -> DataFrame:
    at = lambda c: place(pages, c)
    html = F.coalesce(at(html_column).cast("string"), F.lit(""))
    rows = identified(pages, "pages").select(at(id_column).alias("id"), F.coalesce(at(url_column).cast("string"), F.lit("")).alias("url"), html.alias("html"), "rid")
    return rows.withColumns({"digest": payload_digest(F.col("html").cast("binary")), "bytes": F.octet_length("html").cast("long")})


def revisits(slim: DataFrame) -> DataFrame:
    """rid and refers_to (id of the response) of the headers (rid, id, digest; written) that revisit another record."""
    last = F.max(F.struct(F.col("id").alias("id"), F.col("rid").alias("rid")))
    groups = checkpointed(slim.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), last.alias("last")).where("n > 1"))
    found = attach(slim, groups, "digest", "n", F.col("rid")).where("found.last.rid <> rid")
    return found.select("rid", F.col("found.last.id").alias("refers_to"))


def write_archives(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", min_bytes: int = 0, files: tuple[tuple[int | None, int], ...] = FILES) -> None:
    """Writes one record for each row of pages: a response with its payload, or a revisit of the response with an equal payload.

    Of equal payloads (null as empty) of at least min_bytes bytes the row with the largest id is the response; of rows that
    repeat that id, one. A row without an id sorts before all others; its record has an empty id. Line breaks in a URL are
    escaped. Other columns are not read, whatever they are called; payloads of any length are written whole; an empty table gives an archive
    without records. Headers and records are read in passes of their own, in which `identified` knows the rows.
    """
    rows = _headers(pages, id_column, url_column, html_column)
    of_class = F.coalesce(*[F.when(F.lit(True) if most is None else F.col("bytes") <= most, F.lit(k)) for k, (most, _) in enumerate(files)])
    seen = Observation()
    slim = rows.observe(seen, *[F.count(F.when(of_class == k, True)).alias(f"n{k}") for k in range(len(files))])
    slim = written(slim.where(F.col("bytes") >= min_bytes).select("rid", "id", "digest"), "headers")
    again = checkpointed(revisits(slim).withColumn("again", F.lit(True)))
    rows = left_join_sparsely(rows, again, "rid").withColumn("again", F.coalesce("again", F.lit(False)))
    line = lambda key, value: F.concat(F.lit(key + ": "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("bytes").cast("string")), F.lit("\r\n"))
    block = F.concat(http, F.when(F.col("again"), F.lit("")).otherwise(F.col("html")))
    head = F.concat(
        F.lit(VERSION + "\r\n"),
        line("WARC-Type", F.when(F.col("again"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn("id")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("again"), F.concat(line("WARC-Refers-To", urn("refers_to")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    records = rows.withColumn("block", block).select(of_class.alias("class"), F.concat(head, F.col("block")).alias("value"))
    # One pass for each class that there is; the first is written in any case, so that there is an archive.
    for k, (_, most) in enumerate(files):
        if k == 0 or seen.get[f"n{k}"]:
            own = records.where(F.col("class") == k) if seen.get["n0"] < sum(seen.get.values()) else records
            own.select("value").write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def parse_archive(stream: BinaryIO) -> Iterator[tuple]:
    """The records of an archive: id, type, target, digest, the id referred to, payload length and payload (empty for revisits)."""
    bare = lambda urn: urn.removeprefix("<urn:page:").removesuffix(">")
    while first := stream.readline():
        if first.decode() != VERSION + "\r\n":
            raise ValueError(f"no record at byte {stream.tell() - len(first)}")
        head = dict(line.decode()[:-2].split(": ", 1) for line in iter(stream.readline, b"\r\n"))
        http, _, payload = stream.read(int(head["Content-Length"])).partition(END.encode())
        stream.read(len(END))
        size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "response" and (size != len(payload) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"the payload of {head['WARC-Record-ID']} is damaged")
        yield bare(head["WARC-Record-ID"]), head["WARC-Type"], head["WARC-Target-URI"], digest, bare(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None, size, payload


def _batches(records: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """The records of an archive as Arrow batches of bounded size."""
    names, kinds = [f.split()[0] for f in _READ.split(", ")], [*[pa.string()] * 5, pa.int64(), pa.binary()]
    rows: list[tuple] = []
    size = 0
    for record in records:
        rows.append(record)
        size += len(record[-1])
        if len(rows) == BATCH_RECORDS or size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives in a folder; lengths and digests of responses are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with gzip.open(io.BytesIO(content.as_buffer())) as stream:
                    yield from _batches(parse_archive(stream))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("content").mapInArrow(run, _READ)
