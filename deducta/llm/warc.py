"""WARC archives and their chunked record table.

``write_archives`` streams records into WARC 1.1 files in the shared folder, ``read_chunks`` streams
the files back as rows (record_id, chunk, ...) that carry incremental digests, and ``read_records``
is one row a record.  No step holds more of a payload than a chunk, apart from the source row itself.

* A null payload counts as empty.  Of equal payloads from ``LEAST`` bytes on, the row with the largest
  page_id is the response and the others revisit it; shorter payloads are all responses.
* Of rows with equal page_id and payload, each is a record; if they hold the group's largest
  page_id, all of them are responses (a record cannot revisit itself).
* A null page_id is written as an empty one and read back as null; it is the response only of a
  group without any other.
* A null url gives no WARC-Target-URI.  Other columns are not read, whatever their names.
* An empty table gives no archive and no row.

Scale: digests are shuffled, pre-aggregated, and groups of at least two are kept.  Up to ``BROADCAST``
groups go to the pages; beyond that, pages and groups meet in a join that Spark may split where one
group is large, which moves the payloads once.  A task writes one file and tells its name when it is complete, so a repeated task leaves an
unnamed file behind, never a second copy of a record.  Files are read
in byte order, without a seek.
"""

from __future__ import annotations

import hashlib
import uuid
from base64 import b16decode, b32decode, b32encode
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, shared_dir, staged

LEAST = 1000
CHUNK = 1 << 18
BROADCAST = 100_000  # groups of equal payloads, of some 60 bytes each, that are sent to every executor at most
_END = b"\r\n\r\n"
FILES = "path string, records long, bytes long"
CHUNKS = "record_id long, chunk int, last boolean, data binary, offset long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of any URI that pyarrow knows; s3a is s3."""
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1).replace("file:///", "/", 1) if path.startswith(("file:///", "s3a:")) else path)


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, sha1, size, record_type, refers_to) for every page."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.sha1(payload.cast("binary")).alias("sha1"),
        F.octet_length(payload).cast("long").alias("size"),
    )
    keys = rows.where(F.col("size") >= LEAST).groupBy("sha1", "size").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups, _ = bounded(keys.where("n > 1").select("sha1", "size", "first"), BROADCAST)
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return rows.join(groups, ["sha1", "size"], "left").select(
        "page_id",
        "url",
        F.when(again, F.lit("")).otherwise(F.col("payload")).cast("binary").alias("payload"),
        "sha1",
        "size",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def _head(page_id: int | None, url: str | None, sha1: str, size: int, kind: str, refers: int | None, stored: int) -> bytes:
    name = "" if page_id is None else page_id
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{b32encode(b16decode(sha1, True)).decode()}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if url:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers}>")
    lines.append(f"Content-Length: {stored}")
    return "\r\n".join(lines).encode() + _END


def _writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        path, records, size = f"{folder}/{uuid.uuid4().hex}.warc", 0, 0
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, _, sha1, n, kind, refers = (None if c == 2 else batch.column(c)[k].as_py() for c in range(7))
                data = memoryview(batch.column(2)[k].as_buffer() or b"")
                if out is None:
                    system, name = _open(path)
                    out = system.open_output_stream(name)
                head = _head(page_id, url, sha1, n, kind, refers, len(data))
                out.write(head)
                for at in range(0, len(data), CHUNK):
                    out.write(data[at : at + CHUNK])
                out.write(_END)
                records, size = records + 1, size + len(head) + len(data) + len(_END)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

    return write


def write_archives(records: DataFrame) -> DataFrame:
    """Write the planned records; (path, records, bytes) of every complete archive."""
    spark = records.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    system, name = _open(folder)
    system.create_dir(name, recursive=True)
    return staged(records.mapInArrow(_writer(folder), FILES), "archives")


class _Reader:
    """Lines and byte runs of a stream, through one bounded buffer."""

    def __init__(self, stream: pa.NativeFile):
        self.stream, self.held = stream, b""

    def head(self) -> list[str] | None:
        while _END not in self.held:
            more = self.stream.read(CHUNK)
            if not more:
                if self.held:
                    raise ValueError("the archive ends inside a record")
                return None
            self.held += more
        head, _, self.held = self.held.partition(_END)
        return head.decode().split("\r\n")

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, a chunk at a time."""
        while n:
            size = min(n, CHUNK)  # whole chunks, wherever the buffer ends, so that equal payloads have equal rows
            while len(self.held) < size:
                more = self.stream.read(CHUNK)
                if not more:
                    raise ValueError("the archive ends inside a payload")
                self.held += more
            part, self.held = self.held[:size], self.held[size:]
            n -= size
            yield part


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def parse_archive(stream: pa.NativeFile) -> Iterator[tuple]:
    """Chunk rows of an archive; the digest and length so far are those of the payload read back.

    A revisit stores no payload: its one row has the digest and length that it states.
    """
    reader = _Reader(stream)
    while (lines := reader.head()) is not None:
        if lines[0] != "WARC/1.1":
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        kind, size = fields["WARC-Type"], int(fields["Content-Length"])
        digest, done, n = hashlib.sha1(), 0, 0
        record, refers = _page(fields["WARC-Record-ID"]), _page(fields.get("WARC-Refers-To"))
        for data in reader.take(size) if size else iter((b"",)):
            digest.update(data)
            done += len(data)
            if kind == "revisit":
                yield record, n, True, data, 0, int(fields["X-Payload-Length"]), _bare(fields), kind, refers
            else:
                yield record, n, done == size, data, done - len(data), done, digest.hexdigest(), kind, refers
            n += 1
        if kind == "response" and digest.hexdigest() != _bare(fields):
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
        if b"".join(reader.take(len(_END))) != _END:
            raise ValueError("a record does not end with two line ends")


def _bare(fields: dict[str, str]) -> str:
    return b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()


def _chunk_reader(data: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    types = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = _open(path)
                with system.open_input_stream(name) as stream:
                    for row in parse_archive(stream):
                        if not data:
                            if not row[2]:
                                continue
                            row = (*row[:3], None, *row[4:])
                        rows.append(row)
                        held += len(row[3] or b"")
                        if len(rows) >= 5000 or held >= 16 * CHUNK:
                            yield batch_of(rows)
                            rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return read


def _spread(archives: DataFrame) -> DataFrame:
    n = max(1, archives.count())
    return archives.select("path").repartition(n)


def read_chunks(archives: DataFrame) -> DataFrame:
    """The chunked record table of the archives: payload bytes with their offset and digest so far."""
    return _spread(archives).mapInArrow(_chunk_reader(True), CHUNKS)


def read_records(archives: DataFrame) -> DataFrame:
    """One row a record: the last of its chunk rows, without the payload."""
    rows = _spread(archives).mapInArrow(_chunk_reader(False), CHUNKS)
    return rows.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page as a record, then read all archives back."""
    return read_records(write_archives(plan_records(pages)))
