"""WARC archives: a writer of one gzip member a record, and a sequential reader.

The reader takes an archive as a stream of small chunks.  An incremental zlib decompressor ends with each
gzip member; inside a member the version line and headers end at the first empty line, ``Content-Length``
frames the block, and CRLF CRLF closes the record.  Block and payload digests (SHA-256, bare hexadecimal
after the label) are computed while reading and compared.  Memory holds one record at most.

Of records with equal payloads of ``least`` bytes or more, the one with the smallest page_id is a
``response``; others are ``revisit`` records of the identical-payload-digest profile: their block is the HTTP
head alone, whose Content-Length still tells the size of the payload, and WARC-Refers-To names the response.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import decided, filesystem, fresh_dir, numbered, skew_join, stash, tidy, write_decisions

VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 16
#: An archive is closed once it has this many bytes.
ARCHIVE_BYTES = 64 << 20
NO_ID = b"none"


def _urn(page_id: int | None) -> bytes:
    return b"<urn:page:" + (NO_ID if page_id is None else str(page_id).encode()) + b">"


def _of_urn(urn: bytes | None) -> int | None:
    number = urn[len(b"<urn:page:") : -1] if urn else NO_ID
    return None if number == NO_ID else int(number)


def _clean(value: str | None) -> bytes:
    """A header's value: no line can end in it."""
    return b" ".join((value or "").encode("utf-8", "replace").split()) or b"about:blank"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit if ``refers_to`` is given."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = [
        VERSION,
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: " + _urn(page_id),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Target-URI: " + _clean(url),
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
        b"WARC-Block-Digest: sha256:" + hashlib.sha256(block).hexdigest().encode(),
        *([] if refers_to is None else [b"WARC-Refers-To: " + _urn(refers_to), b"WARC-Profile: " + PROFILE]),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class BadRecord(ValueError):
    """A record whose framing or digest is wrong."""


def members(stream: BinaryIO) -> Iterator[bytes]:
    """The content of each gzip member of ``stream``, inflated chunk by chunk."""
    rest = b""
    while True:
        inflate, out, begun = zlib.decompressobj(31), [], False
        while not inflate.eof:
            if not rest:
                rest = stream.read(CHUNK)
                if not rest:
                    if begun:
                        raise BadRecord("the archive ends inside a gzip member")
                    return
            begun = True
            try:
                out.append(inflate.decompress(rest))
            except zlib.error as e:
                raise BadRecord(f"no gzip member: {e}") from e
            rest = inflate.unused_data
        yield b"".join(out)


def headers(data: bytes) -> tuple[dict[bytes, bytes], int]:
    """The headers of a record or of an HTTP message, by lower-case name, and where what follows them begins."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise BadRecord("the headers do not end")
    found = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise BadRecord("a header line without a colon")
        found[name.strip().lower()] = value.strip()
    return found, end + 4


def read_records(stream: BinaryIO) -> Iterator[tuple[int | None, int, str, str, int | None, bytes]]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of each record, verified.

    The payload of a revisit is empty here; its size and digest are those of the full payload."""
    for data in members(stream):
        if not data.startswith(b"WARC/1."):
            raise BadRecord("no WARC version line")
        head, at = headers(data)
        length = int(head[b"content-length"])
        block = data[at : at + length]
        if len(block) != length or data[at + length :] != b"\r\n\r\n":
            raise BadRecord("Content-Length does not frame the block")
        if head.get(b"warc-block-digest", b"").partition(b":")[2] != hashlib.sha256(block).hexdigest().encode():
            raise BadRecord("the block's digest differs")
        kind, digest = head[b"warc-type"].decode(), head[b"warc-payload-digest"].partition(b":")[2].decode()
        http, begin = headers(block)
        size, payload = int(http[b"content-length"]), block[begin:]
        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise BadRecord("the payload's size or digest differs")
        yield _of_urn(head[b"warc-record-id"]), size, digest, kind, _of_urn(head.get(b"warc-refers-to")), payload


def plan_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, url, payload binary, refers_to) for each row of ``pages`` (page_id, url, html; other columns are not looked at).

    Null html is an empty payload; html of any length is one record.  Rows that repeat the smallest page_id of a payload are
    all responses; a null page_id comes last, and where no copy has an id all are responses, as nothing could be referred to.
    An empty table has no records.  Only ids, sizes and digests are brought together; what follows from them goes to the
    pages as decisions.  ``pages`` must be a stored table or one that comes out the same each time."""
    page_id, payload = F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    rows = numbered(pages, (row := f"row_{uuid.uuid4().hex}")).select(F.col(row).alias("row"), page_id, "url", payload)
    known = stash(rows.where(F.octet_length("payload") >= least).select("row", "page_id", F.unhex(F.sha2("payload", 256)).alias("digest")), "digests")
    again = known.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 AND first IS NOT NULL")
    refers = skew_join(known, again, "digest", "copies", known.count()).where(~F.col("page_id").eqNullSafe(F.col("first")))
    folder = write_decisions(refers.select("row", F.col("page_id").alias("doc_id"), F.col("first").alias("n")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = decided(folder)
        for b in batches:
            n, there = find(b.column(0).to_numpy(), b.column(4).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[1:4], pa.array(n, mask=~there)], ["page_id", "url", "payload", "refers_to"])

    return rows.withColumn("key", F.xxhash64("page_id")).mapInArrow(tidy(each), "page_id long, url string, payload binary, refers_to long")


def write_archives(records: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records to archives in ``folder``; the table (archive, records, bytes) of those that count.

    Every attempt of a task writes files of its own name, and the returned table, written to the shared folder,
    lists those of the attempts that ended well: a lost executor costs a rerun, never a torn archive."""
    folder = folder or fresh_dir(records.sparkSession, "warc")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        out, name, n, size, number = None, "", 0, 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for b in batches:
            for page_id, url, payload, refers_to in (tuple(c[i].as_py() for c in b.columns) for i in range(b.num_rows)):
                if out is None:
                    name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                    out, n, size, number = fs.open_output_stream(f"{base}/{name}", compression=None), 0, 0, number + 1
                out.write(data := record(page_id, url, payload, hashlib.sha256(payload).hexdigest(), refers_to))
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return stash(records.select("page_id", "url", "payload", "refers_to").mapInArrow(tidy(each), "archive string, records long, bytes long"), "archives")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives listed in ``archives`` (archive), read one after another in each file."""
    schema = READ + (", payload binary" if payloads else "")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 if payloads else 5]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[: len(names)], types, strict=False)], names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = filesystem(path)
                with fs.open_input_stream(at, compression=None) as stream:
                    rows: list[tuple] = []
                    size = 0
                    for r in read_records(stream):
                        rows.append(r)
                        size += len(r[5]) if payloads else 0
                        if len(rows) == 2000 or size > 8 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch(rows)

    return archives.select("archive").repartition(max(1, min(archives.count(), 20_000))).mapInArrow(each, schema)
