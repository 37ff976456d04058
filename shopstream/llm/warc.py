"""Operator 9, WARC archives as a chunked record table.

Writing: pages with equal payloads become one response record and revisit records that refer to it. Each
task streams its records into archives (one gzip member for each record) in the shared folder, under
names that no other attempt uses, and returns their paths; only archives whose task succeeded are read.

Reading: each archive is streamed record by record. A payload comes out as rows of record identifier and
chunk number, each with the digest and the byte count up to its end; no record is held whole.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, salted_join, stored

CHUNK, ARCHIVE_BYTES, BLOCK = 65_536, 64_000_000, 1 << 18
RECORD = "<urn:x-page:{}>"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """(page_id, url, payload, payload_bytes, sha1, refers_to): refers_to is the smallest identifier with the same payload, null for that page itself and for payloads under least_bytes."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload")).withColumn("same", F.struct("sha1", "payload_bytes"))
    first = rows.groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("same.payload_bytes") >= least_bytes)).drop("n")
    rows = salted_join(rows, first, "same", "left", by="page_id")  # a third of all pages may be copies of one
    return rows.select("page_id", "url", "payload", "payload_bytes", "sha1", F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def _header(lines: list[tuple[str, str | None]], first: str) -> bytes:
    return "".join([f"{first}\r\n", *(f"{k}: {v}\r\n" for k, v in lines if v is not None), "\r\n"]).encode()


def record_heads(page_id: int | None, url: str | None, n_bytes: int, sha1: str, refers_to: int | None) -> tuple[bytes, bytes]:
    """WARC header and the HTTP header that starts its block. The HTTP header gives the full payload's size in revisits too."""
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(n_bytes))], "HTTP/1.1 200 OK")
    target = None if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    revisit = refers_to is not None
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", RECORD.format("" if page_id is None else page_id)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", target),
        ("WARC-Refers-To", RECORD.format(refers_to) if revisit else None), ("WARC-Profile", PROFILE if revisit else None), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + (0 if revisit else n_bytes))),
    ]
    return _header(lines, "WARC/1.1"), http


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes all pages and returns (path, records, bytes) of the archives, stored.

    Null payloads are empty ones; a null url leaves out the target header. Pages with equal payloads of
    at least least_bytes: the smallest identifier is the response (rows that repeat it too), the others
    revisits; a null identifier is never the smallest unless it is the only one. Without rows there are
    no archives.
    """
    folder = folder or new_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = pyarrow.fs.FileSystem.from_uri(folder)
        out, path, written, records = None, None, 0, 0

        def manifest() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([records], pa.int64()), "bytes": pa.array([written], pa.int64())})

        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, _, n_bytes, sha1, refers_to = (batch.column(c)[k].as_py() if c != 2 else None for c in range(6))
                if out is None:
                    files.create_dir(at)
                    name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    path, out, written, records = f"{folder}/{name}", files.open_output_stream(f"{at}/{name}", compression=None), 0, 0
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                payload = memoryview(batch.column(2)[k].as_buffer()) if refers_to is None else memoryview(b"")
                parts = [*record_heads(page_id, url, n_bytes, sha1, refers_to), *(payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK)), b"\r\n\r\n"]
                for piece in (*map(packer.compress, parts), packer.flush()):
                    if piece:
                        out.write(piece)
                        written += len(piece)
                records += 1
                if written >= ARCHIVE_BYTES:
                    yield manifest()
                    out = None
        if out is not None:
            yield manifest()

    rows = revisits(pages, id_col, url_col, payload_col, least_bytes)
    return stored(rows.mapInArrow(run, "path string, records long, bytes long"), "archives")


class Inflated:
    """The bytes of a file of gzip members, read in blocks; holds what the last request left over."""

    def __init__(self, stream):
        self.stream, self.packer, self.rest, self.buffer = stream, None, b"", bytearray()

    def more(self) -> bool:
        while True:
            if not self.rest:
                self.rest = self.stream.read(BLOCK)
                if not self.rest:
                    return False
            if self.packer is None:
                self.packer = zlib.decompressobj(31)
            got = self.packer.decompress(self.rest, BLOCK)
            self.rest = self.packer.unconsumed_tail
            if self.packer.eof:
                self.rest, self.packer = self.packer.unused_data, None
            if got:
                self.buffer += got
                return True

    def head(self) -> list[str] | None:
        """Lines of the header that comes next, None at the end."""
        while (end := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.buffer.strip():
                    raise ValueError("an archive ends within a header")
                return None
        lines = bytes(self.buffer[:end]).decode().split("\r\n")
        del self.buffer[: end + 4]
        return lines

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.more():
                raise ValueError("an archive ends within a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def _fields(lines: list[str]) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in lines[1:])


def _page_of(uri: str | None) -> int | None:
    digits = uri[len("<urn:x-page:") : -1] if uri else ""
    return int(digits) if digits else None


CHUNKS = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("chunk", pa.int64()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("last", pa.bool_())])


def chunks(path: str, size: int = CHUNK) -> Iterator[tuple]:
    """Rows of the chunk table of an archive; a record without a payload in the archive has one row of no data."""
    files, at = pyarrow.fs.FileSystem.from_uri(path)
    with files.open_input_stream(at, compression=None) as stream:
        source = Inflated(stream)
        while (lines := source.head()) is not None:
            if lines[0] != "WARC/1.1":
                raise ValueError(f"not a WARC record: {lines[0][:40]}")
            fields = _fields(lines)
            left = int(fields["Content-Length"])
            http = source.head()
            n_bytes = int(_fields(http)["Content-Length"])
            left -= sum(len(x.encode()) + 2 for x in http) + 2
            declared = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            digest, done, k = hashlib.sha1(), 0, 0
            record = (_page_of(fields["WARC-Record-ID"]), fields["WARC-Type"], fields.get("WARC-Target-URI"), _page_of(fields.get("WARC-Refers-To")), n_bytes)
            while True:
                data = source.take(min(size, left - done))
                digest.update(data)
                done += len(data)
                last = done == left
                if last and fields["WARC-Type"] == "response" and (done != n_bytes or base64.b32encode(digest.digest()).decode() != declared):
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
                yield (*record, declared, k, data, done, digest.hexdigest(), last)
                k += 1
                if last:
                    break
            if source.take(4) != b"\r\n\r\n":
                raise ValueError("a record has no end")


def read_archives(archives: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunk table: page_id, record_type, url, refers_to, payload_bytes and payload_digest of the record, then chunk number, data, bytes_so_far, sha1_so_far and whether it is the record's last. No archives give no rows; a damaged one fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in chunks(path, size):
                    rows.append(row)
                    held += len(row[7])
                    if held > 4_000_000 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), CHUNKS, strict=True)], schema=CHUNKS)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), CHUNKS, strict=True)], schema=CHUNKS)

    n = max(1, min(10_000, archives.count()))
    return archives.select("path").repartition(n, "path").mapInArrow(run, "page_id long, record_type string, url string, refers_to long, payload_bytes long, payload_digest string, chunk long, data binary, bytes_so_far long, sha1_so_far string, last boolean")
