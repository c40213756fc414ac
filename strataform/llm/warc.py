"""WARC archives as a table of payload chunks.

Writing: each task turns its rows into WARC 1.1 records and cuts the stream of
an archive into segments of a bounded size, which Spark writes to the shared
folder, so that task retries and lost executors are Spark's to settle.

Reading: the segments of an archive are streamed in order through a small state
machine. A payload leaves it as chunk rows: record id, chunk number, bytes, and
the SHA-1 of the payload up to that chunk. No record is ever whole in memory;
a task holds one segment, one chunk, and the WARC head of one record, however
long its url is. The HTTP head is passed over as it comes; a record that has no
blank line within its length is all head, its payload empty.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from strataform.llm.common import written

SEGMENT_BYTES = 1 << 18
ARCHIVE_BYTES = 1 << 23
CHUNK_BYTES = 1 << 16
SEGMENTS = "archive string, part long, bytes binary"
CHUNKS = "archive string, record_id string, row_id long, uri string, chunk int, bytes binary, payload_so_far long, digest_so_far string, last boolean"
_SEGMENT_SCHEMA = pa.schema([("archive", pa.string()), ("part", pa.int64()), ("bytes", pa.binary())])
_CHUNK_SCHEMA = pa.schema(
    [("archive", pa.string()), ("record_id", pa.string()), ("row_id", pa.int64()), ("uri", pa.string()), ("chunk", pa.int32()), ("bytes", pa.binary()), ("payload_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_())]
)
_BLANK = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_bytes(record_id: str, row_id: int | None, uri: str | None, payload: bytes) -> list[bytes]:
    """A response record: WARC head, HTTP head, payload, end."""
    lines = [
        "WARC/1.1",
        "WARC-Type: response",
        f"WARC-Record-ID: <{record_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base32_sha1(hashlib.sha1(payload).digest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(_HTTP) + len(payload)}",
    ]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if row_id is not None:
        lines.append(f"WARC-X-Row-ID: {row_id}")
    return ["\r\n".join(lines).encode() + b"\r\n\r\n", _HTTP, payload, b"\r\n\r\n"]


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", gzip: bool = False) -> DataFrame:
    """A WARC record for each row, as segments: archive, part, bytes.

    Null payloads are empty ones; null ids and urls leave out their field.
    Repeated rows are records of their own. With gzip each record is a member
    of its own. Other columns aren't read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("row_id"), F.col(url_col).cast("string").alias("uri"), F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))

    def segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        archive, part, done, n = 0, 0, 0, 0
        held = bytearray()

        def out(size: int) -> pa.RecordBatch:
            nonlocal part
            piece = bytes(held[:size])
            del held[:size]
            part += 1
            return pa.record_batch([[f"{task}-{archive}"], [part - 1], [piece]], schema=_SEGMENT_SCHEMA)

        for batch in batches:
            for i in range(batch.num_rows):
                row_id, uri, payload = (batch.column(c)[i].as_py() for c in range(3))
                pieces = record_bytes(f"urn:x-record:{task}:{n}", row_id, uri, payload)
                n += 1
                if gzip:
                    packer = zlib.compressobj(wbits=31)
                    pieces = [*map(packer.compress, pieces), packer.flush()]
                for piece in pieces:
                    held += piece
                    done += len(piece)
                    while len(held) >= SEGMENT_BYTES:
                        yield out(SEGMENT_BYTES)
                if done >= ARCHIVE_BYTES:
                    if held:
                        yield out(len(held))
                    archive, part, done = archive + 1, 0, 0
        if held:
            yield out(len(held))

    return rows.mapInArrow(segments, SEGMENTS)


class ChunkReader:
    """Takes the bytes of an archive piece by piece and gives chunk rows."""

    def __init__(self, archive: str, chunk_bytes: int):
        self.archive, self.size = archive, chunk_bytes
        self.held = bytearray()
        self.state = "head"
        self.sought = 0
        self.unzip = None
        self.first = True

    def feed(self, piece: bytes) -> Iterator[tuple]:
        if self.first and piece:
            self.first = False
            self.zipped = piece[:2] == b"\x1f\x8b"
        if self.zipped:
            for plain in self._members(piece):
                self.held += plain
                yield from self._step()
        else:
            self.held += piece
            yield from self._step()

    def _members(self, piece: bytes) -> Iterator[bytes]:
        while piece:
            self.unzip = self.unzip or zlib.decompressobj(wbits=31)
            yield self.unzip.decompress(piece, SEGMENT_BYTES)
            while self.unzip.unconsumed_tail:
                yield self.unzip.decompress(self.unzip.unconsumed_tail, SEGMENT_BYTES)
            piece = self.unzip.unused_data
            if self.unzip.eof:
                self.unzip = None

    def _head(self) -> bytes | None:
        at = self.held.find(_BLANK, self.sought)
        if at < 0:
            self.sought = max(0, len(self.held) - 3)
            return None
        head = bytes(self.held[:at])
        del self.held[: at + 4]
        self.sought = 0
        return head

    def _passed_http(self) -> bool:
        """Drop the HTTP head as far as it is here; whether that was all of it."""
        at = self.held.find(_BLANK, 0, self.left)
        ended = at >= 0 or len(self.held) >= self.left
        size = at + 4 if at >= 0 else self.left if ended else max(0, len(self.held) - 3)
        del self.held[:size]
        self.left -= size
        return ended

    def _row(self, size: int) -> tuple:
        piece = bytes(self.held[:size])
        del self.held[:size]
        self.left -= size
        self.seen += size
        self.sha.update(piece)
        self.number += 1
        return (self.archive, self.record_id, self.row_id, self.uri, self.number - 1, piece, self.seen, base32_sha1(self.sha.digest()), self.left == 0)

    def _step(self) -> Iterator[tuple]:
        while True:
            if self.state == "head":
                while self.held[:2] == b"\r\n":
                    del self.held[:2]
                head = self._head()
                if head is None:
                    return
                version, *lines = head.decode("utf-8", "replace").split("\r\n")
                if not version.startswith("WARC/"):
                    raise ValueError(f"archive {self.archive}: no record where one is due")
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                self.record_id = fields.get("warc-record-id", "").strip("<>")
                self.row_id = int(fields["warc-x-row-id"]) if "warc-x-row-id" in fields else None
                self.uri = fields.get("warc-target-uri")
                self.left, self.seen, self.number, self.sha = int(fields["content-length"]), 0, 0, hashlib.sha1()
                self.kind = fields.get("warc-type", "")
                http = fields.get("content-type", "").startswith("application/http")
                self.state = "http" if http and self.kind == "response" else "payload"
            elif self.state == "http":
                if not self._passed_http():
                    return
                self.state = "payload"
            else:
                while self.left > self.size and len(self.held) >= self.size:
                    yield self._row(self.size)
                if self.left > self.size or len(self.held) < self.left:
                    return
                yield self._row(self.left)
                self.state = "head"

    def close(self) -> None:
        if self.state != "head" or bytes(self.held).strip(b"\r\n"):
            raise ValueError(f"archive {self.archive} ends within a record")


def read_chunks(segments: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of archives that are given as segments.

    Every record has at least one chunk, an empty one for an empty payload; its
    last chunk has the length and the digest of the whole payload. An archive
    that ends within a record, or that has no record where one is due, fails.
    """

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: ChunkReader | None = None
        rows: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.record_batch([list(c) for c in zip(*rows)], schema=_CHUNK_SCHEMA)

        for batch in batches:
            for i in range(batch.num_rows):
                archive, piece = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                if reader is None or reader.archive != archive:
                    if reader is not None:
                        reader.close()
                    reader = ChunkReader(archive, chunk_bytes)
                for row in reader.feed(piece):
                    rows.append(row)
                    size += len(row[5])
                    if size >= 1 << 22 or len(rows) >= 4096:
                        yield out()
                        rows, size = [], 0
        if reader is not None:
            reader.close()
        if rows:
            yield out()

    ordered = segments.select("archive", "part", "bytes").repartition("archive").sortWithinPartitions("archive", "part")
    return ordered.mapInArrow(chunks, CHUNKS)


def revisit_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the rows as archives, read them back, and name each record response or revisit.

    Of the records with equal payloads of at least ``min_bytes`` bytes those
    with the smallest id are responses and the others revisit it (refers_to);
    smaller ones are all responses. Null payloads are empty. Rows without an id
    are revisits if a record with an id has their payload, else responses.
    Repeated rows stay; an empty table gives an empty one.
    """
    segments = written(write_archives(pages, id_col, url_col, payload_col), "warc")
    ends = read_chunks(segments).where("last").select(F.col("row_id").alias(id_col), F.col("payload_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"))
    ends = written(ends, "warc-records")
    first = ends.where(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("__digest"), F.col("payload_bytes").alias("__bytes")).agg(F.min(id_col).alias("__first"))
    # written, so that the join is of plain tables, whose large keys adaptive execution splits
    first = written(first, "warc-first")
    own = F.col("__first").isNull() | F.col(id_col).eqNullSafe(F.col("__first"))
    joined = ends.join(first, (ends.payload_digest == F.col("__digest")) & (ends.payload_bytes == F.col("__bytes")), "left")
    return joined.select(
        id_col,
        "payload_bytes",
        "payload_digest",
        F.when(own, "response").otherwise("revisit").alias("record_type"),
        F.when(~own, F.col("__first")).alias("refers_to"),
    )
