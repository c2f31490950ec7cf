"""WARC archives of pages, and the chunk rows that reading them gives.

Writing: a page becomes one record; payloads longer than ``CHUNK_BYTES`` are segmented as WARC 1.1 provides, the first
segment in the record itself and the rest in ``continuation`` records. Equal payloads are kept once: the page with the
largest id is the response, the others revisit it. Records are packed into rows of about ``CHUNK_BYTES``, and Spark
writes these rows as gzip files of at most ``ROWS_PER_FILE`` rows to the given folder, wherever that is.

Reading: archives of WARC 1.0 or 1.1, whoever wrote them, are inflated piece by piece; the payload of every record, of any type
and length, becomes chunk rows (record, segment, number, bytes) of at most ``CHUNK_BYTES`` with the SHA-1 of the payload so far.
No step holds more than two chunks beside the compressed file, whatever the length of a record. A record that goes on in another file
is digested in a second pass over its sorted chunk rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.session import broadcast_if_small, stored

CHUNK_BYTES = 1 << 20
ROWS_PER_FILE = 16
# A record or HTTP header of more bytes is none.
MOST_HEADER = 1 << 20
BROADCAST_ROWS = 200_000
# Pages carry no time; WARC asks for one.
DATE = "1970-01-01T00:00:00Z"
# Fixed value: the profile of the WARC 1.1 specification for payloads that were seen before.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNKS = (
    "record_id string, page_id long, url string, record_type string, refers_to long, segment int, chunk_no int, last boolean, chunk_bytes long, "
    "stated_digest string, stated_bytes long, digest_so_far string, data binary"
)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _safe(value: str) -> str:
    """A header value without control, blank or non-ASCII characters, which are percent-encoded."""
    return "".join(c if 0x21 <= ord(c) < 0x7F else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def _record(fields: dict[str, object], block: list[bytes]) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    length = sum(map(len, block))
    return b"".join((f"WARC/1.1\r\n{head}Content-Length: {length}\r\n\r\n".encode(), *block, b"\r\n\r\n"))


def _pieces(payload: memoryview, size: int) -> Iterator[memoryview]:
    """The payload in pieces of at most ``size`` bytes that do not cut a character; one empty piece if it is empty."""
    at = 0
    while True:
        end = min(len(payload), at + size)
        while end < len(payload) and payload[end] & 0xC0 == 0x80:
            end -= 1
        yield payload[at:end]
        at = end
        if at >= len(payload):
            return


def _records(page_id: int | None, url: str | None, payload: memoryview, refers_to: int | None, row: str, size: int, sha1: str) -> Iterator[bytes]:
    name = f"<urn:tracemill:page:{'none' if page_id is None else page_id}:{row}>"
    digest = f"sha1:{base32(bytes.fromhex(sha1))}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": name, "WARC-Date": DATE, "WARC-Target-URI": _safe(url or "urn:none"), "WARC-Payload-Digest": digest, "Content-Type": "application/http; msgtype=response"}
    if refers_to is not None:
        yield _record({**fields, "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<urn:tracemill:page:{refers_to}>"}, [http])
        return
    parts = list(_pieces(payload, size))
    for k, part in enumerate(parts, 1):
        many = len(parts) > 1
        if k == 1:
            yield _record({**fields, "WARC-Segment-Number": 1 if many else None}, [http, part])
        else:
            total = len(http) + len(payload) if k == len(parts) else None
            yield _record({"WARC-Type": "continuation", "WARC-Record-ID": f"{name[:-1]}:{k}>", "WARC-Date": DATE, "WARC-Segment-Origin-ID": name, "WARC-Segment-Number": k, "WARC-Segment-Total-Length": total, "WARC-Block-Digest": f"sha1:{base32(hashlib.sha1(part).digest())}"}, [part])


def write(pages: DataFrame, folder: str, least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html; other columns are not read) to ``folder``.

    The payload is the html in UTF-8, null as empty. Among rows with equal payloads of ``least_bytes`` or more, those
    with the largest page_id are responses and the others revisits; rows with a null page_id are revisits if any equal
    row has one. Repeated rows are written as often as they come. An empty table writes an empty archive.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    known = rows.select("page_id", "sha1", F.octet_length("payload").alias("n")).where(F.col("n") >= least_bytes)
    again = stored(known.groupBy("sha1").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").select("sha1", "first"))
    rows = rows.join(broadcast_if_small(again, BROADCAST_ROWS), "sha1", "left")
    rows = rows.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"), "sha1")

    def run(batches):
        held, waiting, number = [], 0, 0
        task = TaskContext.get()
        part = task.partitionId() if task else 0

        def row():
            # The writer ends each row with the line feed that is left off here.
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary()).view(pa.string())], ["value"])

        for batch in batches:
            for k in range(batch.num_rows):
                number += 1
                payload = memoryview(batch.column(2)[k].as_buffer())
                facts = [batch.column(c)[k].as_py() for c in (0, 1, 3, 4)]
                for record in _records(facts[0], facts[1], payload, facts[2], f"{part}-{number}", chunk_bytes, facts[3]):
                    held.append(record)
                    waiting += len(record)
                    if waiting >= chunk_bytes:
                        yield row()
                        held, waiting = [], 0
        if held:
            yield row()

    rows.mapInArrow(run, "value string").write.option("compression", "gzip").option("maxRecordsPerFile", ROWS_PER_FILE).text(folder)


def _inflated(blob: memoryview, step: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, in pieces."""
    inflate = zlib.decompressobj(31)
    for at in range(0, len(blob), step):
        rest = blob[at : at + step]
        while rest:
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            if piece := inflate.decompress(rest, 4 * step):
                yield piece
            rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
    if piece := inflate.flush():
        yield piece


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by their lower-case names."""
    parts = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in parts}


def parsed(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str] | None, bytes]]:
    """The records of an archive that comes in pieces: (header fields, b"") and then (None, part) for the parts of its block."""
    buffer, at = bytearray(), 0

    def more() -> bool:
        nonlocal at
        piece = next(pieces, None)
        if piece is None:
            return False
        del buffer[:at]
        at = 0
        buffer.extend(piece)
        return True

    while True:
        while buffer.startswith(b"\r\n", at) or len(buffer) - at < 2 and more():
            at += 2 * buffer.startswith(b"\r\n", at)  # a record is followed by blank lines
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if len(buffer) - at > MOST_HEADER:
                raise ValueError("a record header does not end")
            if not more():
                if buffer[at:].strip():
                    raise ValueError("an archive ends within a record header")
                return
        head = bytes(buffer[at:end])
        if not head.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")):
            raise ValueError(f"no record begins with {head[:40]!r}")
        fields = _fields(head)
        at, left = end + 4, int(fields["content-length"])
        yield fields, b""
        while left:
            if at == len(buffer) and not more():
                raise ValueError("an archive ends within a record")
            part = bytes(memoryview(buffer)[at : at + left])
            at += len(part)
            left -= len(part)
            yield None, part


class _Record:
    """A record's payload on its way into chunk rows."""

    def __init__(self, fields: dict[str, str], before: _Record | None) -> None:
        self.kind = fields.get("warc-type", "unknown").lower()
        self.more = self.kind == "continuation"
        self.segment = int(fields.get("warc-segment-number", 1))
        self.ends = "warc-segment-total-length" in fields if self.more else "warc-segment-number" not in fields
        self.name = fields["warc-segment-origin-id" if self.more else "warc-record-id"]
        self.number, self.held = 0, bytearray()
        # The header of the HTTP response is no part of the payload.
        self.http = bytearray() if not self.more and fields.get("content-type", "").lower().startswith("application/http") else None
        if self.more:
            # Digested only if the segments before it stand just before it.
            self.digest = before.digest if before is not None and before.name == self.name else None
            self.facts = (None,) * 4
            self.stated = self.size = None
            return
        self.digest = hashlib.sha1()
        page, other = (re.match(r"<urn:tracemill:page:(-?\d+)\b", fields.get(f"warc-{c}", "")) for c in ("record-id", "refers-to"))
        self.facts = (int(page[1]) if page else None, fields.get("warc-target-uri"), self.kind, int(other[1]) if other else None)
        digest = fields.get("warc-payload-digest", "" if self.http is not None else fields.get("warc-block-digest", ""))
        self.stated = digest[5:].upper() if digest.lower().startswith("sha1:") else None
        self.size = None if self.http is not None or not self.ends else int(fields["content-length"])

    def take(self, part: bytes) -> None:
        if self.http is None:
            self.held += part
            return
        self.http += part
        end = self.http.find(b"\r\n\r\n")
        if end >= 0:
            length = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", self.http[:end])
            self.size = int(length[1]) if length else None
            self.held += self.http[end + 4 :]
            self.http = None
        elif len(self.http) > MOST_HEADER:
            self.held, self.http = self.http, None

    def rows(self, data: bool, size: int, end: bool = False) -> Iterator[tuple]:
        """The full chunks so far; at the ``end`` of the record what is left, at least one chunk."""
        if end and self.http is not None:
            self.held, self.http = self.http, None
        while len(self.held) > size or end and (self.held or not self.number):
            block = bytes(memoryview(self.held)[:size])
            del self.held[:size]
            self.number += 1
            if self.digest is not None:
                self.digest.update(block)
            last = end and self.ends and not self.held
            so_far = base32(self.digest.digest()) if self.digest is not None else None
            yield self.name, *self.facts, self.segment, self.number, last, len(block), self.stated, self.size, so_far, block if data else None


def _chunk_rows(pieces: Iterator[bytes], data: bool, size: int = CHUNK_BYTES) -> Iterator[tuple]:
    now = None
    for fields, part in parsed(pieces):
        if fields is not None:
            if now is not None:
                yield from now.rows(data, size, True)
            now = _Record(fields, now)
        else:
            now.take(part)
            yield from now.rows(data, size)
    if now is not None:
        yield from now.rows(data, size, True)


_CHUNK_KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
_CHUNK_NAMES = [x.split()[0] for x in CHUNKS.split(", ")]


def chunks(spark: SparkSession, folder: str, data: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk rows of all archives in ``folder``, see CHUNKS; facts of the record are in its first chunk alone if the
    record goes on in another file, and ``digest_so_far`` is null there. Without ``data`` the bytes are left out."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows, held = [], 0
                for row in _chunk_rows(_inflated(memoryview(batch.column(0)[k].as_buffer())), data, chunk_bytes):
                    rows.append(row)
                    held += row[8] if data else 100
                    if held >= chunk_bytes:
                        yield _as_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _as_batch(rows)

    # Spark's reader hands over a compressed file as one value, so a file has at most 2 GB.
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return archives.mapInArrow(run, CHUNKS)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), _CHUNK_KINDS)], _CHUNK_NAMES)


def records(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, intact.

    For responses and other records size and digest come from the bytes read, and ``intact`` says that they are what the record states,
    as far as it does; revisits have those stated for the payload that they refer to. Records that this module did not write
    have a null page_id.
    """
    seen = stored(chunks(spark, folder, data=False).drop("data"))
    first = lambda c: F.max(F.when((F.col("segment") == 1) & (F.col("chunk_no") == 1), F.col(c))).alias(c)
    facts = ("page_id", "url", "record_type", "refers_to", "stated_digest")
    whole = seen.groupBy("record_id").agg(
        *[first(c) for c in facts], F.max("stated_bytes").alias("stated_bytes"), F.sum("chunk_bytes").alias("read_bytes"), F.max(F.when(F.col("last"), F.col("digest_so_far"))).alias("digest")
    )
    whole = stored(whole)
    if whole.where("digest IS NULL").limit(1).count():
        parted = whole.where("digest IS NULL").select("record_id")
        whole = whole.join(_digests(chunks(spark, folder).join(parted, "record_id", "left_semi")), "record_id", "left")
        whole = whole.withColumn("digest", F.coalesce("digest", "later")).drop("later")
    revisit = F.col("record_type") == "revisit"
    return whole.select(
        "page_id", "url", F.when(revisit, F.col("stated_bytes")).otherwise(F.col("read_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("digest")).alias("payload_digest"), "record_type", "refers_to",
        (revisit | ((F.col("digest") == F.coalesce("stated_digest", "digest")) & (F.col("read_bytes") == F.coalesce("stated_bytes", "read_bytes")))).alias("intact"),
    )


def _digests(rows: DataFrame) -> DataFrame:
    """(record_id, later): SHA-1 over the chunk rows of each record, streamed in order."""

    def run(batches):
        name, digest = None, None
        for batch in batches:
            done = []
            for record_id, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                if record_id != name:
                    if name is not None:
                        done.append((name, base32(digest.digest())))
                    name, digest = record_id, hashlib.sha1()
                digest.update(part.as_buffer())
            yield _pairs(done)
        if name is not None:
            yield _pairs([(name, base32(digest.digest()))])

    order = ["record_id", "segment", "chunk_no"]
    ordered = rows.select("data", *order).repartition("record_id").sortWithinPartitions(*order)
    return ordered.select("record_id", "data").mapInArrow(run, "record_id string, later string")


def _pairs(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string()) for c in (0, 1)], ["record_id", "later"])
