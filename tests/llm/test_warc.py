import base64
import gzip
import hashlib

import pytest

from tracemill.llm import warc
from tracemill.session import scratch_folder

SCHEMA = "page_id long, url string, html string, n int"


def expected(rows, least=0):
    by = {}
    for page_id, _, html, _ in rows:
        by.setdefault(html or "", []).append(page_id)
    out = []
    for page_id, _, html, _ in rows:
        raw = (html or "").encode()
        same = [p for p in by[html or ""] if p is not None]
        lead = max(same) if same and len(by[html or ""]) > 1 and len(raw) >= least else page_id
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page_id, len(raw), digest, "response" if lead == page_id else "revisit", None if lead == page_id else lead))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a.example/ä b", "<p>é" * 4000, 0),
    (2, "http://b.example/\r\nX: y", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", 0),
    (3, None, None, 0),
    (4, "u", "", 0),
    (5, "u", "<p>é" * 4000, 0),
    (5, "u", "<p>é" * 4000, 0),
    (6, "u", "x\n\n\n", 1),
    (None, "u", "x\n\n\n", 1),
    (None, "u", "alone", 1),
]


@pytest.mark.parametrize("chunk", [100, 1 << 20])
@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(spark, monkeypatch, chunk, least):
    monkeypatch.setattr(warc, "ROWS_PER_FILE", 3)
    folder = scratch_folder(spark, "warc")
    warc.write(spark.createDataFrame(ROWS, SCHEMA).coalesce(2), folder, least, chunk)
    got = warc.records(spark, folder).collect()
    assert all(r.intact for r in got)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == expected(ROWS, least)


def test_chunks_rebuild_payloads(spark):
    folder = scratch_folder(spark, "warc")
    warc.write(spark.createDataFrame(ROWS, SCHEMA), folder, 10, 100)
    parts = {}
    for r in warc.chunks(spark, folder).where("record_type = 'response' OR record_type IS NULL").collect():
        parts.setdefault(r.record_id, []).append((r.segment, r.chunk_no, bytes(r.data)))
        assert r.chunk_bytes <= 100
    texts = sorted(b"".join(d for *_, d in sorted(p)).decode() for p in parts.values())
    assert texts == sorted(["<p>é" * 4000, "<p>é" * 4000, ROWS[1][2], "", "", "x\n\n\n", "x\n\n\n", "alone"])


def foreign(version, kind, name, block, **more):
    fields = {"WARC-Type": kind, "warc-record-id": name, **more, "Content-Length": len(block)}
    return f"WARC/{version}\r\n".encode() + "".join(f"{k.replace('_', '-')}:{v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    """Both versions, all types, records of one segment that are longer than a chunk, members compressed one by one."""
    body = bytes(range(256)) * 40
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\ncontent-length: 10240\r\nX: y\r\n\r\n"
    made = [
        foreign("1.0", "warcinfo", "<urn:uuid:1>", b"software: none\r\n", Content_Type="application/warc-fields"),
        foreign("1.0", "request", "<urn:uuid:2>", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request"),
        foreign("1.0", "response", "<urn:uuid:3>", http + body, Content_Type="application/http; msgtype=response", WARC_Payload_Digest=f"sha1:{sha1}", WARC_Target_URI="http://x/"),
        foreign("1.1", "response", "<urn:uuid:4>", http + body[:-1], Content_Type="application/http;msgtype=response", WARC_Payload_Digest=f"sha1:{sha1}"),
        foreign("1.1", "resource", "<urn:uuid:5>", body, WARC_Block_Digest=f"sha1:{sha1}"),
        foreign("1.1", "metadata", "<urn:uuid:6>", b""),
        foreign("1.1", "response", "<urn:uuid:7>", b"no header at all", Content_Type="application/http"),
        foreign("1.1", "response", "<urn:uuid:8>", http + body[:5000], Content_Type="application/http", WARC_Segment_Number=1, WARC_Payload_Digest=f"sha1:{sha1}"),
        foreign("1.1", "continuation", "<urn:uuid:9>", body[5000:], WARC_Segment_Origin_ID="<urn:uuid:8>", WARC_Segment_Number=2, WARC_Segment_Total_Length=10240 + len(http)),
    ]
    (tmp_path / "crawl-0.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in made))
    got = {r.url or r.record_type: r for r in warc.records(spark, str(tmp_path)).where("record_type <> 'response' OR url IS NOT NULL").collect()}
    assert {k: (r.payload_bytes, r.intact) for k, r in got.items()} == {"warcinfo": (16, True), "request": (0, True), "http://x/": (10240, True), "resource": (10240, True), "metadata": (0, True)}
    assert got["http://x/"].payload_digest == got["resource"].payload_digest == sha1 and got["resource"].page_id is None
    rest = warc.records(spark, str(tmp_path)).where("record_type = 'response' AND url IS NULL").collect()
    assert sorted((r.payload_bytes, r.intact) for r in rest) == [(16, True), (10239, False), (10240, True)]
    chunks = warc.chunks(spark, str(tmp_path), chunk_bytes=1000).collect()
    assert max(r.chunk_bytes for r in chunks) == 1000
    for name in ("3", "5", "8"):
        own = sorted((r.segment, r.chunk_no, bytes(r.data), r.last) for r in chunks if r.record_id == f"<urn:uuid:{name}>")
        assert b"".join(x[2] for x in own) == body and [x[3] for x in own] == [False] * (len(own) - 1) + [True]
    assert {len(r.data) for r in chunks if r.record_id == "<urn:uuid:3>"} == {1000, 240}


def test_a_long_record_is_never_whole_in_memory():
    """200 MB of one record, read in a stream: what is held stays within a few chunks."""
    import tracemalloc

    def pieces():
        yield foreign("1.0", "resource", "<urn:uuid:1>", b"")[:-8].replace(b"Content-Length:0", b"Content-Length:%d" % (200 << 20)) + b"\r\n\r\n"
        for _ in range(200 << 4):
            yield bytes(1 << 16)
        yield b"\r\n\r\n"

    tracemalloc.start()
    n = sum(row[8] for row in warc._chunk_rows(pieces(), False))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 200 << 20 and most < 8 * warc.CHUNK_BYTES


def test_empty(spark):
    folder = scratch_folder(spark, "warc")
    warc.write(spark.createDataFrame([], SCHEMA), folder)
    assert warc.records(spark, folder).collect() == []
