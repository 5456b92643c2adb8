"""Legacy archives to WARC and back, against SQL and by hand."""

from __future__ import annotations

import base64
import gzip
import random
import time
import hashlib

import duckdb
import pytest

from tilewright.llm import archives
from tilewright.llm.common import shared_folder
from tilewright.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def record(line, body):
    return line + b" %d\n" % len(body) + body + b"\n"


V1 = (
    record(b"filedesc://x.arc 0.0.0.0 19990102030405 text/plain", b"1 0 Someone\nURL IP-address Archive-date Content-type Archive-length\n\nmeta\n")
    + record(b"http://a.example/with space 1.2.3.4 19990102 text/html; charset=x", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\npay\nload\r\n\r\nx")
    + record(b"dns:a.example 1.2.3.4 19990102030405 text/dns", b"1\n2\n3")
)
V2 = (
    record(b"filedesc://y.arc 0.0.0.0 2001 text/plain 200 - - 0 y.arc", b"2 0 Other\nline\n")
    + record(b"http://b.example/ 1.2.3.4 20010203040506 text/html 404 abc - 77 y.arc", b"x\n\n")
)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    df = QUERIES["op4_arc_to_warc"](spark, SF)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = sorted(map(str, (tuple(r) for r in df.select(names).collect())))
    assert got == sorted(map(str, con.execute(f"SELECT {', '.join(names)} FROM ({ORACLES['op4_arc_to_warc']})").fetchall()))


@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress])
def test_legacy_headers_and_lengths(pack):
    one = list(archives.read_arc(pack(V1)))
    assert [r.url for r in one] == ["filedesc://x.arc", "http://a.example/with space", "dns:a.example"]
    assert one[1].kind == "text/html; charset=x" and one[1].block.endswith(b"pay\nload\r\n\r\nx") and one[2].block == b"1\n2\n3"
    two = list(archives.read_arc(pack(V2)))
    assert [(r.version, r.block, r.date) for r in two] == [(2, b"2 0 Other\nline\n", "2001"), (2, b"x\n\n", "20010203040506")]


def test_bad_archives_are_errors():
    with pytest.raises(ValueError, match="ends inside"):
        list(archives.read_arc(V1[:-4]))
    with pytest.raises(ValueError, match="not an ARC"):
        list(archives.read_arc(b"what is this\n"))
    with pytest.raises(ValueError, match="version"):
        list(archives.read_arc(V2.replace(b"2 0 Other", b"7 0 Other")))


def test_synthesised_records():
    out = list(archives.read_warc(b"".join(archives.convert("x.arc.gz", V1, {}))))
    info, page, dns = out
    assert info[0]["warc-type"] == "warcinfo"
    fields, block = page
    assert fields["warc-type"] == "response" and fields["warc-date"] == "1999-01-02T00:00:00Z"
    payload = block.split(b"\r\n\r\n", 1)[1]
    assert fields["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert dns[0]["warc-type"] == "resource" and dns[1] == b"1\n2\n3"
    assert len({f["warc-record-id"] for f, _ in out}) == 3
    again = list(archives.read_warc(b"".join(archives.convert("x.arc.gz", V1, {list(archives.read_arc(V1))[1].offset: {"id": "<urn:uuid:1>", "url": "u", "date": "d"}}))))
    assert again[1][0]["warc-type"] == "revisit" and again[1][0]["warc-refers-to"] == "<urn:uuid:1>"
    assert again[1][1].endswith(b"\r\n\r\n") and again[1][0]["warc-payload-digest"] == fields["warc-payload-digest"]


def test_odd_pages(spark):
    rows = [
        (1, "http://x", "a"), (2, None, "a"), (3, "http://y z\n", None), (4, "u", ""), (None, "n", "a\r\n\r\nWARC/1.1\r\n"), (6, "é", "日本\x00"),
        (6, "é", "日本\x00"), (8, "big", "x" * 3_000_000), (9, "u", "HTTP/1.1 200 OK\r\n\r\nnested"),
    ]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload_digest string")
    folder = shared_folder(spark, "test-warc")
    got = archives.archive_pages(pages, folder, archive_bytes=500).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append((r.record_type, r.refers_to, r.payload_bytes))
    assert by[2] == [("response", None, 1)] and by[1] == [("revisit", 2, 1)]
    assert by[3] == [("revisit", 4, 0)] and by[4] == [("response", None, 0)]
    assert sorted(by[6], key=str) == [("response", None, 7), ("revisit", 6, 7)]
    assert by[8] == [("response", None, 3_000_000)] and by[None][0][0] == "response"
    back = {bytes(r.payload) for r in archives.read_warcs(spark, folder, with_payload=True).collect() if r.payload is not None}
    assert {(r[2] or "").encode() for r in rows} == back


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert archives.archive_pages(pages, shared_folder(spark, "test-warc")).count() == 0


def test_many_members_cost_their_size():
    """Members are inflated in parts, so a file of many is read in time linear in its size."""
    rng = random.Random(1)
    bodies = [rng.randbytes(rng.randrange(9000)) for _ in range(2000)] + [rng.randbytes(300_000), b""]
    head = gzip.compress(record(b"filedesc://x.arc 0.0.0.0 19990102030405 text/plain", b"1 0 Someone\n"))
    packed = head + b"".join(gzip.compress(record(b"http://a.example/ 1.2.3.4 19990102 text/html", b), 1) for b in bodies)
    start = time.process_time()
    assert [r.block for r in archives.read_arc(packed)][1:] == bodies
    assert time.process_time() - start < 5
    with pytest.raises(ValueError, match="ends inside"):
        list(archives.read_arc(packed[:-9]))
