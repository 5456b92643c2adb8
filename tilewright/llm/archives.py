"""Legacy web archives (ARC, versions 1 and 2) to WARC 1.1.

Archives are files in shared storage, one gzip member per record. A record's declared length, not
its content, says where it ends. What ARC lacks is made up for the WARC: record ids from the place
in the archive, ISO dates, record types, and SHA-1 digests of block and payload.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import cut, drop_folder, read_files, read_shared, shared_folder, write_shared
from tilewright.operators.skew import salted_join

#: An archive is closed when it holds so many compressed bytes.
ARCHIVE_BYTES = 8 << 20
#: Compression of a record; higher levels take twice the time for a few hundredths of the size. Legacy
#: archives of pages are read twice and dropped.
LEVEL, LEGACY_LEVEL = 4, 1
#: Bytes of an archive that are inflated at a time.
PART_BYTES = 1 << 16
#: Archives that one task converts.
TASK_ARCHIVES = 4
#: Payloads of fewer bytes never become revisits.
MIN_PAYLOAD = 0
PAGE_HEADER = b"X-Page-Id"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Header lines of an ARC file by version, fixed by the format.
DEFINITIONS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: The same lines as patterns. A legacy url or type may hold a space, so the rest anchors them.
LINES = {
    1: re.compile(rb"(.+) (\S+) (\d{4,17}) (.*) (\d+)$", re.S),
    2: re.compile(rb"(.+) (\S+) (\d{4,17}) (.*) (\S+) (\S+) (\S+) (\S+) (\S+) (\d+)$", re.S),
}


class Record(NamedTuple):
    offset: int
    version: int
    url: str
    ip: str
    date: str
    kind: str
    block: bytes


class Stream:
    """Reads lines and counts of bytes from a file of gzip members, or a plain one."""

    def __init__(self, content: bytes) -> None:
        self.content, self.next, self.held, self.from_, self.at = memoryview(content), 0, bytearray(), 0, 0
        self.packed, self.member = content[:2] == b"\x1f\x8b", None

    def _more(self) -> bool:
        """Take in a bounded part of what is left, so that a member costs no more than its own size."""
        if self.next >= len(self.content):
            if self.member:
                raise ValueError("archive ends inside a record")
            return False
        part = self.content[self.next : self.next + PART_BYTES]
        self.next += len(part)
        if self.packed:
            self.member = self.member or zlib.decompressobj(31)
            part = self.member.decompress(part)
            if self.member.eof:
                self.next -= len(self.member.unused_data)
                self.member = None
        # What has been read goes only now and then.
        del self.held[: self.from_]
        self.from_ = 0
        self.held += part
        return True

    def read(self, n: int) -> bytes:
        while len(self.held) - self.from_ < n and self._more():
            pass
        if len(self.held) - self.from_ < n:
            raise ValueError("archive ends inside a record")
        out = bytes(memoryview(self.held)[self.from_ : self.from_ + n])
        self.from_ += n
        self.at += n
        return out

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        looked = 0
        while (end := self.held.find(b"\n", self.from_ + looked)) < 0:
            looked = len(self.held) - self.from_
            if not self._more():
                break
        if end < 0:
            if self.from_ == len(self.held):
                return None
            end = len(self.held) - 1
        return self.read(end + 1 - self.from_).rstrip(b"\r\n")


def text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def read_arc(content: bytes) -> Iterator[Record]:
    """Records of an ARC file; the first, which describes the file, says the version."""
    stream, version = Stream(content), None
    while (offset := stream.at) >= 0 and (line := stream.line()) is not None:
        if not line.strip():
            continue  # records are parted by an empty line
        if version is None:
            found = LINES[1].match(line) or LINES[2].match(line)
        else:
            found = LINES[version].match(line)
        if not found:
            raise ValueError(f"not an ARC record line: {line[:80]!r}")
        block = stream.read(int(found[found.re.groups]))
        if version is None:
            version = int(block.split(b" ", 1)[0])
            if version not in LINES:
                raise ValueError(f"unknown ARC version {version}")
        yield Record(offset, version, text(found[1]), text(found[2]), text(found[3]), text(found[4]), block)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(digits: str) -> str:
    """ARC's YYYYMMDDhhmmss, or the leading part of it, as a WARC date."""
    d = digits[:14] + "00000101000000"[len(digits[:14]) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its empty line, and payload. Without a header all is payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, sep, payload = block.partition(b"\r\n\r\n")
    return head + sep, payload


def http_field(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*(.*?)\r?$", head)
    return text(found[1]) if found else None


def as_number(value: str | None) -> int | None:
    return int(value) if value and re.fullmatch(r"-?\d{1,19}", value) else None


def pack_record(header: bytes, block: bytes, end: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(header) + z.compress(block) + z.compress(end) + z.flush()


def warc_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}", "", ""]
    return pack_record("\r\n".join(lines).encode(), block, b"\r\n\r\n")


def convert(archive: str, content: bytes, revisits: dict[int, dict]) -> Iterator[bytes]:
    """WARC records of an ARC file. ``revisits``: what the record at an offset refers to."""
    for r in read_arc(content):
        own, date = record_id(archive, r.offset), iso_date(r.date)
        head, payload = split_http(r.block)
        if r.url.startswith("filedesc:"):
            yield warc_record([
                ("WARC-Type", "warcinfo"), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Filename", archive),
                ("Content-Type", "application/warc-fields"),
            ], f"description: converted from ARC version {r.version}\r\nformat: WARC File Format 1.1\r\n".encode())
            continue
        to = revisits.get(r.offset)
        block = head if to else r.block
        kind = "revisit" if to else "response" if head else "resource"
        yield warc_record([
            ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", r.url), ("WARC-IP-Address", r.ip),
            ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
            ("WARC-Profile", PROFILE if to else None), ("WARC-Refers-To", to and to["id"]),
            ("WARC-Refers-To-Target-URI", to and to["url"]), ("WARC-Refers-To-Date", to and to["date"]),
            ("Content-Type", "application/http; msgtype=response" if head else r.kind or "application/octet-stream"),
        ], block)


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each WARC record."""
    stream = Stream(content)
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        fields = {}
        while line := stream.line():
            name, _, value = text(line).partition(":")
            fields[name.lower()] = value.strip()
        yield fields, stream.read(int(fields["content-length"]))


def clean_url(url: str | None, page_id: int | None) -> str:
    """A url without white space and control characters; pages without one get a name."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or f"urn:page:{page_id}"


def write_arcs(pages: DataFrame, folder: str, *, archive_bytes: int = ARCHIVE_BYTES, date: str = "20240101000000") -> int:
    """Legacy archives of ``pages(page_id, url, html)``: tasks alternate between versions 1 and 2.

    Every page is an HTTP response; its id is kept as a header field. Returns the number of
    archives. A null html is an empty payload, a null page_id leaves the field out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        version = 1 + task % 2
        held, size, n, names = [], 0, 0, []

        def line(url: str, kind: str, length: int) -> bytes:
            more = "" if version == 1 else f"200 - - 0 part-{task:06d} "
            return f"{url} 0.0.0.0 {date} {kind} {more}{length}\n".encode()

        def close() -> None:
            name = f"part-{task:06d}-{n:05d}.arc.gz"
            about = f"{version} 0 tilewright\n".encode() + DEFINITIONS[version] + b"\n"
            first = f"filedesc://{name} 0.0.0.0 {date} text/plain "
            first += "" if version == 1 else f"200 - - 0 {name} "
            write_shared(f"{folder}/{name}", iter([pack_record(f"{first}{len(about)}\n".encode(), about, b"\n", LEGACY_LEVEL), *held]))
            names.append(name)

        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                payload = (html or "").encode("utf-8", "replace")
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                head += b"" if page_id is None else PAGE_HEADER + f": {page_id}\r\n".encode()
                block = head + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                held.append(pack_record(line(clean_url(url, page_id), "text/html", len(block)), block, b"\n", LEGACY_LEVEL))
                size += len(held[-1])
                if size >= archive_bytes:
                    close()
                    held, size, n = [], 0, n + 1
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["archive"])

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return narrow.mapInArrow(run, "archive string").count()


INDEX = "archive string, offset long, url string, date string, page_id long, digest string, payload_bytes long"


def index_arcs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per archived page: where it is, and its payload's digest and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                archive, out = path.rsplit("/", 1)[1], []
                for r in read_arc(content):
                    if not r.url.startswith("filedesc:"):
                        head, payload = split_http(r.block)
                        page = as_number(http_field(head, PAGE_HEADER))
                        out.append((archive, r.offset, r.url, iso_date(r.date), page, digest(payload), len(payload)))
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                columns = zip(*out, strict=True) if out else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")]
                )

    return read_files(spark, folder, ".arc.gz").mapInArrow(run, INDEX)


def convert_arcs(spark: SparkSession, folder: str, to: str, *, min_payload: int = MIN_PAYLOAD) -> int:
    """Convert every archive in ``folder`` to a WARC of the same name in ``to``; returns their number.

    Of records with equal payloads of at least ``min_payload`` bytes, that with the largest page
    id stays a response (then the last archive and place, for repeated ids), the others become
    revisits. Payloads are not moved for this: an index of digests decides, and what it decides
    for an archive, at most a row per record, goes to the task that opens and converts it.
    """
    index = cut(index_arcs(spark, folder).filter(F.col("payload_bytes") >= min_payload))
    last = index.groupBy("digest").agg(F.max(F.struct("page_id", "archive", "offset", "url", "date")).alias("to"), F.count(F.lit(1)).alias("n"))
    seen = salted_join(index.select("archive", "offset", "digest"), last.filter("n > 1").select("digest", "to"), "digest")
    again = seen.filter("archive <> to.archive or offset <> to.offset")
    per_archive = again.groupBy("archive").agg(
        F.collect_list(F.struct("offset", F.col("to.archive").alias("a"), F.col("to.offset").alias("o"), F.col("to.url").alias("u"), F.col("to.date").alias("d"))).alias("revisits")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("name").to_pylist()
            for name, revisits in zip(names, batch.column("revisits").to_pylist(), strict=True):
                found = {r["offset"]: {"id": record_id(r["a"], r["o"]), "url": r["u"], "date": r["d"]} for r in revisits or ()}
                content = read_shared(f"{folder}/{name}")
                write_shared(f"{to}/{name.removesuffix('.arc.gz')}.warc.gz", convert(name, content, found))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    files = cut(read_files(spark, folder, ".arc.gz").select(F.substring_index("path", "/", -1).alias("name")))
    named = files.join(per_archive, F.col("name") == F.col("archive"), "left").select("name", "revisits")
    # The rows are short, their archives are not: a task for each few archives, however small the rows are together.
    n = files.count()
    tasks = max(min(n, spark.sparkContext.defaultParallelism), math.ceil(n / TASK_ARCHIVES))
    return named.repartition(max(1, tasks)).mapInArrow(run, "name string").count()


def read_warcs(spark: SparkSession, folder: str, *, with_payload: bool = False) -> DataFrame:
    """Records read back: ``record_id, record_type, url, date, page_id, payload_bytes,
    payload_digest, refers_id`` and, if asked for, ``payload`` (null for revisits).

    The payload digest of a response is computed anew and must equal the one in its header.
    """
    names = "record_id string, record_type string, url string, date string, page_id long, payload_bytes long, payload_digest string, refers_id string"
    names += ", payload binary" if with_payload else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                out = []
                for fields, block in read_warc(content):
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    head, payload = split_http(block)
                    said = fields["warc-payload-digest"].removeprefix("sha1:")
                    size = len(payload)
                    if kind == "revisit":
                        size, payload = as_number(http_field(head, b"Content-Length")), None
                    elif digest(payload) != said:
                        raise ValueError(f"payload of {fields['warc-record-id']} is not what its digest says")
                    out.append((
                        fields["warc-record-id"], kind, fields["warc-target-uri"], fields["warc-date"],
                        as_number(http_field(head, PAGE_HEADER)), size, said, fields.get("warc-refers-to"),
                    ) + ((payload,) if with_payload else ()))
                kinds = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.string()] * 2 + [pa.binary()] * with_payload
                columns = zip(*out, strict=True) if out else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in names.split(", ")]
                )

    return read_files(spark, folder, ".warc.gz").mapInArrow(run, names)


def archive_pages(pages: DataFrame, folder: str, *, archive_bytes: int = ARCHIVE_BYTES, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` per row of ``pages``, read
    from WARC files in ``folder`` that were converted from legacy archives of the pages.

    Nulls: a null html is empty, a null page_id or url is archived without. Empty table: no
    archive, empty result. Repeated rows are records of their own. Other columns are not read.
    """
    spark = pages.sparkSession
    legacy = shared_folder(spark, "arc")
    columns = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    write_arcs(pages, legacy, archive_bytes=archive_bytes)
    if pages.isEmpty():
        return spark.createDataFrame([], columns)
    convert_arcs(spark, legacy, folder, min_payload=min_payload)
    drop_folder(spark, legacy)
    read = cut(read_warcs(spark, folder))
    kept = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    first = read.filter("record_type <> 'revisit'").select(*kept, F.lit(None).cast("long").alias("refers_to"))
    named = read.filter("record_type <> 'revisit'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    again = salted_join(read.filter("record_type = 'revisit'").select(*kept, "refers_id"), named, "refers_id", "left")
    return first.unionByName(again.select(*kept, "refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT page_id, h, x, max(page_id) OVER (PARTITION BY x) AS last FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform(range(4), lambda j:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(x, CAST(5 * i + 1 AS INT), 5))::INT >> CAST(15 - 5 * j AS INT)) & 31 AS INT), 1)),
           'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM d
"""
