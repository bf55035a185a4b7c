r"""Operator 4: WARC archives with a salvage reader.

Writing: every page becomes one gzip member that holds one WARC/1.1 record, and the members
of a partition follow each other in a file.  Spark's text sink writes them (a
member's bytes as an unchecked string), so archives go wherever Spark can write,
commit atomically and survive lost executors.  The sink puts a separator after each
value; the separator is the NUL byte that ends a member of less than 16 MiB of
content anyway (the highest byte of its length), so the member is written
without it and the file is an exact sequence of members.  A larger member is followed by
one NUL of padding, which gzip readers skip.

Of records with equal payloads of at least ``least`` bytes the one with the smallest page
id is the response; the others are revisits, which hold the HTTP header and name the
response.  All pages with a smaller payload are responses.

Reading: a task holds one file, so the writer bounds files to about ``FILE_BYTES`` of payload;
a foreign archive must be below Spark's 2 GB limit for binary files.  A record is checked (gzip trailer,
version line, content length, payload digest).  After a failed check the reader
searches for the next gzip member or version line that starts a valid record, goes on from there,
and reports the bytes in between as a quarantined gap.  Plain and gzip records may
follow each other in one archive.

A null html is an empty payload; a null page id is written as an empty id and read as
null, never is a response to others unless alone, and sorts after all ids.  Equal page ids with equal
payloads are one response each.  Empty tables give no records.  Other columns of pages are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, stash, table

CRLF = b"\r\n"
_LAST = 2**63 - 1
READ = "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary, start long, length long, gap string"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response, or a revisit if refers_to is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = "" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{name}:{digest}')}>",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', lambda m: f'%{ord(m[0]):02X}', url or '')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"X-Page-Id: {name}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF


def member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class Record(NamedTuple):
    start: int
    end: int
    headers: dict[str, str]
    block: bytes


class Gap(NamedTuple):
    start: int
    end: int
    reason: str


def _agrees(want: str, data: bytes) -> bool:
    """Whether data has the digest: SHA-1 in base32 or base16 of either case; others can't be checked."""
    name, _, value = want.partition(":")
    value = value.strip().rstrip("=")
    if name.strip().lower() != "sha1":
        return True
    return value.lower() == hashlib.sha1(data).hexdigest() if len(value) == 40 else value.upper() == sha1_base32(data)


def _parse(data: bytes, at: int) -> tuple[Record, int]:
    """The record at byte at and the byte after it; ValueError if it is not valid."""
    if not data.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n"), at):
        raise ValueError("no version line")
    stop = data.find(CRLF + CRLF, at)
    if stop < 0:
        raise ValueError("header not ended")
    headers: dict[str, str] = {}
    k = ""
    for line in data[at:stop].split(CRLF)[1:]:
        text = line.decode("utf-8", "replace")
        if k and text[:1] in " \t":  # a folded line goes on with the one before
            headers[k] = f"{headers[k]} {text.strip()}".strip()
            continue
        k, colon, v = text.partition(":")
        if not colon:
            raise ValueError("bad header line")
        k = k.strip().lower()
        headers[k] = v.strip()
    for name in ("warc-type", "warc-record-id", "warc-date"):
        if name not in headers:
            raise ValueError(f"no {name}")
    if not headers.get("content-length", "").isdigit():
        raise ValueError("no content length")
    end = stop + 4 + int(headers["content-length"])
    if data[end : end + 4] != CRLF + CRLF:
        raise ValueError("record not ended")
    block = data[stop + 4 : end]
    if not _agrees(headers.get("warc-block-digest", ""), block):
        raise ValueError("block digest differs")
    if headers.get("warc-type") == "response":
        head, _, payload = block.partition(CRLF + CRLF)
        chunked = re.search(rb"(?im)^transfer-encoding:.*chunked", head)  # the digest is of the decoded payload
        if not chunked and not _agrees(headers.get("warc-payload-digest", ""), payload):
            raise ValueError("payload digest differs")
    return Record(at, end + 4, headers, block), end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """Content of the gzip member at byte at and the byte after it."""
    z, out, view = zlib.decompressobj(31), [], memoryview(data)
    try:
        while not z.eof and at < len(data):
            out.append(z.decompress(view[at : at + 65536]))
            at += 65536
    except zlib.error as e:
        raise ValueError(f"gzip: {e}") from None
    if not z.eof:
        raise ValueError("gzip member not ended")
    return b"".join(out), min(at, len(data)) - len(z.unused_data)


def _one(data: bytes, at: int) -> list[Record]:
    """The records of the gzip member or the plain record at byte at; ValueError if not valid."""
    if data[at : at + 2] != b"\x1f\x8b":
        return [_parse(data, at)[0]]
    plain, end = _inflate(data, at)
    out, p = [], 0
    while p < len(plain):
        r, p = _parse(plain, p)
        out.append(r._replace(start=at, end=end))
    if not out:
        raise ValueError("empty member")
    return out


_MARK = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def salvage(data: bytes, first: int = 0, owned: int | None = None) -> Iterator[Record | Gap]:
    """Valid records that start in data[first:owned], and the gaps between them.

    data goes on beyond owned as far as the last record may need.
    """
    owned = len(data) if owned is None else owned
    at, bad, why = first, None, ""
    while at < owned:
        if data[at : at + 1] == b"\0" and bad is None:  # padding
            at += 1
            continue
        try:
            records = _one(data, at)
        except ValueError as e:
            bad, why = (at, str(e)) if bad is None else (bad, why)
            found = _MARK.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if bad is not None:
            yield Gap(bad, at, why)
            bad = None
        yield from records
        at = records[-1].end
    if bad is not None:
        yield Gap(bad, min(at, len(data)), why)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        payload = [x.encode() if x is not None else b"" for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(payload, pa.binary()), pa.array([sha1_base32(x) for x in payload])], ["page_id", "url", "payload", "digest"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            out = []
            for row in b.slice(at, 256).to_pylist():
                m = member(record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"]))
                out.append(m[:-1] if m[-1] == 0 else m)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["m"])


def write_archives(pages: DataFrame, path: str, least: int = 0, records_per_file: int = 0) -> None:
    """Write pages(page_id, url, html) as gzip WARC files in folder path.

    Payloads meet their response's id by one join on the digest; only digests are aggregated.
    """
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(_LAST)).alias("page_id"), "url", "html").mapInArrow(_digests, "page_id long, url string, payload binary, digest string")
    first = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"))
    full = rows.join(first, "digest", "left")
    back = F.when((F.col("first") < F.col("page_id")) & (F.octet_length("payload") >= least), F.col("first"))
    full = full.select(F.when(F.col("page_id") != _LAST, F.col("page_id")).alias("page_id"), "url", "payload", "digest", back.alias("refers_to"))
    out = full.mapInArrow(_members, "m binary").select(F.col("m").cast("string").alias("value"))
    out.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", records_per_file).text(path)


def _read(batches: Iterator[pa.RecordBatch], keep_payload: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for data in b.column("content").to_pylist():
            rows = []
            for x in salvage(data):
                if isinstance(x, Gap):
                    rows.append((None, None, None, None, None, None, x.start, x.end - x.start, x.reason))
                    continue
                http, _, payload = x.block.partition(CRLF + CRLF)
                size = re.search(rb"(?im)^content-length:\s*([0-9]+)", http)
                page, back = x.headers.get("x-page-id", ""), x.headers.get("x-refers-to-page-id", "")
                digest = x.headers.get("warc-payload-digest", "").partition(":")[2]
                kind = x.headers.get("warc-type")
                n = len(payload) if kind != "revisit" else int(size[1]) if size else None
                rows.append((int(page) if page.lstrip("-").isdigit() else None, kind, digest, n, int(back) if back.lstrip("-").isdigit() else None, payload if keep_payload and kind != "revisit" else None, x.start, x.end - x.start, None))
                if len(rows) == 512:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


_FIELDS = [("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("start", pa.int64()), ("length", pa.int64()), ("gap", pa.string())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_FIELDS)], [n for n, _ in _FIELDS])


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps (gap not null) of the archives in folder path."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(lambda it: _read(it, keep_payload), READ)


#: Payload bytes for one archive file, so that a file fits in a reading task.
FILE_BYTES = 16 << 20


def archive(pages: DataFrame, path: str, least: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """write_archives with files of about file_bytes of payload."""
    count, total = pages.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 512)).first()
    write_archives(pages, path, least, max(1, file_bytes * count // (total or 1)))


def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    archive(table(spark, sf_dir, "pages"), path)
    read = read_archives(spark, path, keep_payload=False).where("gap is null")
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
