import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from docflow.llm import warc as W


def rec(i, text, refers=None):
    p = text.encode()
    return W.record(i, f"http://h/{i}", p, W.sha1_base32(p), refers)


def parts(data):
    xs = list(W.salvage(data))
    return [int(x.headers["x-page-id"]) for x in xs if isinstance(x, W.Record)], [(x.start, x.end) for x in xs if isinstance(x, W.Gap)]


@pytest.mark.parametrize("pack", [lambda b: b, W.member])
def test_salvage_skips_damage(pack):
    items = [pack(rec(i, f"payload {i} " * 50)) for i in range(5)]
    whole = b"".join(items)
    assert parts(whole) == ([0, 1, 2, 3, 4], [])
    starts = [sum(map(len, items[:i])) for i in range(6)]
    damaged = bytearray(whole)
    damaged[starts[2] + len(items[2]) // 2] ^= 0x55
    assert parts(bytes(damaged)) == ([0, 1, 3, 4], [(starts[2], starts[3])])
    assert parts(whole[: starts[4] + 9]) == ([0, 1, 2, 3], [(starts[4], starts[4] + 9)])
    assert parts(b"junk" + whole) == ([0, 1, 2, 3, 4], [(0, 4)])
    assert parts(whole[:starts[1]] + b"\x00" + whole[starts[1]:])[0] == [0, 1, 2, 3, 4]
    assert parts(b"") == ([], []) and parts(b"only junk")[1] == [(0, 9)]


def test_foreign_digests_and_headers():
    """Base16 and lower-case base32 digests, other algorithms, folded header lines, chunked bodies."""
    body = b"payload of a page"
    right, wrong = hashlib.sha1(body), hashlib.sha1(b"another")

    def made(digest, http=b"HTTP/1.1 200 OK\r\nX: y"):
        block = http + b"\r\n\r\n" + body
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Date:\r\n 2024-01-01T00:00:00Z\r\nWARC-Payload-Digest: {digest}\r\nContent-Length: {len(block)}\r\n\r\n"
        return list(W.salvage(head.encode() + block + b"\r\n\r\n"))

    base32 = lambda h: base64.b32encode(h.digest()).decode()
    good = ["sha1:" + base32(right), "SHA1:" + base32(right).lower(), "sha1:" + right.hexdigest(), "sha1:" + right.hexdigest().upper(), "md5:whatever"]
    for digest in good:
        (r,) = made(digest)
        assert isinstance(r, W.Record) and r.headers["warc-date"] == "2024-01-01T00:00:00Z"
    for digest in ("sha1:" + base32(wrong), "sha1:" + wrong.hexdigest(), "sha1:short"):
        assert not any(isinstance(x, W.Record) for x in made(digest))
        assert isinstance(made(digest, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked")[0], W.Record)


def test_query_against_recomputed_table(spark):
    """Every row of op4 over a whole table, from the payloads themselves."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    payload = {r.page_id: (r.html or "").encode() for r in rows}
    first = {}
    for i in sorted(payload):
        first.setdefault(payload[i], i)
    want = {i: (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first[p] == i else "revisit", None if first[p] == i else first[p]) for i, p in payload.items()}
    got = W.op4_warc_salvage(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(rows) and {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want


def test_salvage_random_damage_never_invents_records():
    rng = random.Random(1)
    items = [W.member(rec(i, "x" * rng.randint(0, 3000))) for i in range(20)]
    whole = b"".join(items)
    for _ in range(60):
        d = bytearray(whole)
        for _ in range(3):
            d[rng.randrange(len(d))] = rng.randrange(256)
        ids, gaps = parts(bytes(d))
        assert len(ids) >= 17 and ids == sorted(set(ids))
        assert all(0 <= a < b <= len(d) for a, b in gaps)


def test_round_trip(spark, tmp_path):
    rows = [(1, "u 1", "same"), (2, None, "same"), (3, "u3", None), (4, "u4", ""), (5, "u5", "ünïcode" * 1000), (None, "u6", "same"), (7, "u\r\n7", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    W.archive(pages, str(tmp_path / "w"))
    got = {r.page_id: r for r in W.read_archives(spark, str(tmp_path / "w")).collect()}
    assert all(r.gap is None for r in got.values()) and len(got) == 7
    assert (got[1].record_type, got[2].record_type, got[2].refers_to, got[None].refers_to) == ("response", "revisit", 1, 1)
    assert (got[3].record_type, got[4].record_type, got[4].refers_to, got[4].payload_bytes) == ("response", "revisit", 3, 0)
    assert bytes(got[5].payload) == ("ünïcode" * 1000).encode() and got[2].payload_bytes == 4
    for f in (tmp_path / "w").glob("part-*"):
        assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1")
    W.archive(pages, str(tmp_path / "v"), least=5)
    assert W.read_archives(spark, str(tmp_path / "v")).where("record_type = 'revisit'").count() == 0
    W.archive(pages.limit(0), str(tmp_path / "e"))
    assert W.read_archives(spark, str(tmp_path / "e")).count() == 0
