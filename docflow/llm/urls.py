"""Operator 5: URL filter by a blocked Bloom filter and an exact hash join.

Rules are canonical URLs: a lower-case host and a path prefix.  A rule fits its host and
all subdomains if the URL's path starts with the rule's.  A URL's possible
rules are its host suffixes at label boundaries, each followed by those prefixes of
its path that have the length of some rule's path.  They are probed in a Bloom filter
whose eight bits per key lie in one 512-bit block; only possible hits go on to the
exact join with the rule table, which removes false positives.  The longest fitting rule
decides; without one the verdict is the method's, ``allow``.

The filter has ``2 ** log2_bits`` bits whatever the number of rules (fewer hits are
filtered if it is full; results stay the same).  It is built from rule keys in bounded
pieces.  Rule paths' lengths are at most ``max_lengths`` different ones, checked.  The
rule table is joined by key and never broadcast by hand; a key that a third of all URLs hit is
one row on the rule side, so the join can be split on the URL side.

Of rules with one key and several verdicts the last by name decides, so ``block`` before ``allow``.
A null URL, or one without ``://``, has empty host and path and no rule.  Repeated rows and
null ids keep their rows.  An empty table gives an empty result; without rules
everything is allowed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import stash, table

#: Fixed rules of the registered query: key and verdict.
RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


def parts(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL."""
    found = _URL.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def canonical(rule: str) -> str:
    host, slash, path = rule.partition("/")
    return host.translate(_LOWER) + slash + path


class BlockedBloom:
    """Eight bits per key in one of 2 ** (log2_bits - 9) blocks of 512 bits."""

    def __init__(self, log2_bits: int):
        self.bits = np.zeros((1 << (log2_bits - 9), 8), dtype=np.uint64)

    def _place(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Block of each key and the bit it sets in each of the block's eight words."""
        column = pa.array(keys, pa.large_string())
        raw, off = K.utf8(column)
        h, first = K.words(raw, off, False, np.zeros(256, dtype=bool))
        full = np.full(len(keys), K.U64(0))
        own = np.diff(first) > 0
        full[own] = h[first[:-1][own]]
        block = (full >> K.U64(32)) & K.U64(len(self.bits) - 1)
        with np.errstate(over="ignore"):
            turn = K.mix64(full ^ K.U64(0xB10C))[:, None] >> (np.arange(8, dtype=np.uint64) * K.U64(6))[None, :]
        return block.astype(np.int64), K.U64(1) << (turn & K.U64(63))

    def add(self, keys: list[str]) -> None:
        block, bit = self._place(keys)
        np.bitwise_or.at(self.bits, block, bit)

    def may_hold(self, keys: list[str]) -> np.ndarray:
        block, bit = self._place(keys)
        return ((self.bits[block] & bit) == bit).all(axis=1)


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """Keys of all rules that could fit, longest first not guaranteed."""
    if not host:
        return []
    ends = [path[:n] for n in lengths if n <= len(path)]
    out, at = [], 0
    while True:
        out += [host[at:] + e for e in ends]
        at = host.find(".", at) + 1
        if not at:
            return out


def _probe(batches: Iterator[pa.RecordBatch], shared, lengths: list[int]) -> Iterator[pa.RecordBatch]:
    bloom = shared.value
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            hosts, paths, keys, owner = [], [], [], []
            for i, url in enumerate(part.column("url").to_pylist()):
                host, path = parts(url)
                hosts.append(host)
                paths.append(path)
                own = candidates(host, path, lengths)
                keys += own
                owner += [i] * len(own)
            hits: list[list[str]] = [[] for _ in hosts]
            if keys:
                for k in np.flatnonzero(bloom.may_hold(keys)):
                    hits[owner[k]].append(keys[k])
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("page_id"), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(hits, pa.list_(pa.string()))], ["row", "page_id", "host", "path", "hits"])


def judge(pages: DataFrame, rules: DataFrame, log2_bits: int = 20, max_lengths: int = 4096, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages; rules has rule and verdict."""
    spark = pages.sparkSession
    key = F.concat(F.translate(F.substring_index("rule", "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)"))
    listed = rules.where("rule is not null").select(key.alias("key"), "verdict").groupBy("key").agg(F.max("verdict").alias("verdict"))
    lengths = sorted(r[0] for r in listed.select((F.length("key") - F.length(F.substring_index("key", "/", 1))).alias("n")).distinct().limit(max_lengths + 1).collect())
    if len(lengths) > max_lengths:
        raise ValueError(f"rule paths have more than {max_lengths} different lengths")
    bloom = BlockedBloom(log2_bits)
    piece: list[str] = []
    for r in listed.select("key").toLocalIterator():
        piece.append(r[0])
        if len(piece) == 100_000:
            bloom.add(piece)
            piece = []
    if piece:
        bloom.add(piece)
    shared = spark.sparkContext.broadcast(bloom)
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", F.monotonically_increasing_id().alias("row"))
    probed = stash(rows.mapInArrow(lambda it: _probe(it, shared, lengths), f"row long, page_id {kind}, host string, path string, hits array<string>"), "probed")
    exact = probed.select("row", F.explode("hits").alias("key")).join(listed, "key")
    best = exact.groupBy("row").agg(F.max(F.struct(F.length("key").alias("n"), "key", "verdict")).alias("best"))
    out = probed.drop("hits").join(best, "row", "left")
    return out.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op5_blocked_bloom_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "rule string, verdict string"))


_RULE_ROWS = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}', '{v}')" for r, v in RULES)

OP5_SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, rule, verdict) AS (VALUES {_RULE_ROWS}),
m AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
