"""Operator 1: benchmark decontamination by size-partitioned MinHash containment search.

A test item is short and a document may be long, so resemblance is the wrong measure;
what counts is containment, the share of the item's word shingles found in the
document.  Under each of ``probes`` hash functions an item is represented by its
minimal shingle, and the share of those minima found in a document's set estimates
the containment without bias, however long the document.  Items are partitioned by
size class (powers of two); a document probes only the classes whose smallest
admissible size it reaches.  Candidates with ``cut`` of the minima (an item at 0.8
containment falls short with probability below 1e-9) are verified on the full sets.

The item side is taken in blocks of at most ``block_bytes`` of text, each collected,
indexed and broadcast; a larger benchmark means more blocks, not a larger broadcast.
Documents are never shuffled.

Words are read without case and ASCII punctuation.  An item of fewer than n words is
one shingle and matches only a document that is that same sequence; null or empty
items and texts match nothing.  Repeated document rows give repeated result rows;
repeated (item_id, text) rows count once.  Extra columns are ignored, or kept by
``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import table

FOUND = "n_item_shingles long, n_shared long"


class Index:
    """Minima and full sets of one block of items, by size class."""

    def __init__(self, texts: list[str | None], n: int, probes: int):
        sets = [s for _, block in K.shingle_sets(pa.array(texts, pa.string()), n, sep=K._NOT_ALNUM) for s in block]
        self.sets, self.classes = sets, []
        mult, add = K.constants(probes, 606), K.constants(probes, 707)
        by: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            if len(s):
                by.setdefault(len(s).bit_length() - 1, []).append(i)
        for c, items in sorted(by.items()):
            minima, owner = [], []
            for i in items:
                with np.errstate(over="ignore"):
                    at = np.argmin((sets[i][None, :] ^ add[:, None]) * mult[:, None], axis=1)
                minima.append(sets[i][at])
                owner.append(np.full(probes, i))
            m, o = np.concatenate(minima), np.concatenate(owner)
            order = np.argsort(m, kind="stable")
            m, o = m[order], o[order]
            bits = np.zeros(1 << 20, dtype=bool)
            bits[(m >> K.U64(44)).astype(np.int64)] = True
            self.classes.append((1 << c, bits, m, o))

    def search(self, doc_sets: list[np.ndarray], num: int, den: int, cut: int) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared) with den * shared >= num * item size."""
        size = np.array([len(s) for s in doc_sets], dtype=np.int64)
        for least, bits, minima, owner in self.classes:
            rows = np.flatnonzero(den * size >= num * least)
            if not len(rows):
                continue
            x = np.concatenate([doc_sets[i] for i in rows])
            hit = np.flatnonzero(bits[(x >> K.U64(44)).astype(np.int64)])
            x, row = x[hit], np.repeat(rows, size[rows])[hit]
            lo, hi = np.searchsorted(minima, x, "left"), np.searchsorted(minima, x, "right")
            count = hi - lo
            if not count.any():
                continue
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            pair, votes = np.unique(np.repeat(row, count) * len(self.sets) + owner[at], return_counts=True)
            for p in pair[votes >= cut]:
                r, i = divmod(int(p), len(self.sets))
                shared = K.common(self.sets[i], doc_sets[r])
                if den * shared >= num * len(self.sets[i]):
                    yield r, i, shared


def _found(batches: Iterator[pa.RecordBatch], index, ids: list, n: int, num: int, den: int, cut: int) -> Iterator[pa.RecordBatch]:
    block = index.value
    for batch in batches:
        for at, sets in K.shingle_sets(batch.column(1), n, sep=K._NOT_ALNUM):
            hits = list(block.search(sets, num, den, cut))
            if hits:
                r, i, s = zip(*hits)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([at + x for x in r])), pa.array([ids[x] for x in i], pa.int64()), pa.array([len(block.sets[x]) for x in i], pa.int64()), pa.array(s, pa.int64())], ["doc_id", "item_id", "n_item_shingles", "n_shared"])


def contained(docs: DataFrame, items: DataFrame, n: int = 5, num: int = 80, den: int = 100, probes: int = 24, cut: int = 6, block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) of the items held by documents."""
    spark = docs.sparkSession
    item = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").dropDuplicates()
    total = item.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = None
    for b in range(blocks):
        rows = sorted(item.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        index = spark.sparkContext.broadcast(Index([r[1] for r in rows], n, probes))
        ids = [r[0] for r in rows]
        part = docs.select("doc_id", "text").mapInArrow(lambda it, index=index, ids=ids: _found(it, index, ids, n, num, den, cut), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, {FOUND}")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))


def decontaminate(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of docs, all columns, that contain no item; a null id is kept."""
    return docs.join(contained(docs, items, **how).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def shingle_sql(words: str, n: int) -> str:
    grams = " || ' ' || ".join(f"w[i + {j}]" for j in range(n))
    return f"CASE WHEN len({words}) = 0 THEN CAST([] AS VARCHAR[]) WHEN len({words}) < {n} THEN ['<' || array_to_string({words}, ' ') || '>'] ELSE list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: {grams})) END"


OP1_SQL = rf"""
WITH i AS (SELECT item_id, {shingle_sql('w', 5)} AS s FROM (SELECT DISTINCT item_id, text, {_W} AS w FROM benchmark)),
d AS (SELECT doc_id, unnest({shingle_sql('w', 5)}) AS g FROM (SELECT doc_id, {_W} AS w FROM documents)),
x AS (SELECT item_id, len(s) AS n, unnest(s) AS g FROM i)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_item_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM d JOIN x USING (g) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 80 * n
"""
