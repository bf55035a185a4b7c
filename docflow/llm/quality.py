"""Operator 10: quality classifier by ordinal cumulative-link regression on graded ratings.

The ratings form a grade: 0 toxic, 1 poor, 2 good.  A document's score is a weighted
sum over its distinct hashed words and word prefixes, plus the shares of words that
repeat the word before them and of word endings (last two bytes, which tell shouting,
tables and stray symbols); one weight vector serves all thresholds, and P(grade <= j) = sigmoid(threshold_j - score) with ordered thresholds.
Weights are at most 0: text is good unless something speaks against it, so a long text
gathers no credit that could outweigh a slur, and a short one needs none.  An L1 penalty
leaves only words that many poor or toxic sample documents share.
The expected grade and the tail probability P(grade = 2) select documents.

The model is fitted on at most ``sample`` labelled rows, the least in the order of a hash
of the id; 64-bit hashes are kept as features if at least ``min_df`` sample documents hold them and
the penalty lets them leave zero, at most ``max_features``.  They are counted by grade on the
executors, and the driver gathers only the chosen ones of each sample document.  So the model that is broadcast has a fixed size bound
(about 1 MB).  Every document is scored over its whole text in one map pass.

Null or empty text has score 0.  Labels whose quality and toxic are both null, and
labels without a document, are not used; repeated labels count as often as they stand.
Without usable labels, or with a single grade, everything is kept with null
expectations.  Other columns of docs are ignored, or kept by ``select_quality``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import stash, table

GRADES = 3
#: Share features are scaled to the weight of a few words.
ENDING = 8.0
#: Lengths in bytes of the prefixes that stand for a family of words.
PREFIXES = (4, 5, 6)


class Model(NamedTuple):
    words: np.ndarray  # sorted hashes
    weights: np.ndarray  # of the words
    endings: np.ndarray  # 65536 weights
    thresholds: np.ndarray  # ascending, GRADES - 1


def _hashes(block: np.ndarray, row: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature hash) of the words, then of their prefixes of each length."""
    yield row, h
    code = np.zeros(len(h), dtype=np.uint64)
    for j in range(max(PREFIXES)):
        byte = block[np.minimum(start + j, len(block) - 1)].astype(np.uint64)
        code = (code << K.U64(8)) | np.where((byte >= 65) & (byte <= 90), byte + K.U64(32), byte)
        if j + 1 in PREFIXES:
            longer = end - start > j + 1
            yield row[longer], K.mix64(code[longer] ^ K.U64(0x51ED << 48 | j << 40))


def _parts(column) -> Iterator[tuple]:
    """(first row, rows, row of each word, feature hashes, share feature of each word) block by block.

    The share feature is the word's last two bytes, or 0 where it repeats the word before it.
    """
    raw, off = K.utf8(column)
    for a, b in K.slices(off):
        h, first, start, end = K.words(raw, off[a : b + 1], places=True)
        block, row = raw[off[a] : off[b]], np.repeat(np.arange(b - a), np.diff(first))
        kind = np.zeros(len(h), np.int64)
        if len(h):
            kind = (block[np.maximum(end - 2, 0)].astype(np.int64) << 8) | block[end - 1]
            kind[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])] = 0
        yield a, b - a, row, (list(_hashes(block, row, h, start, end)) if len(h) else []), kind


def _sets(n: int, hashes: list) -> list[np.ndarray]:
    """The distinct feature hashes of each row, ascending."""
    if not hashes:
        return [np.zeros(0, np.uint64)] * n
    return [np.unique(np.concatenate([h[slice(*np.searchsorted(r, [i, i + 1]))] for r, h in hashes])) for i in range(n)]


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """grade and feature, once for each row that holds the feature."""
    for batch in batches:
        grades = batch.column(0).to_numpy()
        for a, n, _, hashes, _ in _parts(batch.column(1)):
            own = _sets(n, hashes)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(grades[a : a + n], [len(x) for x in own])), pa.array(K.signed(np.concatenate(own)))], ["grade", "word"])


def _features(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """grade, chosen features, endings and their shares of each row."""
    chosen = shared.value
    for batch in batches:
        for a, n, row, hashes, kind in _parts(batch.column(1)):
            at = np.searchsorted(row, np.arange(n + 1))
            for i, own in enumerate(_sets(n, hashes)):
                e, c = np.unique(kind[at[i] : at[i + 1]], return_counts=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a + i, 1), pa.array([own[np.isin(own, chosen)].tobytes()], pa.binary()), pa.array([e.astype(np.int32).tobytes()], pa.binary()), pa.array([(c / max(1, at[i + 1] - at[i])).astype(np.float32).tobytes()], pa.binary())], ["grade", "words", "endings", "shares"])


def grade(quality="quality", toxic="toxic"):
    return F.when(F.col(toxic) == 1, 0).when(F.col(quality) == 0, 1).when(F.col(quality) == 1, 2)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 5000, min_df: int = 3, max_features: int = 1 << 14, steps: int = 400, l1: float = 5e-4, l2: float = 1e-5) -> Model | None:
    rated = labels.select("doc_id", grade().alias("grade")).where("grade is not null and doc_id is not null")
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    rows = stash(docs.select("doc_id", "text").join(F.broadcast(rated), "doc_id").select(F.col("grade").cast("long"), "text"), "sample")
    share = dict(rows.groupBy("grade").count().collect())
    if len(share) < 2:
        return None
    y = np.repeat(np.arange(GRADES), [share.get(g, 0) for g in range(GRADES)])
    n = len(y)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    upto = np.clip(np.array([(y <= 0).mean(), (y <= 1).mean()]), 1e-3, 1 - 1e-3)
    t = np.sort(np.log(upto / (1 - upto)) + [-1e-3, 1e-3])

    def slopes(s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Derivative of the mean loss by each document's score and by the thresholds."""
        upper = np.where(y == 2, 1.0, sigmoid(t[np.minimum(y, 1)] - s))
        lower = np.where(y == 0, 0.0, sigmoid(t[np.maximum(y - 1, 0)] - s))
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        gt = np.zeros(2)
        np.add.at(gt, np.minimum(y, 1), np.where(y == 2, 0, -du) / n)
        np.add.at(gt, np.maximum(y - 1, 0), np.where(y == 0, 0, dl) / n)
        return (du - dl) / n, gt

    # A word enters if it speaks against text strongly enough to leave zero under the penalty.
    first, _ = slopes(np.zeros(n), t)
    speaks = [float(first[y == g][0]) if g in share else 0.0 for g in range(GRADES)]
    counts = rows.mapInArrow(_occurrences, "grade long, word long").groupBy("word").agg(*[F.count_if(F.col("grade") == g).alias(f"n{g}") for g in range(GRADES)])
    pull = sum((F.col(f"n{g}") * F.lit(x) for g, x in enumerate(speaks)), F.lit(0.0))
    strong = counts.select("word", (F.col("n0") + F.col("n1") + F.col("n2")).alias("df"), pull.alias("pull")).where((F.col("pull") > l1) & (F.col("df") >= min_df))
    best = strong.orderBy(F.desc("pull"), F.col("word") < 0, "word").limit(max_features).select("word").collect()
    words = np.sort(np.array([r[0] for r in best], np.int64).view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(words)
    got = rows.mapInArrow(lambda it: _features(it, shared), "grade long, words binary, endings binary, shares binary").collect()
    got = sorted(map(tuple, got))  # in the order of y
    sets = [np.frombuffer(g[1], np.uint64) for g in got]
    r, c = np.repeat(np.arange(n), [len(x) for x in sets]), np.searchsorted(words, np.concatenate(sets))
    ends = [np.frombuffer(g[2], np.int32) for g in got]
    r2 = np.repeat(np.arange(n), [len(e) for e in ends])
    c2, v2 = np.concatenate(ends), np.concatenate([np.frombuffer(g[3], np.float32) for g in got]) * ENDING
    m = len(words)
    w, e = np.zeros(m), np.zeros(1 << 16)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, e, t)]
    for step in range(1, steps + 1):
        ds, gt = slopes(np.bincount(r, w[c], n) + np.bincount(r2, e[c2] * v2, n), t)
        grads = (np.bincount(c, ds[r], m) + l2 * w - l1, np.bincount(c2, ds[r2] * v2, 1 << 16) + l2 * e - l1, gt)
        for x, g, (a, b) in zip((w, e, t), grads, moments):
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            x -= 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
            if x is not t:
                np.minimum(x, 0, out=x)
        t[:] = np.sort(t)
    return Model(words[w < 0], w[w < 0], e, t)


def _score(batches: Iterator[pa.RecordBatch], shared, floor: float) -> Iterator[pa.RecordBatch]:
    m = shared.value
    size = max(1, len(m.words))
    bits = np.zeros(1 << 16, dtype=bool)
    bits[(m.words >> K.U64(48)).astype(np.int64)] = True
    for batch in batches:
        out = []
        for _, n, row, hashes, kind in _parts(batch.column(1)):
            pairs = [np.zeros(0, np.int64)]
            for r, h in hashes if len(m.words) else []:
                near = np.flatnonzero(bits[(h >> K.U64(48)).astype(np.int64)])
                at = np.searchsorted(m.words, h[near])
                at[at == size] = 0
                hit = m.words[at] == h[near]
                pairs.append(r[near[hit]] * size + at[hit])
            pair = np.unique(np.concatenate(pairs))
            s = np.bincount(pair // size, m.weights[pair % size] if len(pair) else None, n).astype(float)
            s += np.bincount(row, m.endings[kind], n) * ENDING / np.maximum(1, np.bincount(row, minlength=n))
            out.append(s)
        s = np.concatenate(out) if out else np.zeros(0)
        below = 1 / (1 + np.exp(-np.clip(m.thresholds[None, :] - s[:, None], -500, 500)))
        tail = 1 - below[:, 1]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(2, batch.num_columns)), pa.array(2 - below.sum(1)), pa.array(tail), pa.array(tail >= floor)], [*batch.schema.names[2:], "expected_grade", "p_good", "keep"])


def scored(docs: DataFrame, model: Model | None, keep_columns: list[str], floor: float = 0.75) -> DataFrame:
    """keep_columns of docs with expected_grade, p_good and keep, in one pass without a shuffle."""
    if model is None:
        return docs.select(*keep_columns).withColumns({"expected_grade": F.lit(None).cast("double"), "p_good": F.lit(None).cast("double"), "keep": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(F.lit(0).alias("_0"), F.col("text").alias("_1"), *[F.col(f"`{c}`") for c in keep_columns])
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep_columns)
    return given.mapInArrow(lambda it: _score(it, shared, floor), f"{kinds}, expected_grade double, p_good double, keep boolean")


def select_quality(docs: DataFrame, labels: DataFrame, floor: float = 0.75) -> DataFrame:
    """The rows of docs, own columns only, that the classifier keeps."""
    cols = docs.columns
    packed = docs.select(F.col("text"), F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row_"))
    return scored(packed, fit(docs, labels), ["row_"], floor).where("keep").select("row_.*")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
