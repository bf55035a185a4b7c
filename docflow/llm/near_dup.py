"""Operator 3: MinHash near-duplicates by a signature-coordinate inverted join.

Every document becomes a set of hashed word shingles and a signature of ``coords``
minima.  Documents with equal sets form a class, represented by its least id.
Representatives are posted under each coordinate-value pair.  A pair that shares at
least ``match`` of the coordinates must share one of any ``coords - match + 1``
coordinates, so each representative keeps only its rarest such prefix; values that
occur once fill the prefix first and cost nothing, which drops most documents.

Collisions in the prefixes are counted for each pair; pairs are then merged on their whole
signatures, those with at least ``match`` equal coordinates are retained, and links
are confirmed on the full shingle sets.  Pairs are formed in two rounds:

* first each document with the one pivot (a posting's fixed member) it collides with most, which settles
  large groups without emitting their pairs: components of the links found so far are
  formed, and postings that lie in one component are skipped;
* then, in postings that still hold several components, the pairs of members of different
  components, for postings of up to ``POSTING`` members.  Longer ones are split into the documents
  that they chain together; these are dealt to bounded cells (pairs of blocks of a chain), and
  a cell counts its collisions on the full shingle sets at once and returns a spanning
  forest of its links.  That is exact, and quadratic in such a chain.

At ``coords=32, match=12`` a pair of similarity 0.85 (0.8) is missed by the
prefix with probability below 1e-9 (1e-6).

Results are by id: rows that repeat an id with its text get equal results (all of them kept or
none; the operator has one row per row), and an id that stands with several texts links with
whatever any of its texts links with, so all its rows have one component.  Ties need no rule, as
a component is named by its least id.  Null or empty text has an empty set and no links.  Texts of any
length are read whole, block by block.  A null id is never linked; its
row keeps a null component and is kept.  Extra columns are ignored.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import components, release, spread_join, stash, table

#: Bounds of one side of a cell of documents compared in one piece.
BLOCK_ROWS, BLOCK_BYTES = 512, 2 << 20
#: Members of a posting whose pairs may be formed one by one.
POSTING = 64
SIGNATURE = "doc_id long, t long, n_shingles long, d1 long, d2 long, sig array<long>"


def signature_batches(batches: Iterator[pa.RecordBatch], n: int, coords: int) -> Iterator[pa.RecordBatch]:
    mult, add = K.constants(coords, 303), K.constants(coords, 404)
    fold = K.constants(coords, 505)
    for batch in batches:
        ids = batch.column(0)
        for at, sets in K.shingle_sets(batch.column(1), n):
            size = np.array([len(s) for s in sets], dtype=np.int64)
            full = np.flatnonzero(size)
            sig = np.zeros((len(sets), coords), dtype=np.uint64)
            d1, d2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            if len(full):
                x = np.concatenate([sets[i] for i in full])
                first = np.concatenate([[0], np.cumsum(size[full])[:-1]])
                with np.errstate(over="ignore"):
                    d1[full] = np.add.reduceat(K.mix64(x ^ add[0]), first)
                    d2[full] = np.add.reduceat(K.mix64(x ^ add[1]), first)
                    for k in range(coords):
                        sig[full, k] = np.minimum.reduceat((x ^ add[k]) * mult[k], first)
                    sig = K.mix64(sig ^ fold)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(sets) + 1) * coords, coords, dtype=np.int32)), pa.array(K.signed(sig).ravel()))
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(sets)).cast(pa.int64()), batch.column(2).slice(at, len(sets)), pa.array(size), pa.array(K.signed(d1)), pa.array(K.signed(d2)), lists], ["doc_id", "t", "n_shingles", "d1", "d2", "sig"])


def signatures(docs: DataFrame, n: int, coords: int) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(lambda it: signature_batches(it, n, coords), SIGNATURE)


def _check(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        at = 0
        left = (s for _, sets in K.shingle_sets(batch.column(2), n) for s in sets)
        right = (s for _, sets in K.shingle_sets(batch.column(3), n) for s in sets)
        for a, b in zip(left, right):
            both = K.common(a, b)
            if both and den * both >= num * (len(a) + len(b) - both):
                keep.append(at)
            at += 1
        idx = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(idx), batch.column(1).take(idx)], ["u", "v"])


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (u, v) whose full sets have den * intersection >= num * union."""
    t = texts.select("doc_id", "text")
    one = pairs.join(t.withColumnsRenamed({"doc_id": "u", "text": "tu"}), "u")
    two = one.join(t.withColumnsRenamed({"doc_id": "v", "text": "tv"}), "v").select("u", "v", "tu", "tv")
    return two.mapInArrow(lambda it: _check(it, n, num, den), "u long, v long")


def _forest(ids: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Edges that connect what the links among these documents connect, one per document at most."""
    m = len(sets)
    size = np.array([len(x) for x in sets])
    if m <= 6:
        linked = np.zeros((m, m), dtype=bool)
        for i in range(m):
            for j in range(i + 1, m):
                if den * min(size[i], size[j]) >= num * max(size[i], size[j]):
                    both = K.common(sets[i], sets[j])
                    linked[i, j] = linked[j, i] = both > 0 and den * both >= num * (size[i] + size[j] - both)
    else:
        _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.cumsum(seen > 1) - 1
        row = np.repeat(np.arange(m), size)
        keep = seen[column] > 1
        row, column = row[keep], rank[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((m, m), dtype=np.float32)
        width = 2048
        edge = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else 0) + width + 1, width))
        for a, b in zip(edge[:-1], edge[1:]):
            if b > a:
                part = np.zeros((m, width), dtype=np.float32)
                part[row[a:b], column[a:b] % width] = 1
                both += part @ part.T
        count = both.astype(np.int64)
        linked = (count > 0) & (den * count >= num * (size[:, None] + size[None, :] - count))
        np.fill_diagonal(linked, False)
    label = np.arange(m)
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], m).min(axis=1))
        least = least[least]
        if (least == label).all():
            return [(ids[i], ids[label[i]]) for i in range(m) if label[i] != i]
        label = least


def _cells(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Links inside each cell; rows come sorted by cell, and a cell is bounded."""
    cell, ids, sets = None, [], []

    def done() -> pa.RecordBatch:
        edges = _forest(ids, sets, num, den) if len(ids) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["u", "v"])

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
        names = batch.column(3).to_pylist()
        for at, block in K.shingle_sets(batch.column(4), n):
            for k, x in enumerate(block):
                if keys[at + k] != cell:
                    if len(ids) > 1:
                        yield done()
                    cell, ids, sets = keys[at + k], [], []
                ids.append(names[at + k])
                sets.append(x)
    if len(ids) > 1:
        yield done()


def matched(pairs: DataFrame, sigs: DataFrame, match: int) -> DataFrame:
    """The pairs (u, v) whose signatures agree in at least match coordinates."""
    one = pairs.select("u", "v").join(sigs.withColumnsRenamed({"rep": "u", "sig": "su"}), "u")
    two = one.join(sigs.withColumnsRenamed({"rep": "v", "sig": "sv"}), "v")
    equal = F.aggregate(F.zip_with("su", "sv", lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x)
    return two.where(equal >= match).select("u", "v").distinct()


def _posting_pairs(now: DataFrame, keys: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v, hits): members of different components that meet in the listed postings, all of a bounded size."""
    lists = now.join(keys, "key", "left_semi").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rep", "comp", "n"))).alias("xs"))
    later = "filter(slice(xs, i + 2, size(xs)), y -> y.comp <> x.comp and {d} * least(x.n, y.n) >= {m} * greatest(x.n, y.n))".format(d=den, m=num)
    pairs = lists.select(F.explode(F.expr(f"flatten(transform(xs, (x, i) -> transform({later}, y -> struct(x.rep as u, y.rep as v))))")).alias("p"))
    return pairs.select("p.*").groupBy("u", "v").agg(F.count(F.lit(1)).alias("hits"))


def _chain_links(now: DataFrame, keys: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links among the documents that long postings chain together, in bounded cells."""
    chained = components(now.join(keys, "key").select(F.col("rep").alias("u"), F.col("hub").alias("v")))
    chained = stash(chained.withColumnsRenamed({"node": "doc_id", "component": "cluster"}).join(texts, "doc_id"), "clusters")
    size = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES), F.lit(1))
    cells = chained.join(chained.groupBy("cluster").agg(size.cast("int").alias("ways")), "cluster")
    cells = cells.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("ways")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, ways - 1)")))
    cells = cells.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc_id", "text")
    cells = cells.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "doc_id")
    return cells.mapInArrow(lambda it: _cells(it, n, num, den), "u long, v long")


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, coords: int = 32, match: int = 12) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (see the module)."""
    spark = docs.sparkSession
    sigs = stash(signatures(docs, n, coords), "signatures")
    least = F.min(F.struct("doc_id", "t")).alias("at")
    reps = sigs.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(least, F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("rows"))
    reps = stash(reps.select("d1", "d2", F.col("at.doc_id").alias("rep"), "at.t", "n", "sig", "rows"), "classes")
    prefix = coords - match + 1
    posts = reps.select("rep", "d1", "n", F.explode("sig").alias("key"))
    shared = stash(posts.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "postings")
    own = spread_join(posts, shared.withColumn("size", F.col("c")), "key", coords * reps.count())
    own = own.groupBy("rep", "d1", "n").agg(F.sort_array(F.collect_list(F.struct("size", "key"))).alias("own"))
    own = own.withColumn("need", F.size("own") + F.lit(prefix - coords)).where("need > 0")
    pre = stash(own.select("rep", "n", F.explode(F.expr("slice(own, 1, need)")).alias("x")).select("rep", "n", "x.key"), "prefixes")
    release(spark)

    pivots = pre.groupBy("key").agg(F.min_by("rep", F.xxhash64("rep")).alias("pivot"), F.count(F.lit(1)).alias("c")).where("c > 1")
    hits = spread_join(pre, pivots, "key", pre.count()).where("rep <> pivot").groupBy("rep", "pivot").agg(F.count(F.lit(1)).alias("hits"))
    star = hits.groupBy("rep").agg(F.max_by("pivot", F.struct("hits", "pivot")).alias("pivot"))
    vectors = reps.select("rep", "sig")
    star = stash(matched(star.select(F.col("rep").alias("u"), F.col("pivot").alias("v")), vectors, match), "star")
    need = reps.join(pre.select("rep").distinct(), "rep", "left_semi").select(F.col("rep").alias("doc_id"), "t")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("t")).join(need, ["doc_id", "t"], "left_semi")
    texts = stash(texts.dropDuplicates(["doc_id", "t"]).select("doc_id", "text"), "texts")
    links = stash(confirmed(star, texts, n, num, den), "links")
    comp = stash(components(links), "components")

    now = stash(pre.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("comp")), "members")
    mixed = now.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.min("rep").alias("hub"), F.count(F.lit(1)).alias("c")).where("a <> b")
    mixed = stash(mixed.select("key", "hub", "c"), "mixed")
    pairs = _posting_pairs(now, mixed.where(f"c <= {POSTING}"), num, den)
    more = stash(confirmed(stash(matched(pairs, vectors, match), "pairs"), texts, n, num, den), "more-links")
    long = mixed.where(f"c > {POSTING}").select("key", "hub")
    release(spark)
    edges = [links, more]
    if not long.isEmpty():
        comp = components(links.unionByName(more)).withColumnRenamed("node", "rep")
        here = now.drop("comp").join(long, "key", "left_semi").join(comp, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
        left = here.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key").join(long, "key")
        edges.append(stash(_chain_links(here, left, texts, n, num, den), "chain-links"))

    total, has = sigs.count(), F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    rows = sigs.select("doc_id", "n_shingles", "d1", "d2")
    named = spread_join(rows.where(has), reps.select("d1", "d2", "rep", F.col("rows").alias("c")), ["d1", "d2"], total).select("doc_id", "n_shingles", "rep")
    named = stash(named.unionByName(rows.where(~has).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("rep"))), "named")
    # Ids with several texts, of different classes or some of them empty.
    several = named.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.count("rep").alias("k"), F.count(F.lit(1)).alias("m"))
    several = several.where("a <> b or (k > 0 and k < m)").select("doc_id")
    ties = stash(named.where("rep is not null").join(several, "doc_id", "left_semi").select("doc_id", "rep").distinct(), "ids-with-several-texts")
    edges.append(ties.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    every = edges[0]
    for e in edges[1:]:
        every = every.unionByName(e.select("u", "v"))
    comp = components(every).withColumnRenamed("node", "rep")
    # A table, as the result holds it four times: a plan that spells it out each time fills the driver.
    classes = reps.groupBy("rep").agg(F.sum("rows").alias("c")).join(comp, "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"), "c")
    classes = stash(classes, "class-components")
    release(spark)
    by_id = ties.join(classes, "rep").groupBy("doc_id").agg(F.min("component").alias("own"))
    out = spread_join(named.where("rep is not null"), classes, "rep", total).select("doc_id", "n_shingles", "component")
    alone = named.where("rep is null").join(by_id, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("own", "doc_id").alias("component"))
    out = out.unionByName(alone).withColumnRenamed("component", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=3, num=85, den=100)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP3_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
f AS (SELECT g FROM x GROUP BY g HAVING count(*) BETWEEN 2 AND 1000000),
y AS (SELECT x.* FROM x JOIN f USING (g)),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM y a JOIN y b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT u, v FROM p UNION SELECT v, u FROM p),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.v, r.c FROM r JOIN e ON r.doc_id = e.u WHERE r.c < e.v)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""
