"""Operators on texts against brute force, with odd rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docflow.llm import common, decontaminate, kernel, near_dup, quality, shard, substring, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def corpus(seed=7, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of"] * 30
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 80))) for _ in range(n // 3)]
    passage = " ".join(rng.choice(vocab) for _ in range(30))
    out = []
    for i in range(n):
        t = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        if rng.random() < 0.2:
            t[len(t) // 2 : len(t) // 2] = passage.split()
        out.append((i * 3, " ".join(t), "en", f"src{i % 4}", 0, "clash"))
    out += [(1001, None, None, None, None, None), (1002, "", "en", "", 0, "x"), (1003, " \n\t ", "en", "s", 0, "x"), (1004, "one", "en", "s", 0, "x"), (1005, "one", "en", "s", 0, "x"), (1006, "A b", "en", "s", 0, "x"), (1007, "a B", "en", "s", 0, "x")]
    out += [(1010, "x" * 300_000 + " " + "y z " * 20_000, "en", "s", 0, "x"), (None, base[0], None, None, None, None), (0, out[0][1], "en", "src0", 0, "x")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


def test_word_kernel():
    import pyarrow as pa

    texts = [r[1] for r in corpus()] + ["a\x00b c", "é É", "x" * (3 << 20) + " y"]
    raw, off = kernel.utf8(pa.array(texts))
    h, first = kernel.words(raw, off)
    seen = {}
    for i, t in enumerate(texts):
        own = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in words(t)]
        assert first[i + 1] - first[i] == len(own)
        for a, b in zip(own, h[first[i] : first[i + 1]]):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def brute_components(rows, n, num, den):
    def shingles(t):
        w = [x.lower() if x.isascii() else x for x in words(t)]
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    ids = sorted({r[0] for r in rows if r[0] is not None})
    sets = {}
    for r in rows:
        if r[0] is not None:
            sets.setdefault(r[0], []).append(shingles(r[1]))
    comp = {i: i for i in ids}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = sorted((root(a), root(b)))
                comp[rb] = ra
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("n,num,posting", [(3, 85, 64), (5, 80, 1)])
def test_near_duplicates_brute(spark, docs, n, num, posting, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 3)
    monkeypatch.setattr(near_dup, "POSTING", posting)  # 1: chains and cells settle what the stars leave
    monkeypatch.setattr(common, "LIGHT", 3)
    got = near_dup.near_duplicates(docs, n, num, 100).collect()
    want = brute_components(corpus(), n, num, 100)
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert near_dup.near_duplicates(docs.limit(0), n, num, 100).count() == 0


def test_near_duplicates_of_shared_ids(spark):
    """Repeated rows, and ids with several texts: every row of an id has the id's component."""
    w, v, z = ("alpha beta gamma delta epsilon zeta eta theta " + x for x in ("one two three", "four five six seven", "eight nine ten eleven twelve"))
    rows = [(1, w), (2, v), (2, w), (3, v), (5, z), (5, z), (6, z), (7, ""), (7, z), (8, None), (9, ""), (None, w), (None, None), (4, "x y")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()
    want = brute_components(rows, 3, 85, 100)
    assert len(got) == len(rows) and want[3] == 1 and want[7] == 5
    assert all(r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id == r.component_id) for r in got)


def brute_substrings(rows, length=13):
    first = {}
    key = lambda d: float("inf") if d is None else d
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            first[k] = min(first.get(k, float("inf")), key(d))
    out = []
    for d, t, *_ in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < key(d):
                gone |= set(range(i, i + length))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_substrings_brute(spark, docs, small, monkeypatch):
    if small:  # hot anchors, many groups, parts and rounds
        for name, value in (("HOT", 2), ("GROUP_STRETCHES", 400), ("PART_WORDS", 300), ("GROUP_BYTES", 20_000), ("PACK", 500), ("BUCKET", 300)):
            monkeypatch.setattr(substring, name, value)
    got = sorted(map(tuple, substring.dedup_substrings(docs).collect()), key=str)
    assert got == brute_substrings(corpus())
    assert substring.dedup_substrings(docs.limit(0)).count() == 0


def test_substrings_take_a_fixed_number_of_jobs(spark, docs, monkeypatch):
    """What a task holds at once has no part in the number of jobs."""
    sc, jobs = spark.sparkContext, []
    for name, stretches in (("wide", substring.GROUP_STRETCHES), ("narrow", 100)):
        monkeypatch.setattr(substring, "GROUP_STRETCHES", stretches)
        sc.setJobGroup(name, name)
        got = sorted(map(tuple, substring.dedup_substrings(docs).collect()), key=str)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(name)))
        assert got == brute_substrings(corpus())
    sc.setJobGroup("rest", "rest")
    assert jobs[1] <= jobs[0] + 2


def test_substrings_of_shared_ids(spark):
    """Several null ids, and an id with several texts, of different lengths."""
    rng = random.Random(5)
    w = [f"w{i}" for i in range(300)]
    shared = [w[i * 30 : i * 30 + 30] for i in range(4)]
    own = lambda n: [rng.choice(w) + str(rng.randrange(10**6)) for _ in range(n)]
    rows = [(1, shared[0] + own(40)), (2, own(200) + shared[1]), (None, shared[0]), (None, own(150) + shared[1] + own(5)), (None, own(20) + shared[2]), (None, shared[2] + own(90) + shared[0])]
    rows += [(7, own(5) + shared[3] + own(3)), (7, own(120) + shared[0] + shared[3]), (9, shared[3] + own(30)), (None, own(60)), (3, own(14))]
    rows = [(i, " ".join(t)) for i, t in rows]
    rows += [rows[2], rows[3], (None, rows[5][1].replace(" ", "  ")), rows[7], (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring.dedup_substrings(docs).collect()), key=str) == brute_substrings(rows)


def test_automata_against_brute():
    rng = random.Random(2)
    texts = [np.array([rng.randrange(3) for _ in range(rng.randint(0, 30))], np.uint64) for _ in range(24)]
    ids = [rng.randrange(100) for _ in texts]
    halves = [(texts[:12], ids[:12]), (texts[12:], ids[12:])]
    s = substring.Shards([substring.Automaton.build(t, i) for t, i in halves])
    offset = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for k, (own, names) in enumerate(halves):
        for n in (1, 3, 5):
            hold, first = s.holders(np.full(len(texts), s.roots[k]), np.concatenate(texts), offset, n)
            for i, t in enumerate(texts):
                t = t.tolist()
                want = [min([d for x, d in zip(own, names) if any(x[q : q + n].tolist() == t[j : j + n] for q in range(len(x) - n + 1))], default=substring._LAST) for j in range(len(t) - n + 1)]
                assert hold[first[i] : first[i + 1]].tolist() == want


def test_decontamination_brute(spark, docs):
    rows = corpus()
    items = [(1, " ".join(rows[0][1].upper().split()[:20])), (2, "one"), (3, None), (4, ""), (5, "no such words in any text at all here"), (6, rows[4][1].replace(" ", ", ")), (6, rows[4][1].replace(" ", ", "))]
    b = spark.createDataFrame(items, "item_id long, text string")

    def sh(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    want = sorted(((d, i) for d, t, *_ in rows for i, q in dict(items).items() if sh(q) and 100 * len(sh(q) & sh(t)) >= 80 * len(sh(q))), key=str)
    got = decontaminate.contained(docs, b)
    assert sorted(((r.doc_id, r.item_id) for r in got.collect()), key=str) == want and want
    small = decontaminate.contained(docs, b, block_bytes=100)
    assert sorted(((r.doc_id, r.item_id) for r in small.collect()), key=str) == want
    clean = decontaminate.decontaminate(docs, b)
    assert clean.columns == docs.columns and clean.count() == len([r for r in rows if r[0] is None or r[0] not in {x[0] for x in want}])
    assert decontaminate.contained(docs, b.limit(0)).count() == 0


def test_shards(spark, docs):
    got = shard.shards(docs, 5, max_rows=8).collect()
    rows = corpus()
    assert len(got) == len(rows)
    import zlib

    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())))
    for r in got:
        assert (r.size, r.text_crc32) in by[r.doc_id] and 0 <= r.shard < 5 and r.law == "bytes"
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    even = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.repeat(F.lit("t"), (F.col("id") % 50).cast("int"))).alias("text"))
    sums = [r[0] for r in shard.shards(even, 40).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sums) == 40 and max(sums) - min(sums) <= 2 * 66
    assert shard.shards(even.limit(0)).count() == 0


def test_locate_ties():
    sh, sg = np.array([1, 5, 5, 5, 9]), np.array([0, 10, 20, 30, 0])
    h, g = np.array([0, 1, 5, 5, 5, 5, 9, 10]), np.array([0, 0, 5, 10, 25, 99, -1, 0])
    assert shard.locate(h, g, sh, sg).tolist() == [sum((a, b) <= (x, y) for a, b in zip(sh, sg)) for x, y in zip(h, g)]


def test_token_counts_and_cache(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    cache = str(tmp_path / "cache")
    got = tokens.count_tokens(docs, cache)
    want = sorted((r[0], len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in corpus() if r[0] is not None)
    assert sorted(map(tuple, got.where("doc_id is not null").collect())) == want
    n = spark.read.parquet(cache).count()
    assert n == len({r[1] or "" for r in corpus()})
    again = tokens.count_tokens(docs.limit(5), cache)
    assert again.count() == 5 and spark.read.parquet(cache).count() == n
    assert tokens.count_tokens(docs.limit(0), cache).count() == 0


def test_token_cache_serves_a_whole_table(spark, tmp_path, monkeypatch):
    """A second run over the same table encodes nothing and gives the same counts."""
    sf = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    cache = str(tmp_path / "cache")
    monkeypatch.setattr(tokens, "SHARE", 100)
    first = sorted(tokens.count_tokens(sf, cache).collect())
    n = spark.read.parquet(cache).count()

    def none_left(batches, path):
        for batch in batches:
            assert batch.num_rows == 0, "a miss"
            yield pa.RecordBatch.from_pylist([], pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())]))

    monkeypatch.setattr(tokens, "_encode", none_left)
    assert sorted(tokens.count_tokens(sf, cache).collect()) == first and spark.read.parquet(cache).count() == n
    monkeypatch.undo()
    monkeypatch.setattr(tokens, "SHARE", 100)
    many = sf.limit(1).crossJoin(spark.range(500)).unionByName(sf.withColumn("id", F.lit(0).cast("long"))).drop("id")
    assert tokens.count_tokens(many, cache).count() == 500 + sf.count()


def test_memo_keeps_within_bounds(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 50)
    c, whole = tokens.Counter(tokens.tokenizer_path()), None
    texts = [" ".join(f"w{i * j % 97}" for j in range(40)) for i in range(1, 60)]
    whole = c.encode(texts)
    assert [int(c.counts(pa.array([t]))[0]) for t in texts] == whole and c.counts(pa.array(texts)).tolist() == whole


def test_piecewise_counts_equal_library():
    from tokenizers import Tokenizer

    t, c, rng = Tokenizer.from_file(tokens.tokenizer_path()), tokens.Counter(tokens.tokenizer_path()), random.Random(4)
    alphabet = ["a", "B", " ", "  ", "\n", "\t", " ", "'s", "1", "é", ".", "!!", "<|endoftext|>", "word", "　", "😀", "\r\n", "\x1c", "\x85"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    alphabet = ["a", "Bc", " ", " ", "\n", "'s", "'", "1", "é", "ß.", ".", "!!", "-", "<|", "|>", "endoftext", "_", "×", "y:", "\x01", "«"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    assert c.counts(pa.array(texts)).tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    bpe = tokens.Counter(tokens.tokenizer_path("piece_bpe_32k.model"))
    assert bpe.counts(pa.array(["hello world"]))[0] > 1
    assert c.counts(pa.array([None, "", "a b"], pa.string())).tolist()[:2] == [0, 0] and c.counts(pa.array([], pa.string())).tolist() == []


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 4 <> 1"))
    assert list(model.thresholds) == sorted(model.thresholds) and (model.weights < 0).all()
    got = quality.scored(docs, model, ["doc_id"]).join(labels.where("doc_id % 4 = 1"), "doc_id").toPandas()
    good = (got.quality == 1) & (got.toxic == 0)
    assert got.keep[good].mean() > 0.97 and got.keep[got.toxic == 1].mean() < 0.1 and got.keep[got.quality == 0].mean() < 0.1
    assert got.expected_grade[good].mean() > 1.8


def test_quality_odd_inputs(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, none) is None
    kept = quality.select_quality(docs, none)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    labels = spark.createDataFrame([(i * 3, i % 2, None) for i in range(40)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    out = quality.select_quality(docs.withColumn("keep", F.lit(1)), labels)
    assert "keep" in out.columns
    assert quality.scored(docs, quality.fit(docs, labels), ["doc_id"]).count() == docs.count()


def test_quality_whole_hashes(spark):
    docs = spark.createDataFrame([(1, "nothing against this"), (2, "one badword here")], "doc_id long, text string")
    h = next(iter(quality._parts(pa.array(["badword"]))))[3][0][1]
    for words, p in ((h, 0.27), (h ^ np.uint64(1), 0.88)):  # a hash that differs in its last bit is another word
        got = {r.doc_id: r.p_good for r in quality.scored(docs, quality.Model(words, np.array([-3.0]), np.zeros(1 << 16), np.array([-3.0, -2.0])), ["doc_id"]).collect()}
        assert abs(got[1] - 0.88) < 0.01 and abs(got[2] - p) < 0.01


def test_quality_samples_5000(spark):
    docs = spark.range(5200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "fine text").otherwise("awful text").alias("text"))
    labels = docs.select("doc_id", ((F.col("doc_id") + 1) % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    used = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(5000).groupBy("quality").count().collect()
    model, same = quality.fit(docs, labels), quality.fit(docs, labels, sample=5000)
    assert sum(r["count"] for r in used) == 5000 and all(np.array_equal(a, b) for a, b in zip(model, same))
    awful = next(iter(quality._parts(pa.array(["awful"]))))[3]
    fine = next(iter(quality._parts(pa.array(["fine text"]))))[3]
    assert set(model.words) == {x for _, h in awful for x in h.tolist()} and not set(model.words) & {x for _, h in fine for x in h.tolist()}
