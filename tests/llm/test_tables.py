"""SQL parity, mixing, URL rules, vectors, and the pipeline."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docflow.llm import common, mixing, near_dup, registry, urls, vectors
from tests.llm.test_texts import brute_components
from tests.oracle import SF, agree

Q, O = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, name):
    df = Q[name](spark, SF)
    if name in O:
        agree(df, O[name])
    else:
        assert df.count() > 0


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5, None), (7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    comp = {}

    def root(x):
        while comp.setdefault(x, x) != x:
            x = comp[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            lo, hi = sorted((root(a), root(b)))
            comp[hi] = lo
    assert got == {x: root(x) for x in comp}


def test_components_of_hubs_and_paths(spark):
    star = spark.range(1, 100_000).selectExpr("id + 50000 as u", "7 as v")
    path = spark.range(200_000, 210_000).selectExpr("id as u", "id + 1 as v")
    got = common.components(star.unionByName(path)).groupBy("component").count().collect()
    assert {(r.component, r["count"]) for r in got} == {(7, 100_000), (200_000, 10_001)}
    assert common.components(star.limit(0)).count() == 0


def test_mixing_shares(spark):
    rows = [(i, "w " * 10, "en" if i % 2 else "de", f"src{i % 8}", 0) for i in range(800)] + [(None, None, None, None, None), (900, "", "fr", "odd", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"p": F.lit(1), "cap": F.lit("x")})
    got = mixing.mix(docs, share_of=(1, 2), max_epochs=2)
    total = got.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0]
    assert 0.47 * 8000 < total <= 4000
    by = {r.domain: r.t for r in got.groupBy("domain").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t")).collect()}
    assert by["0"] > by["1"] > by["2"] > by["3"]
    every = mixing.mix(docs, share_of=(3, 1), max_epochs=2)
    assert every.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0] == 16000
    own = mixing.mixed_documents(docs)
    assert own.columns == docs.columns and own.count() <= docs.count()
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_plan_runs_no_python(spark):
    plan = mixing.op2_hierarchical_mixing(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_url_rules(spark):
    cases = [
        ("http://Example.com/en/x", "example.com/en/", "block"),
        ("https://www.example.com/en/x?y", "www.example.com/en/", "allow"),
        ("https://a.www.example.com/en/", "www.example.com/en/", "allow"),
        ("http://notexample.com/en/", "com/", "allow"),
        ("http://x.net/es/1", "net/es/", "block"),
        ("http://x.net/es", None, "allow"),
        ("http://x.com", None, "allow"),
        ("http://x.com?q=/", None, "allow"),
        ("no scheme", None, "allow"),
        (None, None, "allow"),
        ("://com/", "com/", "allow"),
    ]
    pages = spark.createDataFrame([(i, u, None) for i, (u, _, _) in enumerate(cases)] + [(0, cases[0][0], None), (None, "http://x.net/fr/", None)], "page_id long, url string, html string").withColumn("verdict", F.lit("clash"))
    rules = spark.createDataFrame([*urls.RULES, (None, "block"), ("com/", "allow")], "rule string, verdict string")
    got = urls.judge(pages, rules).collect()
    assert len(got) == len(cases) + 2
    for r in got:
        if r.page_id is None:
            assert (r.rule, r.verdict) == ("net/fr/", "block")
        else:
            assert (r.rule, r.verdict) == cases[r.page_id][1:], cases[r.page_id]
    tiny = urls.judge(pages, rules, log2_bits=9).collect()
    assert sorted(map(str, tiny)) == sorted(map(str, got))
    assert {r.verdict for r in urls.judge(pages, rules.limit(0)).collect()} == {"allow"}
    assert urls.judge(pages.limit(0), rules).count() == 0


def test_vectors_are_dealt_once(spark):
    """Many groups: links as by brute force, and rows shuffled don't grow with the number of groups."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((2500, 24))
    x = np.concatenate([base, base[:400] + 0.2 * rng.standard_normal((400, 24)), base[0] + 0.05 * rng.standard_normal((300, 24))]).astype(np.float32)
    df = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "vec_id long, embedding array<float>")
    gateway = spark.sparkContext._gateway
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        none = gateway.jvm.java.util.ArrayList()
        stages = store.stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = shuffled()
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(df, block=100).collect()}
    assert shuffled() - before < 6 * x.nbytes
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert want.max() >= 300 and got == dict(enumerate(want.tolist()))


def test_vectors_brute(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((20, 16))
    x = [base[rng.integers(20)] + rng.standard_normal(16) * rng.choice([0, 0.1, 0.2, 0.4]) for _ in range(150)]
    rows = [(i, [float(v) for v in a]) for i, a in enumerate(x)]
    rows += [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] * 16), (204, [1.0, None]), (205, [1.0, 2.0]), (206, [2.0, 4.0]), (207, [float(v) for v in x[0]]), (None, [float(v) for v in x[0]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit(1))
    links = {i: set() for i, _ in rows if i is not None}
    ok = {i: np.array(v) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    for a in ok:
        for b in ok:
            if a != b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.9:
                links[a].add(b)

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return min(seen)

    for block in (4096, 20):
        got = vectors.near_vectors(df, block=block).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.vec_id is None:
                assert r.n_links == 0 and r.kept
            else:
                assert (r.n_links, r.component_id) == (len(links[r.vec_id]), reach(r.vec_id)), r
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_pipeline_stages(spark):
    docs = common.table(spark, SF, "documents")
    seen, cols = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stash(stage(spark, seen, SF), name)
        assert out.columns == cols
        assert out.select("doc_id").exceptAll(seen.select("doc_id")).count() == 0
        seen = out
    last = corpus_pipeline.STAGES[-1][1](spark, seen, SF)
    assert last.count() == seen.count() and last.select("shard").distinct().count() <= 40
    run = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in run.collect()) == sorted(r.doc_id for r in last.collect())


def test_pipeline_removals_against_brute_force(spark):
    """The near-dedup and decontamination stages on a whole table, with repeated rows and null ids added."""
    docs = common.table(spark, SF, "documents")
    some = docs.where("doc_id < 20")
    docs = docs.unionByName(some).unionByName(some.withColumn("doc_id", F.lit(None).cast("long"))).cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    comp = brute_components(rows, 5, 80, 100)
    kept = corpus_pipeline.deduplicate(spark, docs, SF)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns and sorted(i for i in ids if i is not None) == sorted(i for i in comp if comp[i] == i)
    assert ids.count(None) == sum(i is None for i, _ in rows)

    def grams(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    items = [grams(r.text) for r in common.table(spark, SF, "benchmark").collect()]
    leaks = {i for i, t in rows for g in [grams(t)] for q in items if i is not None and q and 100 * len(q & g) >= 80 * len(q)}
    left = {r.doc_id for r in corpus_pipeline.remove_leaks(spark, docs, SF).select("doc_id").collect()}
    assert left == {i for i, _ in rows} - leaks and leaks


def test_near_dup_plans_stay_small(spark):
    """What a result reads several times is a table by then; spelt out in the plan, it filled the driver."""
    docs = common.table(spark, SF, "documents")
    for df in (near_dup.near_duplicates(docs), corpus_pipeline.deduplicate(spark, docs, SF)):
        assert df._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 10
