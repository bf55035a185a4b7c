import random
import re

import pytest
from pyspark.sql import functions as F

from docflow.functions import text as T
from docflow.functions import values as V
from docflow.operators import chunker as C
from docflow.operators import generators as G
from docflow.operators import joins
from docflow.plans import batches, provider


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


def test_paragraphs_and_segments(spark):
    assert one(spark, G.paragraphs(F.lit("\nalpha\n \nbeta\n  gamma\n\n\ndelta\n"))) == ["alpha", "beta\n  gamma", "delta"]
    got = one(spark, G.segments(F.lit("a" * 1800 + ". " + "b" * 50 + ".")))
    assert [len(x) for x in got] == [1801, 51]
    assert one(spark, G.segments(F.lit(""))) == [""]


def test_paragraphs_against_model(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "b c", "\n", "\n", "\r\n", " ", "\t", "\r", "　"]) for _ in range(rng.randint(0, 16))) for _ in range(400)] + ["", "x\n" * 20_000 + "\n" * 20_000 + "y"]
    blank = "\t\n\x0b\x0c\r \x85\xa0　"

    def model(t):
        out, run = [], []
        for line in [*re.split("\r?\n", t), ""]:
            if line.strip(blank):
                run.append(line)
            elif run:
                out.append("\n".join(run).strip(blank))
                run = []
        return out

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", G.paragraphs(F.col("t")).alias("x")).collect()
    assert all(r.x == model(r.t) for r in got)


def test_markdown_precedence(spark):
    text = "# T\n\npara one\ntwo\n- item\n. x\n```\n# code\n~~~\n> q\nhttps://x.y\n####### no\n```\nopen"
    kinds = [b.block_type for b in one(spark, G.markdown_blocks(F.lit(text)))]
    assert kinds == ["heading", "metadata", "paragraph", "list_item", "list_item", "code", "blockquote", "url", "paragraph", "code"]


def test_clean_repeats_against_model(spark):
    def model(s):
        out, last, gap = [], None, ""
        for ch in s:
            if re.match(T.WS.replace("\\x0B", "\x0b"), ch):
                if last:
                    gap += ch
                else:
                    out.append(ch)
                continue
            if ch == last:
                gap = ""
                continue
            out.append(gap)
            gap = ""
            out.append(ch)
            last = ch if ch in T.MARKS else None
        return "".join(out) + gap if not (last and gap) else "".join(out) + gap

    rng = random.Random(3)
    texts = ["".join(rng.choice("a .,!?;: \n。，！") for _ in range(rng.randint(0, 14))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.clean_repeats(F.col("t")).alias("x")).collect()
    for r in got:
        m = model(r.t)
        assert r.x.rstrip() == m.rstrip(), r.t
    assert one(spark, T.clean_repeats(F.lit("so;;; it!! goes...on"))) == "so; it! goes.on"
    assert one(spark, T.clean_repeats(F.lit("end: , next"))) == "end: , next"


def test_page_selections(spark):
    assert one(spark, V.selected_pages(F.lit("1-3, 3,5"), F.lit(5))) == [1, 2, 3, 5]
    assert one(spark, V.selection_text(F.array(*[F.lit(i) for i in (1, 2, 3, 5)]))) == "1-3,5"
    assert one(spark, V.selected_pages(F.lit("3-1,9"), F.lit(5), strict=False)) == [1, 2, 3]
    assert one(spark, V.selected_pages(F.lit("all"), F.lit(3), strict=False)) == [1, 2, 3]
    for bad in ("2,6", "3-1", "x", "0", ""):
        with pytest.raises(Exception, match="bad page selection"):
            one(spark, V.selected_pages(F.lit(bad), F.lit(5)))


def test_small_rules(spark):
    assert one(spark, T.language_dir(F.lit("../en"))) == "en"
    assert one(spark, V.run_chunk_size(F.lit("lightning"), F.lit(30))) == 100
    assert one(spark, V.run_chunk_size(F.lit("lightning"), F.lit(31))) == 10
    assert one(spark, V.run_chunk_size(F.lit("llama"), F.lit(400))) == 10
    assert one(spark, T.is_compact(F.lit("ZH"), "exact_case")) is False
    assert one(spark, T.is_compact(F.lit("ZH"))) is True
    assert one(spark, T.is_compact(F.lit("kok"), "code")) is False
    assert one(spark, T.percent(F.lit("a 12% b 13%"))) == 12
    assert one(spark, T.trim(F.lit("　\t x　"))) == "x"


def test_semver_order(spark):
    order = ["1.0.0-1", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-beta", "1.0.0", "v1.0.1", "1.10.0", "2.0.0-rc.1", "2.0.0+b"]
    got = spark.createDataFrame([(v,) for v in reversed(order)], "v string").orderBy(T.semver_key(F.col("v"))).collect()
    assert [r.v for r in got] == order
    assert one(spark, T.semver_key(F.lit("1.x.0"))) is None


def test_batch_plan_against_model(spark):
    def cap(c, n):
        return max(1, min(c, c if n <= 800 else -(-c // 2) if n <= 1600 else -(-c // 3) if n <= 2500 else 1))

    rng = random.Random(5)
    for _ in range(30):
        lengths, c = [rng.choice([10, 700, 900, 1700, 3000]) for _ in range(rng.randint(1, 25))], rng.randint(1, 12)
        want, size, longest, b = [], 0, 0, 0
        for n in lengths:
            if size and size + 1 > cap(c, max(longest, n)):
                b, size, longest = b + 1, 0, 0
            size, longest = size + 1, max(longest, n)
            want.append(b)
        assert one(spark, batches.batch_numbers(F.array(*[F.lit(n) for n in lengths]), c)) == want


def test_chunker():
    p = C.PROFILES["standard"]
    assert C.chunks("", p) == [""]
    assert C.chunks("Short text.", p) == ["Short text."]
    assert C.sentence_units("See Fig. 1 now. It is 3.14 wide! Yes") == ["See Fig. 1 now.", "It is 3.14 wide!", "Yes"]
    assert C.semantic_units("Figure 1. A cat. End.") == ["Figure 1. A cat.", "End."]
    assert C.reference_units("lost [1] A. [2] B") == ["[1] A.", "[2] B"]
    assert C.normalise("trans-\n lation well-Known") == "translation well-Known"
    rng = random.Random(1)
    for name in C.PROFILES:
        p = C.PROFILES[name]
        for _ in range(20):
            t = " ".join("w" * rng.randint(1, 30) + rng.choice(["", "", ".", "!"]) for _ in range(rng.randint(0, 200)))
            got = C.chunks(t, p)
            assert "".join("".join(got).split()) == "".join(C.normalise(t).split())
            assert all(C.estimate(c) <= p.body.hard for c in got)
    assert C.profile_for_context(1024) == "llama_wide" and C.profile_for_context(1023) == "llama_narrow"


def test_provider_contract():
    assert provider.call(["a"], provider.stub, "en", "ja") == (["ja:a"], None)
    out, err = provider.call(["a", "b"], lambda t, s, g: ["x"], "en", "ja")
    assert out == [None, None] and "expected 2" in err

    def weak(texts, s, g):
        if len(texts) > 1:
            raise RuntimeError("too many")
        return texts

    assert provider.call(["a", "b", "c"], weak, "en", "ja", (2, 1)) == (["a", "b", "c"], None)


def test_json_answers(spark):
    answer = F.lit('{"choices":[{"index":1,"message":{"content":" b "}},{"index":0,"message":{"content":"a"}},{"index":9,"message":{"content":""}}]}')
    assert one(spark, V.translations(answer, F.lit(2)))["texts"] == ["a", "b"]
    assert one(spark, V.translations(answer, F.lit(3)))["error"] == "missing choice 2"
    assert one(spark, V.translations(F.lit("{"), F.lit(1)))["error"] == "bad JSON"
    stream = F.lit('data: {"choices":[{"index":0,"delta":{"content":"he"}}]}\n\ndata: {"choices":[{"index":0,"delta":{"content":"y "}}]}\ndata: [DONE]')
    assert one(spark, V.streamed_translations(stream, F.lit(1)))["texts"] == ["hey"]


def test_replayed_windows(spark):
    times = F.array(*[F.lit(t).cast("long") for t in (0, 10, 20, 90, 91, 92, 93, 400)])
    assert one(spark, batches.windowed_batches(times, 3, 80)) == [0, 0, 0, 1, 1, 1, 2, 3]


def test_requests_in_runs_against_model(spark):
    """Windows of one and of several slots, null contexts, null and repeated runs; requests are not shuffled by run."""
    rng = random.Random(11)
    hour, ctx = 3_600_000, ["a", "b", "c", None]
    req = [(i, rng.randrange(9), rng.randrange(-2 * hour, 9 * hour), ctx[rng.randrange(4)]) for i in range(300)]
    req += [(300 + i, 1, 20 * hour + i * hour // 4, None) for i in range(12)] + [(400, 1, None, "a"), (401, None, 5 * hour, "a"), (402, 2, 30 * hour + 10, "a"), (403, 2, 31 * hour - 10, "a"), (404, 2, 30 * hour + hour // 2, "b")]
    runs = [(i, s := rng.randrange(-2 * hour, 9 * hour), s + rng.choice([0, 1000, hour // 3, hour, 3 * hour, -8000, -12000]), rng.choice(["a", "b", "x", None])) for i in range(120)]
    runs += [(200, 20 * hour, 23 * hour, "a"), (201, 20 * hour + 5000, 20 * hour + 9000, "a"), (5, 0, hour, "c"), (None, 0, hour, "a"), (202, None, hour, "a"), (203, 30 * hour + hour // 2 - 9, 30 * hour + hour // 2 + 9, "a")]
    q = spark.createDataFrame(req, "event_id long, run_id long, timestamp_ms long, context string")
    r = spark.createDataFrame(runs, "run_id long, start_ms long, end_ms long, wanted string")
    hits = [(i, w, e, c) for i, s, t, w in runs if i is not None and s is not None for e, _, ts, c in req if ts is not None and s - 5000 <= ts <= t + 5000]
    some = {}
    for i, w, _, c in hits:
        some.setdefault(i, []).append(None if w is None or c is None else w == c)
    some = {i: None if all(x is None for x in v) else any(x is True for x in v) for i, v in some.items()}
    want = sorted((i, e) for i, w, e, c in hits if (w is not None and w == c) or some[i] is False)
    out = joins.requests_in_runs(q, r)
    assert out.columns == ["run_id", "start_ms", "end_ms", "wanted", "event_id", "q_run", "timestamp_ms", "context"]
    assert sorted(map(tuple, out.select("run_id", "event_id").collect())) == want
    last = next(x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x)
    assert re.search(r"\(slot#\d+L? = slot#\d+L?\)", last) and "run_id" not in last, last
