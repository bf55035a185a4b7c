"""Queries of roll-ups, joins, ordered operators and keyed state, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.fixtures import PAGES, SEG, pages, segments, sql_blank, sql_trim, table
from docflow.operators import export, joins, rollup, state
from docflow.plans import batches, provider

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


_KEPT = f"status <> 'skipped' AND NOT ({sql_blank('source_text')})"
_STATE = "CASE WHEN translating_segments > 0 THEN 'translating' WHEN failed_segments > 0 THEN 'failed' WHEN segment_count > 0 AND completed_segments = segment_count THEN 'translated' ELSE 'untranslated' END"
_COUNTS = "count(*) AS segment_count, count(*) FILTER (status IN ('done', 'edited')) AS completed_segments, count(*) FILTER (status = 'failed') AS failed_segments, count(*) FILTER (status = 'translating') AS translating_segments"
_FILES = f"""{SEG}, allf AS (SELECT DISTINCT 'job-' || source AS job_id, 'file-' || unnest([1, 2, 3, 9]) AS file_id FROM documents),
fc AS (SELECT job_id, coalesce(file_id, 'file-1') AS file_id, {_COUNTS} FROM seg WHERE {_KEPT} GROUP BY ALL),
fl AS (SELECT job_id, file_id, coalesce(segment_count, 0) AS segment_count, coalesce(completed_segments, 0) AS completed_segments, coalesce(failed_segments, 0) AS failed_segments, coalesce(translating_segments, 0) AS translating_segments FROM allf LEFT JOIN fc USING (job_id, file_id)),
files AS (SELECT *, {_STATE} AS translation_status FROM fl)"""


def all_files(spark, d):
    return table(spark, d, "documents").select(F.concat(F.lit("job-"), "source").alias("job_id")).distinct().select("job_id", F.explode(F.array(*[F.lit(f"file-{i}") for i in (1, 2, 3, 9)])).alias("file_id"))


@query(f"WITH {_FILES} SELECT * FROM files")
def agg_01_join_05_files(spark, d):
    return rollup.files(all_files(spark, d), segments(spark, d), ["job_id"])


@query(f"WITH {SEG} SELECT *, CASE WHEN busy > 0 THEN 'translating' WHEN failed_segments > 0 THEN 'failed' WHEN completed_segments = segment_count THEN 'completed' ELSE 'ready' END AS status FROM (SELECT job_id, count(*) AS segment_count, count(*) FILTER (status IN ('done', 'edited', 'skipped')) AS completed_segments, count(*) FILTER (status = 'failed') AS failed_segments, count(*) FILTER (status = 'translating') AS busy FROM seg GROUP BY job_id)".replace("SELECT *, CASE", "SELECT * EXCLUDE (busy), CASE"))
def agg_02_25_jobs(spark, d):
    return rollup.jobs(segments(spark, d))


@query(f"WITH {_FILES}, j AS (SELECT job_id, CAST(sum(segment_count) AS BIGINT) AS segment_count, CAST(sum(completed_segments) AS BIGINT) AS completed_segments, CAST(sum(failed_segments) AS BIGINT) AS failed_segments, CAST(sum(translating_segments) AS BIGINT) AS translating_segments FROM files GROUP BY job_id) SELECT *, CASE WHEN translating_segments > 0 THEN 'translating' WHEN failed_segments > 0 THEN 'failed' WHEN segment_count > 0 AND completed_segments = segment_count THEN 'completed' ELSE 'ready' END AS status FROM j")
def agg_03_jobs_from_files(spark, d):
    return rollup.jobs_from_files(rollup.files(all_files(spark, d), segments(spark, d), ["job_id"]))


@query(f"WITH {SEG}, t AS (SELECT job_id, target_lang, {_COUNTS} FROM seg WHERE status <> 'skipped' GROUP BY ALL) SELECT *, {_STATE} AS status FROM t")
def agg_04_translation_files(spark, d):
    return rollup.translation_files(segments(spark, d), ["job_id", "target_lang"])


@query(f"WITH {SEG} SELECT block_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_and(status = 'done') THEN 'done' WHEN bool_or(status = 'translating') THEN 'translating' ELSE 'pending' END AS status, CASE WHEN bool_or(status = 'translating') THEN 'translating' WHEN bool_or(status = 'pending') THEN 'queued' WHEN bool_or(status IN ('done', 'edited')) THEN 'translated' ELSE 'idle' END AS activity FROM seg GROUP BY block_id")
def agg_05_06_blocks(spark, d):
    s = segments(spark, d)
    return rollup.block_states(s).join(rollup.block_activity(s), "block_id")


_PSUM = "CASE WHEN page_count > 0 AND translated = page_count THEN 'translated' WHEN translated > 0 THEN 'partial' WHEN failed > 0 THEN 'failed' ELSE 'untranslated' END AS status"


@query(f"WITH {PAGES} SELECT *, greatest(0, page_count - translated - failed) AS pending, {_PSUM} FROM (SELECT job_id, count(*) AS page_count, count(*) FILTER (status = 'translated') AS translated, count(*) FILTER (status = 'failed') AS failed FROM pg GROUP BY job_id)")
def agg_07_08_24_page_summary(spark, d):
    return rollup.page_summary(pages(spark, d))


@query("WITH f AS (SELECT source AS job_id, CASE WHEN source IN ('src1', 'src2') THEN 'en' WHEN source = 'src3' THEN NULL ELSE lang END AS lang FROM documents) SELECT job_id, CASE WHEN count(*) = count(lang) AND min(lang) = max(lang) THEN min(lang) END AS lang FROM f GROUP BY job_id")
def agg_21_agreed_language(spark, d):
    f = table(spark, d, "documents").select(F.col("source").alias("job_id"), F.when(F.col("source").isin("src1", "src2"), "en").when(F.col("source") == "src3", None).otherwise(F.col("lang")).alias("lang"))
    return rollup.agreed(f, "lang")


@query(f"WITH {SEG} SELECT job_id, coalesce(file_id, 'none') AS file_id, count(*) AS n, count(DISTINCT segment_id) AS ids, string_agg(translated_text, '' ORDER BY segment_id) AS joined FROM seg WHERE NOT ({sql_blank(chr(99) + 'oalesce(translated_text, ' + chr(39) * 2 + ')')}) GROUP BY ALL")
def agg_22_map_01_revisions(spark, d):
    r = rollup.revisions(segments(spark, d), ["job_id", "file_id"])
    return r.select("job_id", F.coalesce("file_id", F.lit("none")).alias("file_id"), F.size("entries").cast("long").alias("n"), F.size(F.map_keys(F.map_from_entries("entries"))).cast("long").alias("ids"), F.array_join(F.transform("entries", lambda x: x["translated_text"]), "").alias("joined"))


@query(f"WITH {SEG} SELECT doc_id, count(*) > 0 AND bool_and(status IN ('done', 'edited') AND NOT ({sql_blank(chr(99) + 'oalesce(translated_text, ' + chr(39) * 2 + ')')})) AS ready FROM seg WHERE {_KEPT} GROUP BY doc_id")
def prd_10_11_export_ready(spark, d):
    return rollup.export_ready(segments(spark, d), ["doc_id"])


_TRANS = "tr AS (SELECT segment_id, doc_id, idx, 'T' || source_text AS translated_text, CASE WHEN idx % 4 = 0 THEN 'failed' ELSE 'done' END AS status, idx AS position FROM seg WHERE (doc_id + idx) % 3 = 0 UNION ALL SELECT segment_id, doc_id, idx, 'U' || source_text, 'edited', idx + 1000 FROM seg WHERE (doc_id + idx) % 6 = 0)"


def translations(spark, d):
    s = segments(spark, d)
    one = s.where("(doc_id + idx) % 3 = 0").select("segment_id", F.concat(F.lit("T"), "source_text").alias("translated_text"), F.when(F.col("idx") % 4 == 0, "failed").otherwise("done").alias("status"), F.col("idx").alias("position"))
    two = s.where("(doc_id + idx) % 6 = 0").select("segment_id", F.concat(F.lit("U"), "source_text").alias("translated_text"), F.lit("edited").alias("status"), (F.col("idx") + 1000).alias("position"))
    return one.unionByName(two)


@query(f"WITH {SEG}, {_TRANS}, l AS (SELECT segment_id, max_by(translated_text, position) AS t, max_by(status, position) AS st FROM tr GROUP BY segment_id) SELECT segment_id, CASE WHEN st IS NULL THEN translated_text ELSE t END AS translated_text, coalesce(st, status) AS status, 'ko' AS target_lang FROM seg LEFT JOIN l USING (segment_id)")
def join_01_translated_segments(spark, d):
    return joins.translated_segments(segments(spark, d), translations(spark, d), F.lit("ko")).select("segment_id", "translated_text", "status", "target_lang")


@query(f"WITH {SEG}, {_TRANS}, l AS (SELECT segment_id, max_by(status, position) AS st FROM tr GROUP BY segment_id) SELECT doc_id, idx, segment_id, coalesce(st, 'pending') AS state FROM seg LEFT JOIN l USING (segment_id) WHERE coalesce(st, 'pending') IN ('pending', 'failed') AND {_KEPT}")
def join_02_run_targets(spark, d):
    t = joins.last_per_key(translations(spark, d), ["segment_id"], ["position"])
    return joins.run_targets(segments(spark, d), t, ["pending", "failed"]).select("doc_id", "idx", "segment_id", F.col("t_status").alias("state"))


@query(f"WITH {SEG} SELECT segment_id, status FROM seg WHERE doc_id % 4 = 1 AND idx % 2 = 0 AND segment_id IN (SELECT segment_id FROM seg WHERE status <> 'skipped')")
def join_03_16_requested(spark, d):
    s = segments(spark, d)
    return joins.requested(s, s.where("doc_id % 4 = 1 and idx % 2 = 0"), s.select("segment_id", "status")).select("segment_id", "status")


_OWN = f"CASE WHEN {sql_blank(chr(99) + 'oalesce(translated_text, ' + chr(39) * 2 + ')')} THEN source_text ELSE translated_text END"
_BLOCKS = f"bl AS (SELECT block_id, doc_id, min(idx) AS ord, string_agg(source_text, chr(10) ORDER BY idx) AS block_text FROM seg GROUP BY ALL), jt AS (SELECT block_id, any_value(target_lang) AS lang, string_agg({sql_trim(_OWN)}, ' ' ORDER BY idx) AS spaced, string_agg({sql_trim(_OWN)}, '' ORDER BY idx) AS tight FROM seg GROUP BY block_id)"
_TEXT = f"bt AS (SELECT bl.*, CASE WHEN lang = 'en' THEN spaced ELSE tight END AS j FROM bl JOIN jt USING (block_id)), btx AS (SELECT * EXCLUDE j, CASE WHEN {sql_blank('j')} THEN block_text ELSE j END AS text FROM bt)"


def blocks(spark, d):
    s = segments(spark, d)
    b = s.groupBy("block_id", "doc_id").agg(F.min("idx").alias("ord"), F.array_sort(F.collect_list(F.struct("idx", "source_text"))).alias("xs"))
    return b.select("block_id", "doc_id", "ord", F.array_join(F.transform("xs", lambda x: x["source_text"]), "\n").alias("block_text"))


@query(f"WITH {SEG}, {_BLOCKS}, {_TEXT} SELECT block_id, text FROM btx")
def join_04_dml_04_block_texts(spark, d):
    return joins.block_texts(blocks(spark, d), segments(spark, d)).select("block_id", "text")


@query(f"WITH {_FILES} SELECT job_id, file_id, coalesce(t.status, files.translation_status) AS translation_status FROM files LEFT JOIN (SELECT job_id, 'file-1' AS file_id, CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'failed' ELSE 'translated' END AS status FROM seg GROUP BY job_id) t USING (job_id, file_id)")
def join_06_prj_02_file_status(spark, d):
    f = rollup.files(all_files(spark, d), segments(spark, d), ["job_id"])
    t = segments(spark, d).groupBy("job_id").agg(F.when(F.count_if(F.col("status") == "failed") > 0, "failed").otherwise("translated").alias("s")).withColumn("file_id", F.lit("file-1"))
    return f.join(t, ["job_id", "file_id"], "left").select("job_id", "file_id", F.coalesce("s", "translation_status").alias("translation_status"))


@query(f"WITH {PAGES} SELECT job_id, page_number FROM pg WHERE page_number % 2 = 0 AND NOT (status = 'translated' AND path IS NOT NULL)")
def join_07_stm_10_pages_to_run(spark, d):
    p = pages(spark, d)
    return joins.pages_to_run(p, p.where("page_number % 2 = 0").select("job_id", "page_number"))


@query(f"WITH {PAGES} SELECT n.job_id, n.page_number, p.path, CASE WHEN p.path IS NULL THEN 'source' ELSE 'translated' END AS origin FROM (SELECT job_id, unnest(range(1, CAST(max(page_number) + 3 AS BIGINT))) AS page_number FROM pg GROUP BY job_id) n LEFT JOIN (SELECT * FROM pg WHERE status = 'translated') p ON n.job_id = p.job_id AND n.page_number = p.page_number")
def join_08_snk_05_page_sources(spark, d):
    p = pages(spark, d)
    return joins.page_sources(p.groupBy("job_id").agg((F.max("page_number") + 2).cast("int").alias("n")), p)


@query(f"WITH {PAGES}, r AS (SELECT job_id, page_number + 2 AS page_number, page_number % 3 = 0 AS cur FROM pg WHERE page_number % 4 < 2) SELECT coalesce(pg.job_id, r.job_id) AS job_id, coalesce(pg.page_number, r.page_number) AS page_number, CASE WHEN status = 'translated' THEN status WHEN cur THEN 'translating' WHEN cur IS NOT NULL THEN 'queued' ELSE status END AS status FROM pg FULL JOIN r ON pg.job_id = r.job_id AND pg.page_number = r.page_number")
def join_09_live_pages(spark, d):
    p = pages(spark, d)
    run = p.where("page_number % 4 < 2").select("job_id", (F.col("page_number") + 2).alias("page_number"), (F.col("page_number") % 3 == 0).alias("current"))
    return joins.live_pages(p, run)


@query("WITH f AS (SELECT text, min_by('B' || item_id, item_id) AS t FROM benchmark GROUP BY text) SELECT doc_id, t AS translation, t IS NULL AS missing FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (SELECT text FROM benchmark WHERE item_id = doc_id % 40) ELSE text END AS text FROM documents) x LEFT JOIN f USING (text)")
def join_10_reused_translations(spark, d):
    b = table(spark, d, "benchmark")
    pick = table(spark, d, "documents").join(b.select("item_id", F.col("text").alias("b")), F.expr("doc_id % 3 = 0 and item_id = doc_id % 40"), "left")
    texts = pick.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("b")).otherwise(F.col("text")).alias("source_text"))
    have = b.select(F.col("text").alias("source_text"), F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("translation"), F.col("item_id").alias("position"))
    return joins.reuse(texts, have).select("doc_id", "translation", "missing")


@query(f"WITH {SEG} SELECT segment_id, CASE WHEN idx < 3 THEN 'Z' || idx ELSE translated_text END AS translated_text, CASE WHEN idx < 3 THEN 'done' ELSE status END AS status FROM seg")
def join_11_zipped_update(spark, d):
    s = segments(spark, d)
    ids = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "segment_id"))).alias("xs")).select(F.transform("xs", lambda x: x["segment_id"]).alias("ids"), F.array(F.lit("Z0"), F.lit("Z1"), F.lit("Z2")).alias("texts"))
    return joins.zipped_update(s, ids).select("segment_id", "translated_text", "status")


@query(f"WITH {PAGES}, c AS (SELECT job_id, page_number, path, CASE WHEN page_number % 11 = 0 THEN 'old' ELSE version END AS version FROM pg) SELECT c.* FROM c JOIN pg ON c.job_id = pg.job_id AND c.page_number = pg.page_number AND c.path IS NOT DISTINCT FROM pg.path AND c.version IS NOT DISTINCT FROM pg.version")
def join_12_dml_16_matching_pages(spark, d):
    p = pages(spark, d)
    c = p.select("job_id", "page_number", "path", F.when(F.col("page_number") % 11 == 0, "old").otherwise(F.col("version")).alias("version"))
    return joins.matching_pages(p, c)


@query(f"WITH {PAGES}, f AS (SELECT job_id, page_number + CASE WHEN page_number % 9 = 0 THEN 1000 ELSE 0 END AS page_number, 'f' || page_number AS file FROM pg WHERE page_number % 3 = 0) SELECT coalesce(pg.job_id, f.job_id) AS job_id, coalesce(pg.page_number, f.page_number) AS page_number, CASE WHEN file IS NOT NULL AND coalesce(status <> 'failed', true) THEN 'translated' WHEN status = 'translated' AND file IS NULL THEN 'pending' ELSE status END AS status, coalesce(file, CASE WHEN status <> 'translated' THEN path END) AS path FROM pg FULL JOIN f ON pg.job_id = f.job_id AND pg.page_number = f.page_number")
def join_14_dml_12_reconciled_pages(spark, d):
    p = pages(spark, d)
    files = p.where("page_number % 3 = 0").select("job_id", (F.col("page_number") + F.when(F.col("page_number") % 9 == 0, 1000).otherwise(0)).alias("page_number"), F.concat(F.lit("f"), F.col("page_number").cast("string")).alias("path"))
    return joins.reconciled_pages(p, files)


@query(f"WITH {PAGES}, r AS (SELECT job_id, unnest(range(1, CAST(max(page_number) + 4 AS BIGINT), 2)) AS page_number FROM pg GROUP BY job_id), x AS (SELECT r.job_id, coalesce(status, 'missing') AS s FROM r LEFT JOIN pg ON r.job_id = pg.job_id AND r.page_number = pg.page_number) SELECT job_id, count(*) AS requested, count(*) FILTER (s = 'translated') AS translated, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'missing') AS missing FROM x GROUP BY job_id")
def join_15_requested_page_states(spark, d):
    p = pages(spark, d)
    r = p.groupBy("job_id").agg(F.max("page_number").alias("n")).select("job_id", F.explode(F.sequence(F.lit(1), (F.col("n") + 3).cast("int"), F.lit(2))).alias("page_number"))
    return joins.requested_page_states(r, p)


@query(f"WITH {PAGES}, c AS (SELECT job_id, page_number, 1 AS pr, path AS p, path IS NOT NULL AND page_number % 2 = 0 AS present FROM pg UNION ALL SELECT job_id, page_number, 2, 'legacy/' || page_number, page_number % 3 = 0 FROM pg) SELECT job_id, page_number, min_by(p, pr) AS path FROM c WHERE present GROUP BY ALL")
def join_18_src_12_first_artifact(spark, d):
    p = pages(spark, d)
    a = p.select("job_id", "page_number", F.lit(1).alias("priority"), "path", (F.col("path").isNotNull() & (F.col("page_number") % 2 == 0)).alias("present"))
    b = p.select("job_id", "page_number", F.lit(2).alias("priority"), F.concat(F.lit("legacy/"), F.col("page_number").cast("string")).alias("path"), (F.col("page_number") % 3 == 0).alias("present"))
    return joins.first_artifact(a.unionByName(b))


@query(f"WITH {SEG} SELECT job_id, segment_id, row_number() OVER (PARTITION BY job_id ORDER BY doc_id, idx) AS position FROM seg")
def win_01_renumber(spark, d):
    return state.renumber(segments(spark, d), ["job_id"], ["doc_id", "idx"]).select("job_id", "segment_id", "position")


_CAP = "CASE WHEN {0} <= 800 THEN 8 WHEN {0} <= 1600 THEN 4 WHEN {0} <= 2500 THEN 3 ELSE 1 END"


@query(f"""WITH RECURSIVE r AS (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
b(source, doc_id, n, k, batch, size, longest) AS (SELECT source, doc_id, n, k, 0, 1, n FROM r WHERE k = 1
UNION ALL SELECT r.source, r.doc_id, r.n, r.k, CASE WHEN b.size + 1 > {_CAP.format('greatest(b.longest, r.n)')} THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.size + 1 > {_CAP.format('greatest(b.longest, r.n)')} THEN 1 ELSE b.size + 1 END, CASE WHEN b.size + 1 > {_CAP.format('greatest(b.longest, r.n)')} THEN r.n ELSE greatest(b.longest, r.n) END FROM b JOIN r ON r.source = b.source AND r.k = b.k + 1)
SELECT source, doc_id, n AS n_chars, batch AS batch_no FROM b""")
def win_02_batch_plan(spark, d):
    return batches.plan(table(spark, d, "documents"), "source", "doc_id", "text", 8)


_BL = "CASE WHEN (doc_id + idx) % 4 < 2 THEN '' ELSE source_text END"


@query(f"WITH {SEG}, x AS (SELECT doc_id, idx, {_BL} AS t, {sql_blank(_BL)} AS b FROM seg), y AS (SELECT *, lag(b, 1, true) OVER (PARTITION BY doc_id ORDER BY idx) AS pb, sum(CASE WHEN b THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY idx DESC) AS after FROM x) SELECT d.doc_id, coalesce(string_agg(y.t, chr(10) || chr(10) ORDER BY y.idx), '') AS document FROM (SELECT DISTINCT doc_id FROM seg) d LEFT JOIN y ON d.doc_id = y.doc_id AND NOT (b AND (pb OR after = 0)) GROUP BY d.doc_id")
def win_04_agg_23_snk_04_text_document(spark, d):
    s = segments(spark, d).withColumn("source_text", F.expr(_BL))
    return export.text_document(s, "doc_id", "idx", "source_text")


_KIND = "CASE idx % 5 WHEN 0 THEN 'heading' WHEN 1 THEN 'list_item' WHEN 2 THEN 'list_item' WHEN 3 THEN 'paragraph' ELSE 'blockquote' END"


@query(f"""WITH {SEG}, x AS (SELECT doc_id, idx, {_KIND} AS k, CASE WHEN (doc_id + idx) % 7 = 0 THEN '' ELSE source_text END AS t FROM seg), y AS (SELECT *, {sql_blank('t')} AS b FROM x),
p AS (SELECT *, lag(idx) OVER (PARTITION BY doc_id ORDER BY idx) AS pidx, lag(k) OVER (PARTITION BY doc_id ORDER BY idx) AS pk FROM y WHERE NOT b)
SELECT d.doc_id, coalesce({sql_trim("string_agg(CASE WHEN pidx IS NULL THEN '' WHEN pidx = idx - 1 AND pk = 'list_item' AND k = 'list_item' THEN chr(10) ELSE chr(10) || chr(10) END || t, '' ORDER BY idx)")}, '') AS document FROM (SELECT DISTINCT doc_id FROM seg) d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id""")
def win_05_markdown_document(spark, d):
    s = segments(spark, d).withColumn("kind", F.expr(_KIND)).withColumn("source_text", F.when((F.col("doc_id") + F.col("idx")) % 7 == 0, "").otherwise(F.col("source_text")))
    return export.markdown_document(s, "doc_id", "idx", "kind", "source_text")


@query(f"WITH {SEG} SELECT segment_id, CASE WHEN idx % 5 IN (0, 1, 2) THEN '# ' || source_text WHEN idx % 5 = 4 THEN '> ' || source_text ELSE source_text END AS markdown, 'Original:' || chr(10) || source_text || chr(10) || chr(10) || 'Chinese:' || chr(10) || status AS bilingual FROM seg")
def str_16_17_rendered_blocks(spark, d):
    s = segments(spark, d).withColumn("kind", F.expr(_KIND))
    return s.select("segment_id", export.render_block(F.col("kind"), F.lit("#"), F.col("source_text"), F.col("source_text"), F.lit("markdown"), False).alias("markdown"), export.render_block(F.col("kind"), F.lit("#"), F.col("source_text"), F.col("status"), F.lit("txt"), True).alias("bilingual"))


@query(f"WITH {PAGES} SELECT job_id, page_number, coalesce(sum(bytes) OVER (PARTITION BY job_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pg")
def win_06_running_offsets(spark, d):
    return joins.running_total(pages(spark, d), ["job_id"], ["page_number"], "bytes", "before").select("job_id", "page_number", "before")


@query("WITH b AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS name, CASE WHEN doc_id % 2 = 0 THEN '900' ELSE lpad(CAST(doc_id % 900 AS VARCHAR), 3, '0') END AS updated_at FROM documents) SELECT * FROM b")
def snk_03_srt_01_upsert_index(spark, d):
    docs = table(spark, d, "documents")
    old = docs.select("doc_id", F.lit("old").alias("name"), F.lpad((F.col("doc_id") % 900).cast("string"), 3, "0").alias("updated_at"))
    new = docs.where("doc_id % 2 = 0").select("doc_id", F.lit("new").alias("name"), F.lit("900").alias("updated_at"))
    return state.upsert(old, new, ["doc_id"], "updated_at")


@query(f"WITH {PAGES}, c AS (SELECT job_id, page_number + 1 AS page_number, CASE page_number % 3 WHEN 0 THEN 'translated' WHEN 1 THEN 'failed' ELSE 'queued' END AS st, 'n' || page_number AS np FROM pg WHERE page_number % 2 = 0) SELECT coalesce(pg.job_id, c.job_id) AS job_id, coalesce(pg.page_number, c.page_number) AS page_number, CASE WHEN st IS NULL THEN status WHEN st IN ('translated', 'failed') THEN st ELSE 'pending' END AS status, CASE WHEN st IS NULL THEN path WHEN st = 'translated' THEN np END AS path FROM pg FULL JOIN c ON pg.job_id = c.job_id AND pg.page_number = c.page_number")
def dml_01_02_prj_14_upsert_pages(spark, d):
    p = pages(spark, d)
    c = p.where("page_number % 2 = 0").select("job_id", (F.col("page_number") + 1).alias("page_number"), F.expr("CASE page_number % 3 WHEN 0 THEN 'translated' WHEN 1 THEN 'failed' ELSE 'queued' END").alias("status"), F.concat(F.lit("n"), F.col("page_number").cast("string")).alias("path"), F.lit("v9").alias("version"), F.lit(0).cast("long").alias("bytes"), F.lit(1).cast("long").alias("seq"))
    return state.upsert_pages(p, c).select("job_id", "page_number", "status", "path")


@query(f"WITH {SEG} SELECT segment_id, CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE status END AS status, translated_text, CASE WHEN doc_id % 5 = 0 THEN 'timeout' END AS error FROM seg")
def dml_03_mark_failed(spark, d):
    s = segments(spark, d)
    return state.mark(s, s.where("doc_id % 5 = 0"), "failed", F.lit("timeout")).select("segment_id", "status", "translated_text", "error")


@query(f"WITH {SEG}, c AS (SELECT *, target_lang <> 'en' AS ch FROM seg) SELECT segment_id, CASE WHEN ch AND NOT ({sql_blank(chr(99) + 'oalesce(translated_text, ' + chr(39) * 2 + ')')}) THEN 1 ELSE 0 END AS history, CASE WHEN NOT ch THEN translated_text END AS translated_text, CASE WHEN ch AND status <> 'skipped' THEN 'pending' ELSE status END AS status, 'en' AS target_lang FROM c")
def dml_05_06_change_language(spark, d):
    s = segments(spark, d).withColumn("history", F.array().cast("array<struct<text:string,reason:string>>"))
    return state.change_language(s, F.lit("en")).select("segment_id", F.size("history").alias("history"), "translated_text", "status", "target_lang")


@query(f"WITH {SEG}, s AS (SELECT *, coalesce(file_id, 'file-1') AS f FROM seg) SELECT job_id, segment_id, row_number() OVER (PARTITION BY job_id ORDER BY f, doc_id, idx) AS position FROM s WHERE NOT (f = 'file-2' AND job_id <> 'job-src0')")
def snk_12_set_04_delete_file(spark, d):
    gone = all_files(spark, d).where("file_id = 'file-2' and job_id <> 'job-src0'")
    return state.delete_file(segments(spark, d), gone).select("job_id", "segment_id", "position")


@query(f"WITH {SEG}, s AS (SELECT job_id, coalesce(file_id, 'file-1') AS f, doc_id, idx, segment_id FROM seg), n AS (SELECT DISTINCT job_id, 'file-3' AS f, CAST(0 AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS idx, 'new' AS segment_id FROM seg), u AS (SELECT * FROM s WHERE f <> 'file-3' UNION ALL SELECT * FROM n) SELECT job_id, segment_id, row_number() OVER (PARTITION BY job_id ORDER BY f, doc_id, idx) AS position FROM u")
def dml_07_replace_file(spark, d):
    s = segments(spark, d)
    fresh = s.groupBy("job_id").agg(F.lit(0).cast("long").alias("doc_id")).select("doc_id", F.lit(0).alias("idx"), "job_id", F.lit("file-3").alias("file_id"), F.lit("b").alias("block_id"), F.lit("new").alias("segment_id"), F.lit("x").alias("source_text"), F.lit("pending").alias("status"), F.lit("en").alias("target_lang"), F.lit(None).cast("string").alias("translated_text"))
    return state.replace_file(s, fresh.distinct()).select("job_id", "segment_id", "position")


@query(f"WITH {SEG} SELECT segment_id, 'fr' AS target_lang, CASE WHEN idx % 2 = 0 THEN 'done' WHEN status = 'skipped' THEN 'skipped' ELSE 'pending' END AS status, CASE WHEN idx % 2 = 0 THEN 'x' END AS translated_text FROM seg")
def dml_08_18_ensure_translations(spark, d):
    s = segments(spark, d)
    have = s.where("idx % 2 = 0").select("segment_id", F.lit("fr").alias("target_lang"), F.lit("done").alias("status"), F.lit("x").alias("translated_text"))
    return state.ensure_translations(s, have, "fr")


@query(f"WITH {SEG} SELECT job_id, coalesce(file_id, 'none') AS file_id FROM seg GROUP BY job_id, file_id HAVING bool_or(NOT ({sql_blank(chr(99) + 'oalesce(translated_text, ' + chr(39) * 2 + ')')}))")
def dml_09_migratable_files(spark, d):
    return state.migratable_files(segments(spark, d), ["job_id", "file_id"]).select("job_id", F.coalesce("file_id", F.lit("none")).alias("file_id"))


_RUNS = "SELECT user_id AS run_id, CASE user_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'pausing' WHEN 2 THEN 'completed' ELSE 'failed' END AS state, CASE WHEN user_id % 3 = 0 THEN 'me' ELSE 'other' END AS session FROM events GROUP BY user_id"


@query(f"SELECT run_id, CASE WHEN state IN ('running', 'pausing') AND session <> 'me' THEN 'paused' ELSE state END AS state, CASE WHEN state IN ('running', 'pausing') AND session <> 'me' THEN 0 ELSE 2 END AS chunk_pages FROM ({_RUNS})")
def dml_11_stm_09_recover_runs(spark, d):
    runs = spark.sql(_RUNS.replace("FROM events", "FROM {events}"), events=table(spark, d, "events")).withColumn("chunk", F.array(F.lit(1), F.lit(2)))
    return state.recover_runs(runs, "me").select("run_id", "state", F.size("chunk").alias("chunk_pages"))


@query(f"WITH {PAGES} SELECT job_id, page_number, saving, row_number() OVER (PARTITION BY job_id ORDER BY saving DESC, page_number) AS rank FROM (SELECT job_id, page_number, bytes * 100 - bytes * 60 AS saving FROM pg) WHERE saving > 65536")
def snk_13_compaction_plan(spark, d):
    a = pages(spark, d).select("job_id", "page_number", (F.col("bytes") * 100).alias("bytes"), (F.col("bytes") * 60).alias("packed_bytes"))
    return state.compaction_plan(a).select("job_id", "page_number", "saving", "rank")


@query(f"WITH {PAGES}, b AS (SELECT job_id, page_number, 'b' || k AS name FROM pg, (SELECT unnest([1, 2]) AS k) WHERE page_number % 2 = 0) SELECT b.job_id, b.page_number, name, CASE WHEN name = 'b1' AND path IS NULL THEN 'restore' ELSE 'delete' END AS action FROM b JOIN pg USING (job_id, page_number)")
def dml_15_backup_actions(spark, d):
    p = pages(spark, d)
    b = p.where("page_number % 2 = 0").select("job_id", "page_number", F.explode(F.array(F.lit("b1"), F.lit("b2"))).alias("name"))
    return state.backup_actions(b, p)


@query("SELECT DISTINCT lang FROM (SELECT lang FROM documents UNION ALL SELECT 'zh-CN' UNION ALL SELECT CASE WHEN doc_id % 2 = 0 THEN 'ja' ELSE ' ' END FROM documents) WHERE trim(lang) <> ''")
def set_02_target_languages(spark, d):
    docs = table(spark, d, "documents")
    both = docs.select("lang").union(spark.createDataFrame([("zh-CN",)], "lang string")).union(docs.select(F.when(F.col("doc_id") % 2 == 0, "ja").otherwise(" ")))
    return both.where(F.trim("lang") != "").distinct()


@query("SELECT DISTINCT user_id AS run_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 80)")
def set_03_snk_11_stale_runs(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("run_id")).distinct().join(e.where("event_type = 'error' and value > 80").select(F.col("user_id").alias("run_id")), "run_id", "left_anti")


@query(f"WITH {SEG} SELECT segment_id, 'ja:' || source_text AS translated_text, 'done' AS status FROM seg")
def udf_01_stm_03_translate(spark, d):
    return provider.translate(segments(spark, d), provider.stub, "en", "ja").select("segment_id", "translated_text", "status")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'own' WHEN event_id % 3 <> 0 THEN 'p' || event_id % 3 WHEN event_id % 2 = 0 THEN 'managed' ELSE 'llama' END AS provider FROM events")
def udf_03_choose_provider(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", provider.choose(F.when(i % 5 == 0, "own").otherwise(""), F.when(i % 3 == 0, "auto").otherwise(F.concat(F.lit("p"), (i % 3).cast("string"))), i % 2 == 0).alias("provider"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE doc_id % 4 END AS n_files, CASE WHEN doc_id % 4 = 0 THEN 'file-1' ELSE 'f-1' END AS first_file, coalesce(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'fl' END, lang) AS source_lang FROM documents")
def prj_01_02_08_default_files(spark, d):
    i = F.col("doc_id")
    x = table(spark, d, "documents").withColumn("files", F.transform(F.when(i % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("bigint"), i % 4)), lambda k: F.concat(F.lit("f-"), k.cast("string"))))
    x = x.withColumn("files", F.when(F.size("files") == 0, F.array(F.lit("file-1"))).otherwise(F.col("files")))
    return x.select("doc_id", F.size("files").alias("n_files"), F.col("files")[0].alias("first_file"), F.coalesce(F.when(i % 5 == 0, None).otherwise(F.lit("fl")), "lang").alias("source_lang"))


@query(f"WITH {SEG} SELECT doc_id, string_agg(source_text, chr(10) || chr(10) ORDER BY idx) AS text FROM seg WHERE coalesce(file_id, 'file-1') = 'file-1' GROUP BY doc_id")
def prj_16_source_for_editing(spark, d):
    s = segments(spark, d).where(F.coalesce("file_id", F.lit("file-1")) == "file-1")
    g = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "source_text"))).alias("xs"))
    return g.select("doc_id", F.array_join(F.transform("xs", lambda x: x["source_text"]), "\n\n").alias("text"))
