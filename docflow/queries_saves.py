"""Queries of saving, renaming, repairing and small naming rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.fixtures import LANGS, PAGES, SEG, pages, segments, sql_blank, sql_trim, table
from docflow.functions import text as T
from docflow.operators import generators as G
from docflow.operators import rollup, saves
from docflow.queries_state import _COUNTS, _FILES, _PSUM, _STATE, all_files
from docflow.queries_text import ORACLE as _TEXT_SQL
from docflow.queries_text import _LANG_CASE, _MD, marked
from docflow.sources import folders, sinks
from docflow.streaming import pages as stream_pages

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


_PATH = "CASE page_id % 4 WHEN 0 THEN 'pdf-pages/page-' || CAST(page_id AS VARCHAR(20)) || '.pdf' WHEN 1 THEN 'pdf-pages/page-' || CAST(page_id AS VARCHAR(20)) WHEN 2 THEN NULL ELSE 'pdf-pages/zh/page-1.pdf' END"
_TONGUE = "CASE page_id % 6 WHEN 0 THEN ' ZH ' WHEN 1 THEN 'zh-cn' WHEN 2 THEN 'zhx' WHEN 3 THEN 'en' WHEN 4 THEN 'zh-' ELSE NULL END"
_LINE = "CASE page_id % 5 WHEN 0 THEN url || ' RWKV 翻译失败' WHEN 1 THEN 'it exceeds the available context size' WHEN 2 THEN 'EXCEED_CONTEXT_SIZE_ERROR' WHEN 3 THEN url ELSE NULL END"


@query(f"""SELECT page_id, coalesce(starts_with(path, 'pdf-pages/page-') AND ends_with(path, '.pdf'), false) AS unscoped, coalesce(lower(trim(lang)) = 'zh' OR starts_with(lower(trim(lang)), 'zh-'), false) AS trusted,
  coalesce(contains(lower(line), 'rwkv 翻译失败') OR contains(lower(line), 'exceeds the available context size') OR contains(lower(line), 'exceed_context_size_error'), false) AS worker_error
FROM (SELECT page_id, {_PATH} AS path, {_TONGUE} AS lang, {_LINE} AS line FROM pages)""")
def prd_13_19_old_paths_and_errors(spark, d):
    x = table(spark, d, "pages").selectExpr("page_id", f"{_PATH} AS path".replace("VARCHAR(20)", "STRING"), f"{_TONGUE} AS lang", f"{_LINE} AS line")
    return x.select("page_id", T.is_unscoped_page_path(F.col("path")).alias("unscoped"), T.is_trusted_language(F.col("lang")).alias("trusted"), T.is_worker_error(F.col("line")).alias("worker_error"))


@query(f"""SELECT doc_id, CASE WHEN {sql_blank('text')} THEN '未知错误' ELSE left(string_split({sql_trim('text')}, chr(10))[-1], 240) END AS short,
  CASE WHEN doc_id % 3 = 0 THEN {sql_trim('text')} ELSE {sql_trim("string_split(text, chr(10))[-1]")} END AS last,
  CASE WHEN target IN ('zh-CN', 'zh-TW', 'zh') THEN 'zh' ELSE target END AS worker_lang, CASE target WHEN 'en' THEN '英文' WHEN 'zh-CN' THEN '简体中文' ELSE target END AS label, CASE WHEN doc_id % 2 = 0 THEN 'batch' ELSE 'chat' END AS service
FROM (SELECT doc_id, coalesce(text, '') AS text, {LANGS} AS target FROM documents)""")
def str_22_prj_13_worker_names(spark, d):
    """The marker of a last error stands before the last line, except in every third document."""
    c = F.coalesce("text", F.lit(""))
    marked_ = F.when(F.col("doc_id") % 3 == 0, c).otherwise(F.regexp_replace(c, r"(?s)\A(.*\n)?([^\n]*)\z", f"$1a{T.LAST_ERROR}$2"))
    x = table(spark, d, "documents").select("doc_id", c.alias("text"), marked_.alias("line"), F.expr(LANGS).alias("target"))
    provider = F.when(F.col("doc_id") % 2 == 0, "lightning").otherwise("llama")
    return x.select("doc_id", T.short_error(F.col("text")).alias("short"), T.last_error(F.col("line")).alias("last"), T.worker_language(F.col("target")).alias("worker_lang"), T.language_label(F.col("target")).alias("label"), T.worker_service(provider, "batch", "chat").alias("service"))


_ASKED = "CASE doc_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN NULL WHEN 2 THEN '' ELSE lang END"


@query(f"SELECT doc_id, CASE WHEN asked = 'auto' THEN 'en' ELSE asked END AS stored, target, CASE WHEN asked IS NULL OR asked IN ('', 'auto') THEN 'en' ELSE asked END AS used FROM (SELECT doc_id, {_ASKED} AS asked, {LANGS} AS target FROM documents)")
def prj_15_stored_languages(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.expr(_ASKED).alias("asked"), F.expr(LANGS).alias("target"))
    kept = x.withColumn("by_job", T.stored_languages(F.create_map(F.col("doc_id"), F.struct(F.col("asked").alias("source"), "target"))))
    return kept.select("asked", F.explode("by_job").alias("doc_id", "langs")).select("doc_id", F.col("langs.source").alias("stored"), "langs.target", T.source_language(F.col("asked")).alias("used"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'logged ' || doc_id ELSE {_LANG_CASE.format('lang')} || ': word ' || doc_id || chr(10) || chr(10) || {_LANG_CASE.format(LANGS)} || ':' END AS prompt FROM documents""")
def prj_10_logged_prompts(spark, d):
    i = F.col("doc_id").cast("string")
    raw = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('{"prompt":"logged '), i, F.lit('"}'))).when(F.col("doc_id") % 4 == 1, '{"prompt":" "}').when(F.col("doc_id") % 4 == 2, "{broken")
    return table(spark, d, "documents").select("doc_id", T.logged_prompt(raw, F.concat(F.lit("word "), i), F.col("lang"), F.expr(LANGS)).alias("prompt"))


@query(f"""WITH {_MD} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS block_order, CASE block_type WHEN 'heading' THEN regexp_extract(raw, '#+') WHEN 'list_item' THEN {sql_trim("regexp_extract(" + sql_trim('raw') + ", '^([-*+]|[0-9]*\\.) ')")} ELSE '' END AS marker FROM h""")
def jsn_06_block_markers(spark, d):
    """Markers that headings and list items carry, the empty text for other blocks."""
    return G.parse(marked(spark, d), F.lit("markdown")).select("doc_id", "block_order", F.coalesce("marker", F.lit("")).alias("marker"))


_SUM = f"s AS (SELECT *, {_PSUM} FROM (SELECT job_id, count(*) AS page_count, count(*) FILTER (status = 'translated') AS translated, count(*) FILTER (status = 'failed') AS failed FROM pg GROUP BY job_id))"


def translation_file_rows(spark, d):
    """Every second source has a file for English from before, exported once."""
    return table(spark, d, "documents").select(F.col("source").alias("job_id")).distinct().where("length(job_id) % 2 = 0").select("job_id", F.lit("tr-file-1-en").alias("id"), F.lit("file-1").alias("source_file_id"), F.lit("en").alias("target_lang"), F.lit("untranslated").alias("status"), *[F.lit(0).cast("long").alias(c) for c in rollup.COUNTS[:3]], F.lit("1").alias("updated_at"), F.lit("7").alias("exported_at"))


def job_rows(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("job_id")).distinct().select("job_id", F.concat("job_id", F.lit(".pdf")).alias("filename"), F.concat("job_id", F.lit("-src.pdf")).alias("source_filename"), F.lit("ready").alias("status"), *[F.lit(3).cast("long").alias(c) for c in rollup.COUNTS[:3]], F.lit("zh-CN").alias("target_lang"), F.lit("1").alias("updated_at"), F.lit("boom").alias("last_error"))


@query(f"WITH {PAGES}, {_SUM} SELECT job_id, 'tr-file-1-en' AS id, status, page_count AS segment_count, translated AS completed_segments, failed AS failed_segments, '9' AS updated_at, CASE WHEN length(job_id) % 2 = 0 THEN '7' END AS exported_at, CASE status WHEN 'translated' THEN 'completed' ELSE status END AS job_status, 'en' AS job_lang, CAST(NULL AS VARCHAR) AS last_error FROM s")
def dml_14_page_summary_rows(spark, d):
    rows = saves.summary_rows(rollup.page_summary(pages(spark, d)), F.lit("en"), F.lit("9"))
    files = saves.upsert_files(translation_file_rows(spark, d), rows)
    jobs = saves.sync_jobs(job_rows(spark, d), rows)
    jobs = jobs.select("job_id", F.col("status").alias("job_status"), F.col("target_lang").alias("job_lang"), "last_error")
    return files.drop("source_file_id", "target_lang").join(jobs, "job_id")


@query("SELECT DISTINCT source AS job_id, 'tr-file-1-ja' AS id, 1 AS segment_count, 1 AS completed_segments, 0 AS failed_segments, CASE WHEN length(source) % 3 = 0 THEN 'completed' ELSE 'ready' END AS job_status FROM documents WHERE length(source) % 3 = 0")
def dml_17_ready_documents(spark, d):
    jobs = job_rows(spark, d)
    rows = saves.ready_rows(jobs.where("length(job_id) % 3 = 0"), F.lit("ja"), F.lit("9"))
    files = saves.upsert_files(translation_file_rows(spark, d), rows).where("id = 'tr-file-1-ja'")
    after = saves.sync_jobs(jobs, rows).select("job_id", F.col("status").alias("job_status"))
    return files.select("job_id", "id", *rollup.COUNTS[:3]).join(after, "job_id")


_NAME = "CASE length(job_id) % 4 WHEN 0 THEN '  New name ' WHEN 1 THEN '   ' WHEN 2 THEN repeat('x', 81) ELSE NULL END"


@query(f"""WITH j AS (SELECT job_id, {_NAME} AS name FROM (SELECT DISTINCT source AS job_id FROM documents)) SELECT job_id, CASE WHEN trim(name) <> '' AND length(trim(name)) <= 80 THEN trim(name) ELSE job_id || '.pdf' END AS filename, CASE WHEN trim(name) = '' THEN 'blank' WHEN length(trim(name)) > 80 THEN 'too long' END AS error FROM j
UNION ALL SELECT 'none', NULL, 'no such job'""")
def dml_10_renamed_jobs(spark, d):
    jobs = job_rows(spark, d)
    names = jobs.select("job_id", F.expr(_NAME).alias("name")).where("name is not null")
    return saves.rename(jobs, names.unionByName(spark.createDataFrame([("none", "x")], "job_id string, name string")))


_SAVED = _FILES.replace(SEG, SEG.replace("seg AS (", "seg0 AS (") + ", seg AS (SELECT * REPLACE (CASE WHEN length(job_id) % 2 = 0 AND status IN ('pending', 'failed') THEN 'done' ELSE status END AS status) FROM seg0)")


@query(f"WITH {_SAVED} SELECT * FROM files")
def dml_10_saved_segments(spark, d):
    """Saved segments of every second job, whose open and failed ones are done now, roll up to their files."""
    old = segments(spark, d)
    new = old.where("length(job_id) % 2 = 0").withColumn("status", F.when(F.col("status").isin("pending", "failed"), "done").otherwise(F.col("status")))
    return saves.save_segments(old, new, all_files(spark, d))[1]


@query(f"WITH {SEG}, t AS (SELECT job_id, target_lang, {_COUNTS} FROM seg WHERE status <> 'skipped' AND target_lang <> 'ja' GROUP BY ALL) SELECT *, {_STATE} AS status FROM t")
def dml_10_saved_translations(spark, d):
    s = segments(spark, d)
    return saves.save_translations(s.where("target_lang <> 'ja'").select("job_id", "target_lang"), s, ["job_id", "target_lang"])


@query(f"WITH {_FILES} SELECT job_id, count(*) AS file_count, list(file_id ORDER BY file_id) AS ids, CAST(sum(segment_count) AS BIGINT) AS segment_count FROM files GROUP BY job_id")
def prj_03_source_files(spark, d):
    out = saves.source_files(rollup.files(all_files(spark, d), segments(spark, d), ["job_id"]))
    return out.select("job_id", "file_count", F.transform("source_files", lambda f: f["file_id"]).alias("ids"), F.aggregate("source_files", F.lit(0).cast("long"), lambda n, f: n + f["segment_count"]).alias("segment_count"))


@query(f"WITH {SEG} SELECT file_id, count(*) AS n FROM (SELECT 'file-' || (doc_id % 5 + 1) AS file_id FROM seg) GROUP BY file_id")
def prj_04_stamped_rows(spark, d):
    out = saves.stamp(segments(spark, d), F.concat(F.lit("file-"), (F.col("doc_id") % 5 + 1).cast("string")))
    return out.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


@query("WITH j AS (SELECT source AS job_id, min_by(lang, doc_id) AS l FROM documents GROUP BY source) SELECT job_id, 'document-' || job_id AS document_id, job_id || '.pdf' AS filename, CASE WHEN length(job_id) % 2 = 0 THEN 'en' ELSE l END AS source_lang, 'zh-CN' AS target_lang, job_id || '-src.pdf' AS file, 'untranslated' AS file_status, 3 AS segment_count FROM j")
def prj_07_rebuilt_documents(spark, d):
    """Jobs of even name length list no source file, so their language is English."""
    first = table(spark, d, "documents").groupBy(F.col("source").alias("job_id")).agg(F.min_by("lang", "doc_id").alias("l"))
    listed = F.when(F.length("job_id") % 2 == 0, F.array().cast("array<struct<source_lang:string>>")).otherwise(F.array(F.struct(F.col("l").alias("source_lang"))))
    docs = saves.document_of_job(job_rows(spark, d).join(first, "job_id").withColumn("source_files", listed))
    f = F.col("files")[0]
    return docs.select("job_id", "document_id", "filename", "source_lang", "target_lang", f["filename"].alias("file"), f["translation_status"].alias("file_status"), f["segment_count"].alias("segment_count"))


@query(f"WITH {PAGES} SELECT job_id, page_number, CASE WHEN page_number % 4 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN page_number % 4 <> 0 THEN path END AS path, CASE WHEN page_number % 4 <> 0 THEN version END AS version, bytes FROM pg")
def dml_13_cleared_pages(spark, d):
    p = pages(spark, d)
    return saves.clear_pages(p, p.where("page_number % 4 = 0"))


@query("SELECT app, version, event_id FROM (SELECT *, row_number() OVER (PARTITION BY app ORDER BY minor DESC, patch DESC, event_id) AS r FROM (SELECT event_id, event_type AS app, event_id % 7 AS minor, event_id % 11 AS patch, '1.' || (event_id % 7) || '.' || (event_id % 11) AS version, event_id % 3 > 0 AS published FROM events WHERE user_id IS NOT NULL) x WHERE published) y WHERE r = 1")
def src_14_newest_release(spark, d):
    """Release rows of each app: published ones only, the newest by version, then the least id."""
    e = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("app"), F.concat(F.lit("1."), (e % 7).cast("string"), F.lit("."), (e % 11).cast("string")).alias("version"), (e % 3 > 0).alias("is_published"))
    newest = F.max_by(F.struct("version", "event_id"), F.struct(T.semver_key(F.col("version")), -e)).alias("r")
    return rows.where(F.col("is_published") & F.col("user_id").isNotNull()).groupBy("app").agg(newest).select("app", "r.version", "r.event_id")


@query(f"SELECT 'job-' || page_id AS job_id, 'document-job-' || page_id AS document_id, stem || '.txt' AS filename, 'txt' AS format, 'en' AS source_lang, 'zh-CN' AS target_lang, 'ready' AS status, CAST(1 AS BIGINT) AS file_count, CAST(0 AS BIGINT) AS segment_count FROM ({_TEXT_SQL['str_04_file_stem']})")
def src_15_blank_documents(spark, d):
    titles = table(spark, d, "pages").select(F.concat(F.lit("job-"), F.col("page_id").cast("string")).alias("job_id"), F.col("url").alias("title"))
    return saves.blank_jobs(titles, F.lit("9")).select("job_id", "document_id", "filename", "format", "source_lang", "target_lang", "status", "file_count", "segment_count")


_ARTIFACT = "CASE page_id % 13 WHEN 0 THEN 'pdf-pages/zh/page-0001.pdf' WHEN 1 THEN 'translated-pages' WHEN 2 THEN '.tmp/x' WHEN 3 THEN 'pdf2zh-output' WHEN 4 THEN 'pdf_source.json' WHEN 5 THEN 'pdf_run.' || CAST(page_id AS VARCHAR(20)) || '.json' WHEN 6 THEN 'pdf_pages.zh.json' WHEN 7 THEN 'pdf_run.zh.txt' WHEN 8 THEN 'exports/translated.pdf' WHEN 9 THEN 'exports/other.pdf' WHEN 10 THEN 'pdf_page_translations.json' WHEN 11 THEN 'kept/pdf_run.a.json' ELSE NULL END"


@query(f"SELECT page_id, coalesce(regexp_matches(path, '^(pdf-pages|translated-pages|pdf2zh-output|[.]tmp)(/|$)') OR path IN ('pdf_source.json', 'pdf_page_translations.json', 'exports/translated.pdf') OR regexp_matches(path, '^(pdf_page_translations|pdf_pages|pdf_run)[.][^/]*json$') AND ends_with(path, '.json'), false) AS removed FROM (SELECT page_id, {_ARTIFACT} AS path FROM pages)")
def snk_14_removed_artifacts(spark, d):
    x = table(spark, d, "pages").selectExpr("page_id", f"{_ARTIFACT} AS path".replace("VARCHAR(20)", "STRING"))
    return x.select("page_id", T.is_translation_artifact(F.col("path")).alias("removed"))


@query(f"""WITH {PAGES}, n AS (SELECT *, 'page-' || CASE WHEN page_number < 10000 THEN lpad(CAST(page_number AS VARCHAR), 4, '0') ELSE CAST(page_number AS VARCHAR) END || '.pdf' AS f FROM pg)
SELECT job_id, page_number, 'translated-pages/en/' || f || ',pdf-pages/en/' || f || ',pdf-pages/' || f || CASE WHEN path IS NULL THEN '' ELSE ',' || path END AS paths, page_number % 3 < 2 AS leftover FROM n""")
def dml_13_page_files(spark, d):
    """The files that clearing a page removes; names of the leftover are made up by rule."""
    n, lang = F.col("page_number"), F.lit("en")
    name = F.substring_index(T.page_path(lang, n), "/", -1)
    left = F.concat(F.lit("."), name, F.when(n % 3 == 0, ".1.compressing.tmp.pdf").when(n % 3 == 1, ".precompress.bak").otherwise(".other"))
    return pages(spark, d).select("job_id", "page_number", F.array_join(T.page_artifact_paths(lang, n, F.col("path")), ",").alias("paths"), T.is_compression_leftover(left, lang, n).alias("leftover"))


@query("SELECT source AS job_id, lang AS run_id, count(*) AS pages, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source, lang")
def snk_09_run_profiles(spark, d):
    """Profiles of all runs, written twice, and read back."""
    path = folders.scratch(spark, "profiles")
    runs = table(spark, d, "documents").groupBy(F.col("source").alias("job_id"), F.col("lang").alias("run_id")).agg(F.count(F.lit(1)).alias("pages"), F.sum("n_chars").cast("long").alias("chars"))
    if not all([sinks.write_profiles(runs, path), sinks.write_profiles(runs, path)]):
        raise OSError("profiles were not written")
    return folders.read_json(spark, path, "pages long, chars long, job_id string, run_id string", lines=True).select("job_id", "run_id", "pages", "chars")


@query("SELECT user_id AS run_id, event_id % 6 AS poll, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS kind, event_id AS id FROM events")
def stm_07_new_ids(spark, d):
    """Reports 0 to 6 of each run name all ids so far; the run ends with report 5."""
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), "event_id", "event_type", F.explode(F.sequence(F.col("event_id") % 6, F.lit(6).cast("long"))).alias("poll"))
    ids = lambda bad: F.collect_list(F.when((F.col("event_type") == "error") == F.lit(bad), F.col("event_id")))
    polls = e.groupBy("run_id", "poll").agg(ids(False).alias("completed"), ids(True).alias("failed")).withColumn("state", F.when(F.col("poll") >= 5, "completed").otherwise("running"))
    return stream_pages.new_ids(polls)
