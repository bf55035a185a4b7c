"""Queries that go through sources, sinks and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.fixtures import PAGES, SEG, pages, segments, sql_trim, table
from docflow.operators import generators as G
from docflow.operators import rollup
from docflow.sources import folders, sinks
from docflow.streaming import pages as stream_pages

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {PAGES} SELECT job_id, page_number, status, path FROM pg")
def snk_01_src_07_json_state(spark, d):
    path = folders.scratch(spark, "state")
    sinks.write_json(pages(spark, d).select("job_id", "page_number", "status", "path"), path, ["job_id"])
    return folders.read_json(spark, path, "page_number int, status string, path string, job_id string", lines=True).select("job_id", "page_number", "status", "path")


@query(f"WITH {SEG} SELECT job_id, count(*) AS n, count(*) FILTER (status = 'done') AS done FROM seg GROUP BY job_id")
def snk_02_10_bundle(spark, d):
    path = folders.scratch(spark, "bundle")
    s = segments(spark, d).select("job_id", "segment_id", "status")
    sinks.write_bundle(s, path, ["job_id"])
    sinks.write_bundle(s.where("job_id = 'job-src1'"), path, ["job_id"])
    return spark.read.parquet(path).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "done").alias("done"))


@query("SELECT user_id AS run_id, count(*) AS n FROM events GROUP BY user_id")
def snk_07_08_src_08_append_log(spark, d):
    path = folders.scratch(spark, "log")
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), "event_id")
    sinks.append_json(e.where("event_id % 2 = 0"), path)
    sinks.append_json(e.where("event_id % 2 = 1"), path)
    return folders.read_jsonl_if_exists(spark, path, "run_id long, event_id long").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(0 AS BIGINT) AS n")
def src_09_missing_log(spark, d):
    return folders.read_jsonl_if_exists(spark, folders.scratch(spark, "none"), "run_id long").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT 'd=' || doc_id % 50 || '/' AS folder, count(*) AS blocks FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE {sql_trim('line')} <> '' GROUP BY doc_id % 50")
def src_02_03_04_import_folder(spark, d):
    """Text files in fifty folders that hold all documents, imported to blocks.

    Files are bounded by documents and have no size limit; one that can't be read as text is an error.
    """
    path = folders.scratch(spark, "import")
    docs = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("d"), F.concat(F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n")).alias("value"))
    docs.repartition("d").write.partitionBy("d").option("maxRecordsPerFile", 200).text(path)
    files = folders.decoded(folders.list_folder(spark, path, max_files=None), max_bytes=None)
    blocks, _ = folders.import_documents(folders.all_accepted(files))
    return blocks.groupBy(F.regexp_extract("relative_path", "^(d=[0-9]+/)", 1).alias("folder")).agg(F.count(F.lit(1)).alias("blocks"))


@query(f"WITH {SEG} SELECT job_id, count(*) AS n FROM seg WHERE job_id = 'job-src3' GROUP BY job_id")
def src_10_11_job_bundle(spark, d):
    s = segments(spark, d)
    return folders.bundle(rollup.jobs(s), s, F.lit("job-src3")).select("job_id", F.size("segments").cast("long").alias("n"))


@query("SELECT doc_id % 50 AS file_no, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents GROUP BY doc_id % 50")
def snk_04_export_files(spark, d):
    """All documents exported to fifty folders and read back."""
    path = folders.scratch(spark, "export")
    docs = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("file_no"), F.col("text").alias("document"))
    sinks.export_documents(docs, path, "file_no")
    back = spark.read.text(path, wholetext=True)
    return back.groupBy(F.col("file_no").cast("long").alias("file_no")).agg(F.sum(F.length("value")).alias("chars"))


@query("WITH e AS (SELECT 'job-' || user_id % 5 AS job_id, event_id % 40 + 1 AS page_number, max_by(event_type, event_id) AS t, max(event_id) AS m FROM events WHERE event_type IN ('view', 'error') GROUP BY ALL) SELECT job_id, page_number, CASE WHEN t = 'view' THEN 'translated' ELSE 'failed' END AS status, CASE WHEN t = 'view' THEN 'p' || m END AS path FROM e")
def stm_05_06_page_commits(spark, d):
    """Event lines in a folder, streamed in small triggers and upserted to a page table."""
    root = folders.scratch(spark, "events")
    e = table(spark, d, "events").where("event_type in ('view', 'error')")
    line = F.to_json(F.struct(F.concat(F.lit("job-"), (F.col("user_id") % 5).cast("string")).alias("job_id"), F.when(F.col("event_type") == "view", "page").otherwise("error").alias("event"), (F.col("event_id") % 40 + 1).cast("int").alias("page_number"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("path"), F.col("event_id").alias("ts_ms")))
    e.repartitionByRange(3, "event_id").select(line.alias("value")).write.text(f"{root}/in")
    q = stream_pages.commit_pages(stream_pages.event_stream(spark, f"{root}/in", 1), f"{root}/state", f"{root}/checkpoint")
    q.awaitTermination()
    last = q.lastProgress["batchId"] if q.lastProgress else 0
    versions = [r[0] for r in spark.read.parquet(f"{root}/state").select("v").distinct().collect()]
    return spark.read.parquet(f"{root}/state/v={max([*versions, 0]) if versions else last}").select("job_id", "page_number", "status", "path")
