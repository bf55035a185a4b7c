"""Working tables derived from the driver's tables, by rules both engines can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STATUSES = "CASE (doc_id * 7 + idx) % 10 WHEN 7 THEN 'failed' WHEN 8 THEN 'pending' WHEN 9 THEN 'skipped' WHEN 5 THEN 'edited' WHEN 4 THEN CASE WHEN doc_id % 5 = 0 THEN 'translating' ELSE 'done' END ELSE 'done' END"
LANGS = "CASE doc_id % 3 WHEN 0 THEN 'zh-CN' WHEN 1 THEN 'en' ELSE 'ja' END"

#: Segments: one per line of a document; job = source, file = document group, block = three lines.
SEGMENT_SQL = f"""
SELECT doc_id, idx, 'job-' || source AS job_id,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 'file-' || CAST(doc_id % 3 + 1 AS VARCHAR(20)) END AS file_id,
  CAST(doc_id AS VARCHAR(20)) || '-block-' || CAST(idx DIV_ 3 + 1 AS VARCHAR(20)) AS block_id,
  CAST(doc_id AS VARCHAR(20)) || '-segment-' || CAST(idx + 1 AS VARCHAR(20)) AS segment_id,
  line AS source_text, {STATUSES} AS status, {LANGS} AS target_lang,
  CASE WHEN (doc_id * 7 + idx) % 10 < 7 AND (doc_id + idx) % 13 <> 0 THEN '<' || line || '>' END AS translated_text
FROM lines
"""
#: Pages: page number within a source, state by rule, artifact by rule.
PAGE_SQL = """
SELECT source AS job_id, page_number, CASE page_number % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'queued' ELSE 'translated' END AS status,
  CASE WHEN page_number % 7 > 2 AND page_number % 5 <> 0 THEN 'pages/en/page-' || CAST(page_number AS VARCHAR(20)) || '.pdf' END AS path,
  CASE WHEN page_number % 7 > 2 THEN 'v' || CAST(page_number % 3 AS VARCHAR(20)) END AS version, n_chars AS bytes
FROM (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_number FROM documents) x
"""
#: Requests: one per event; failed where the event is an error, latency in whole ms.
REQUEST_SQL = """
SELECT event_id, user_id AS run_id, CAST(epoch_ms_ AS BIGINT) AS timestamp_ms, event_type AS context, event_type <> 'error' AS ok,
  CAST(floor(value * 10) AS BIGINT) AS latency_ms, CAST(k_ % 16 + 1 AS BIGINT) AS batch_size, CAST(event_id % 997 AS BIGINT) AS input_chars, CAST(event_id % 499 AS BIGINT) AS output_chars
FROM events
"""


def _sql(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    return spark.sql(sql.replace("VARCHAR(20)", "STRING"), **frames) if not frames else spark.sql(_named(sql.replace("VARCHAR(20)", "STRING"), frames), **frames)


def _named(sql: str, frames: dict[str, DataFrame]) -> str:
    for name in frames:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    return sql


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    return _sql(spark, SEGMENT_SQL.replace("DIV_", "DIV"), lines=lines)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, PAGE_SQL, documents=table(spark, sf_dir, "documents"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = REQUEST_SQL.replace("epoch_ms_", "unix_millis(cast(ts as timestamp))").replace("k_", "CAST(get_json_object(props, '$.k') AS BIGINT)")
    return _sql(spark, sql, events=table(spark, sf_dir, "events"))


# --- the same for DuckDB, as common table expressions ----------------------------------

SEG = f"lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents), seg AS ({SEGMENT_SQL.replace('DIV_', '//')})"
PAGES = f"pg AS ({PAGE_SQL})"
REQ = "req AS (" + REQUEST_SQL.replace("epoch_ms_", "epoch_us(ts) // 1000").replace("k_", "CAST(props->>'$.k' AS BIGINT)") + ")"
#: Blank class for RE2.
RE_BLANK = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{RE_BLANK}]+|[{RE_BLANK}]+$', '', 'g')"


def sql_blank(x: str) -> str:
    return f"NOT regexp_matches({x}, '[^{RE_BLANK}]')"
