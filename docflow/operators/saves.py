"""What saving, renaming and clearing do to file, job and document rows.

All are keyed projections and upserts over tables; a caller writes the returned rows with the sinks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions import text as T
from docflow.operators import rollup, state

#: Longest name of a job in characters.
MAX_NAME = 80


def summary_rows(summary: DataFrame, lang: Column, now: Column, file_id: str = "file-1") -> DataFrame:
    """Translation file rows of page summaries: pages count as segments."""
    out = summary.select("job_id", F.lit(file_id).alias("source_file_id"), lang.alias("target_lang"), "status", F.col("page_count").alias("segment_count"), F.col("translated").alias("completed_segments"), F.col("failed").alias("failed_segments"), now.alias("updated_at"))
    return out.withColumn("id", T.translation_file_id(F.col("source_file_id"), F.col("target_lang")))


def ready_rows(jobs: DataFrame, lang: Column, now: Column, file_id: str = "file-1") -> DataFrame:
    """Translation file rows of jobs whose whole document is translated: one segment of one."""
    one = jobs.select("job_id", F.lit("translated").alias("status"), *[F.lit(n).cast("long").alias(c) for c, n in (("page_count", 1), ("translated", 1), ("failed", 0))])
    return summary_rows(one, lang, now, file_id)


def upsert_files(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Translation files with rows put in by (job_id, id); a replaced file keeps its exported_at."""
    kept = files.select("job_id", "id", F.col("exported_at").alias("kept_"))
    fresh = rows.join(kept, ["job_id", "id"], "left").withColumn("exported_at", F.col("kept_")).select(files.columns)
    return files.join(rows.select("job_id", "id"), ["job_id", "id"], "left_anti").select(files.columns).unionByName(fresh)


def sync_jobs(jobs: DataFrame, rows: DataFrame) -> DataFrame:
    """Jobs that have a row take its counts and language; translated files make a job completed, and errors go."""
    new = rows.select("job_id", F.when(F.col("status") == "translated", "completed").otherwise(F.col("status")).alias("status"), *rollup.COUNTS[:3], "target_lang", "updated_at", F.lit(True).alias("hit_"))
    out = jobs.join(new.withColumnsRenamed({c: f"{c}_new" for c in new.columns if c not in ("job_id", "hit_")}), "job_id", "left")
    take = lambda c: F.when(F.col("hit_"), F.col(f"{c}_new")).otherwise(F.col(c)).alias(c) if f"{c}_new" in out.columns else F.col(c)
    return out.select(*[F.when(F.col("hit_"), None).otherwise(F.col(c)).alias(c) if c == "last_error" else take(c) for c in jobs.columns])


def rename(jobs: DataFrame, names: DataFrame) -> DataFrame:
    """Jobs under the trimmed names given for them, with why a name was refused: blank, too long, no such job."""
    n = names.withColumn("name", T.trim(F.col("name")))
    out = jobs.select("job_id", "filename", F.lit(True).alias("known_")).join(n, "job_id", "full")
    error = F.when(F.col("name").isNull(), None).when(F.col("name") == "", "blank").when(F.length("name") > MAX_NAME, "too long").when(F.col("known_").isNull(), "no such job")
    return out.select("job_id", F.when(F.col("name").isNotNull() & error.isNull(), F.col("name")).otherwise(F.col("filename")).alias("filename"), error.alias("error"))


def save_segments(old: DataFrame, new: DataFrame, all_files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, files, jobs) after new segments replaced those of their jobs."""
    touched = new.select("job_id").distinct()
    segments = old.join(touched, "job_id", "left_anti").select(old.columns).unionByName(new.select(old.columns))
    return segments, rollup.files(all_files, segments, ["job_id"]), rollup.jobs(segments)


def save_translations(files: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and state of the listed translation files from their saved segments; unknown files are refused, so left out."""
    return rollup.translation_files(segments.join(files.select(*keys).distinct(), keys, "left_semi"), keys)


def source_files(files: DataFrame, key: str = "job_id") -> DataFrame:
    """A job's list of files, by id, and their number."""
    rest = [c for c in files.columns if c not in (key, "file_id")]
    out = files.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("file_id", *rest))).alias("source_files"))
    return out.withColumn("file_count", F.size("source_files").cast("long"))


def stamp(rows: DataFrame, file_id: Column) -> DataFrame:
    return rows.withColumn("file_id", file_id)


def document_of_job(jobs: DataFrame) -> DataFrame:
    """A document row rebuilt from a job row: one PDF file, the first source file's language or else English."""
    lang = F.coalesce(F.try_element_at("source_files", F.lit(1))["source_lang"], F.lit("en"))
    file = F.struct(F.lit("file-1").alias("id"), F.col("source_filename").alias("filename"), lang.alias("source_lang"), F.col("target_lang"), F.lit("untranslated").alias("translation_status"), *rollup.COUNTS[:3], F.lit(0).cast("long").alias(rollup.COUNTS[3]))
    return jobs.select("job_id", F.concat(F.lit("document-"), "job_id").alias("document_id"), "filename", F.lit("pdf").alias("format"), lang.alias("source_lang"), "target_lang", F.array(file).alias("files"), F.lit("done").alias("extraction_status"))


def clear_pages(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """Pages after the listed ones lost their artifacts: pending, without path and version."""
    reset = gone.select("job_id", "page_number").distinct().withColumns({"status": F.lit("pending"), "path": F.lit(None).cast("string"), "version": F.lit(None).cast("string"), "bytes": F.lit(None).cast("long"), "seq": F.lit(0).cast("long")})
    known = pages.join(reset.select("job_id", "page_number"), ["job_id", "page_number"], "left_semi").select("job_id", "page_number", F.col("bytes").alias("bytes_"))
    reset = reset.join(known, ["job_id", "page_number"], "left").withColumn("bytes", F.col("bytes_")).select([*pages.columns, "seq"])
    return state.upsert_pages(pages, reset)


def blank_jobs(titles: DataFrame, now: Column) -> DataFrame:
    """Job and document rows of blank text documents with the given (job_id, title): one empty file, English to Chinese."""
    name = F.concat(T.file_stem(F.col("title")), F.lit(".txt"))
    row = titles.select("job_id", name.alias("filename"), F.lit("txt").alias("format"), F.lit("en").alias("source_lang"), F.lit("zh-CN").alias("target_lang"))
    return starter_jobs(row, now)


def starter_jobs(rows: DataFrame, now: Column, existing: DataFrame | None = None) -> DataFrame:
    """Ready jobs for (job_id, filename, format, source_lang, target_lang); a job that exists already is left as it is."""
    new = rows if existing is None else rows.join(existing.select("job_id"), "job_id", "left_anti")
    out = new.select("job_id", F.concat(F.lit("document-"), "job_id").alias("document_id"), "filename", "format", "source_lang", "target_lang")
    out = out.withColumns({"status": F.lit("ready"), "file_count": F.lit(1).cast("long"), "created_at": now, "updated_at": now})
    return out.withColumns({c: F.lit(0).cast("long") for c in rollup.COUNTS[:3]})
