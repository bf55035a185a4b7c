"""Status roll-ups: segments to blocks, files, translation files and jobs.

Each level is one aggregation with partial sums before its shuffle.  The levels count
differently on purpose (what counts as complete is not the same), so none is a rollup of
another except ``jobs_from_files``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions import text as T

COUNTS = ["segment_count", "completed_segments", "failed_segments", "translating_segments"]


def _n(condition: Column) -> Column:
    return F.count_if(condition)


def file_state(total: Column, done: Column, failed: Column, busy: Column) -> Column:
    return F.when(busy > 0, "translating").when(failed > 0, "failed").when((total > 0) & (done == total), "translated").otherwise("untranslated")


def file_counts(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of non-skipped, non-blank segments per file; a null file is file-1."""
    kept = segments.withColumn("file_id", F.coalesce("file_id", F.lit("file-1"))).where(T.is_translatable(F.col("status"), F.col("source_text")))
    s = F.col("status")
    return kept.groupBy(*keys, "file_id").agg(F.count(F.lit(1)).alias(COUNTS[0]), _n(s.isin("done", "edited")).alias(COUNTS[1]), _n(s == "failed").alias(COUNTS[2]), _n(s == "translating").alias(COUNTS[3]))


def files(all_files: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Every file with its counts (0 without segments) and state."""
    out = all_files.join(file_counts(segments, keys), [*keys, "file_id"], "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in COUNTS})
    return out.withColumn("translation_status", file_state(*[F.col(c) for c in COUNTS]))


def jobs(segments: DataFrame, key: str = "job_id") -> DataFrame:
    """Counts over all segments; done, edited and skipped are complete; no segments would be completed."""
    s = F.col("status")
    out = segments.groupBy(key).agg(F.count(F.lit(1)).alias(COUNTS[0]), _n(s.isin("done", "edited", "skipped")).alias(COUNTS[1]), _n(s == "failed").alias(COUNTS[2]), _n(s == "translating").alias("busy"))
    return out.withColumn("status", F.when(F.col("busy") > 0, "translating").when(F.col(COUNTS[2]) > 0, "failed").when(F.col(COUNTS[1]) == F.col(COUNTS[0]), "completed").otherwise("ready")).drop("busy")


def jobs_from_files(files_: DataFrame, key: str = "job_id") -> DataFrame:
    out = files_.groupBy(key).agg(*[F.sum(c).alias(c) for c in COUNTS])
    state = F.when(F.col(COUNTS[3]) > 0, "translating").when(F.col(COUNTS[2]) > 0, "failed").when((F.col(COUNTS[0]) > 0) & (F.col(COUNTS[1]) == F.col(COUNTS[0])), "completed").otherwise("ready")
    return out.withColumn("status", state)


def translation_files(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Per translation file: skipped segments out, blank ones in."""
    s = F.col("status")
    out = segments.where(s != "skipped").groupBy(*keys).agg(F.count(F.lit(1)).alias(COUNTS[0]), _n(s.isin("done", "edited")).alias(COUNTS[1]), _n(s == "failed").alias(COUNTS[2]), _n(s == "translating").alias(COUNTS[3]))
    return out.withColumn("status", file_state(*[F.col(c) for c in COUNTS]))


def block_states(segments: DataFrame, key: str = "block_id") -> DataFrame:
    """failed if any failed, done if all done (edited is not), translating if any, else pending."""
    s = F.col("status")
    return segments.groupBy(key).agg(F.when(F.bool_or(s == "failed"), "failed").when(F.bool_and(s == "done"), "done").when(F.bool_or(s == "translating"), "translating").otherwise("pending").alias("status"))


def block_activity(segments: DataFrame, key: str = "block_id") -> DataFrame:
    """What a reader is shown: translating, else queued, else translated, else idle."""
    s = F.col("status")
    return segments.groupBy(key).agg(F.when(F.bool_or(s == "translating"), "translating").when(F.bool_or(s == "pending"), "queued").when(F.bool_or(s.isin("done", "edited")), "translated").otherwise("idle").alias("activity"))


def page_summary(pages: DataFrame, key: str = "job_id", total: Column | None = None) -> DataFrame:
    """translated, failed and pending pages (never below 0) of all pages."""
    s = F.col("status")
    n = F.count(F.lit(1)) if total is None else total
    out = pages.groupBy(key).agg(n.alias("page_count"), _n(s == "translated").alias("translated"), _n(s == "failed").alias("failed"))
    out = out.withColumn("pending", F.greatest(F.lit(0), F.col("page_count") - F.col("translated") - F.col("failed")))
    return out.withColumn("status", F.when((F.col("page_count") > 0) & (F.col("translated") == F.col("page_count")), "translated").when(F.col("translated") > 0, "partial").when(F.col("failed") > 0, "failed").otherwise("untranslated"))


def agreed(files_: DataFrame, column: str, key: str = "job_id") -> DataFrame:
    """The value that all files share, null counting as a value; null where they differ."""
    lo, hi, nulls = F.min(column), F.max(column), F.count_if(F.col(column).isNull())
    return files_.groupBy(key).agg(F.when((nulls == 0) & (lo == hi), lo).alias(column))


def export_ready(segments: DataFrame, keys: list[str]) -> DataFrame:
    """ready: there are segments, all are done or edited, none has a blank translation."""
    good = F.col("status").isin("done", "edited") & ~T.is_blank(F.coalesce("translated_text", F.lit("")))
    return segments.where(T.is_translatable(F.col("status"), F.col("source_text"))).groupBy(*keys).agg((F.count(F.lit(1)) > 0).alias("some"), F.bool_and(good).alias("ok")).select(*keys, (F.col("some") & F.coalesce("ok", F.lit(False))).alias("ready"))


def revisions(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Snapshot of the non-blank translations of a file; a file without any has no row.

    Entries are an array sorted by segment, which compares where a map does not.
    """
    kept = segments.where(~T.is_blank(F.coalesce("translated_text", F.lit(""))))
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("segment_id", "translated_text"))).alias("entries"))
