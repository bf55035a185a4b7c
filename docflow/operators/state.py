"""Keyed state without MERGE: upserts, deletes, repairs and conditional updates as projections and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions import text as T
from docflow.operators.joins import last_per_key

DURABLE = ("translated", "failed")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union where the row of greatest order wins per key; on equal order the new one does."""
    both = old.withColumn("new_", F.lit(0)).unionByName(new.withColumn("new_", F.lit(1)))
    return last_per_key(both, keys, [order, "new_"]).drop("new_")


def durable_status(status: Column) -> Column:
    """Only translated and failed are stored; everything else is pending."""
    return F.when(status.isin(*DURABLE), status).otherwise("pending")


def upsert_pages(pages: DataFrame, commits: DataFrame) -> DataFrame:
    """Page commits over states: status made durable, artifact kept only with translated.

    The greatest seq wins; states without seq yield to every commit.
    """
    c = commits.withColumn("status", durable_status(F.col("status")))
    c = c.withColumns({"path": F.when(F.col("status") == "translated", F.col("path")), "version": F.when(F.col("status") == "translated", F.col("version"))})
    old = pages if "seq" in pages.columns else pages.withColumn("seq", F.lit(-1).cast("long"))
    out = upsert(old, c, ["job_id", "page_number"], "seq")
    return out if "seq" in pages.columns else out.drop("seq")


def mark(segments: DataFrame, ids: DataFrame, status: str, error: Column | None = None) -> DataFrame:
    """Set the status of the given segments; a failed one keeps its old text."""
    hit = segments.join(ids.select("segment_id").distinct().withColumn("hit_", F.lit(True)), "segment_id", "left")
    out = hit.withColumn("status", F.when(F.col("hit_"), F.lit(status)).otherwise(F.col("status")))
    if error is not None:
        out = out.withColumn("error", F.when(F.col("hit_"), error))
    return out.drop("hit_")


def archive(segments: DataFrame, reason: str) -> DataFrame:
    """Append a non-blank translation to the segment's history."""
    entry = F.struct(F.col("translated_text").alias("text"), F.lit(reason).alias("reason"))
    return segments.withColumn("history", F.when(~T.is_blank(F.coalesce("translated_text", F.lit(""))), F.array_append("history", entry)).otherwise(F.col("history")))


def change_language(segments: DataFrame, lang: Column) -> DataFrame:
    """Where the language differs: archive, clear and reset to pending (skipped stays)."""
    changed = ~F.col("target_lang").eqNullSafe(lang)
    entry = F.struct(F.col("translated_text").alias("text"), F.lit("language").alias("reason"))
    keep = changed & ~T.is_blank(F.coalesce("translated_text", F.lit("")))
    return segments.select(
        *[c for c in segments.columns if c not in ("history", "translated_text", "status", "target_lang")],
        F.when(keep, F.array_append("history", entry)).otherwise(F.col("history")).alias("history"),
        F.when(~changed, F.col("translated_text")).alias("translated_text"),
        F.when(changed & (F.col("status") != "skipped"), "pending").otherwise(F.col("status")).alias("status"),
        lang.alias("target_lang"),
    )


def renumber(rows: DataFrame, part: list[str], order: list, name: str = "position") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*order)))


def delete_file(segments: DataFrame, gone: DataFrame) -> DataFrame:
    """Drop the segments of deleted files and number the rest anew within their job."""
    left = segments.withColumn("file_id", F.coalesce("file_id", F.lit("file-1"))).join(gone, ["job_id", "file_id"], "left_anti")
    return renumber(left, ["job_id"], ["file_id", "doc_id", "idx"])


def replace_file(segments: DataFrame, fresh: DataFrame) -> DataFrame:
    """Replace all segments of the files in fresh, then number anew."""
    s = segments.withColumn("file_id", F.coalesce("file_id", F.lit("file-1")))
    kept = s.join(fresh.select("job_id", "file_id").distinct(), ["job_id", "file_id"], "left_anti")
    return renumber(kept.unionByName(fresh), ["job_id"], ["file_id", "doc_id", "idx"])


def ensure_translations(segments: DataFrame, existing: DataFrame, lang: str) -> DataFrame:
    """Existing translation rows plus an empty one for each segment that has none."""
    have = existing.where(F.col("target_lang") == lang)
    fresh = segments.join(have.select("segment_id"), "segment_id", "left_anti")
    empty = fresh.select("segment_id", F.lit(lang).alias("target_lang"), F.when(F.col("status") == "skipped", "skipped").otherwise("pending").alias("status"), F.lit(None).cast("string").alias("translated_text"))
    return existing.select(empty.columns).unionByName(empty)


def migratable_files(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Files with at least one non-blank translation."""
    return segments.groupBy(*keys).agg(F.bool_or(~T.is_blank(F.coalesce("translated_text", F.lit("")))).alias("some")).where("some").select(*keys)


def recover_runs(runs: DataFrame, session: str) -> DataFrame:
    """A live run of another session is paused and loses its current chunk."""
    stale = F.col("state").isin("running", "pausing") & (F.col("session") != session)
    return runs.withColumns({"state": F.when(stale, "paused").otherwise(F.col("state")), "chunk": F.when(stale, F.array().cast("array<int>")).otherwise(F.col("chunk"))})


def compaction_plan(artifacts: DataFrame, least_saving: int = 65_536) -> DataFrame:
    """Artifacts worth rewriting, the greatest saving first within a job."""
    out = artifacts.withColumn("saving", F.col("bytes") - F.col("packed_bytes")).where(F.col("saving") > least_saving)
    return renumber(out, ["job_id"], [F.desc("saving"), "page_number"], "rank")


def backup_actions(backups: DataFrame, pages: DataFrame) -> DataFrame:
    """Per page: the first backup restores a page without artifact, all others are deleted."""
    n = renumber(backups, ["job_id", "page_number"], ["name"], "nth")
    have = pages.where("path is not null").select("job_id", "page_number").withColumn("have", F.lit(True))
    out = n.join(have, ["job_id", "page_number"], "left")
    return out.select("job_id", "page_number", "name", F.when((F.col("nth") == 1) & F.col("have").isNull(), "restore").otherwise("delete").alias("action"))
