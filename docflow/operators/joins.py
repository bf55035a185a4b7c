"""Keyed combinations of segments, translations, pages and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions import text as T


def last_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of rows with equal keys the last in order, by one aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def translated_segments(segments: DataFrame, translations: DataFrame, lang: Column) -> DataFrame:
    """Segments with the state of their translation where there is one (the last of equal ids)."""
    t = last_per_key(translations, ["segment_id"], ["position"]).select("segment_id", F.col("translated_text").alias("t_text"), F.col("status").alias("t_status"))
    out = segments.join(t, "segment_id", "left").withColumn("hit", F.col("t_status").isNotNull())
    return out.withColumns({"translated_text": F.when(F.col("hit"), F.col("t_text")).otherwise(F.col("translated_text")), "status": F.when(F.col("hit"), F.col("t_status")).otherwise(F.col("status")), "target_lang": lang}).drop("t_text", "t_status", "hit")


def run_targets(segments: DataFrame, translations: DataFrame, statuses: list[str] | None, skipped: bool = False) -> DataFrame:
    """Segments to translate: by the status of their translation (pending if none); None means all."""
    t = translations.select("segment_id", F.col("status").alias("t_status"))
    out = segments.join(t, "segment_id", "left").withColumn("t_status", F.coalesce("t_status", F.lit("pending")))
    out = out.where(~T.is_blank(F.col("source_text")))
    out = out if skipped else out.where("t_status <> 'skipped' and status <> 'skipped'")
    return out if statuses is None else out.where(F.col("t_status").isin(statuses))


def requested(segments: DataFrame, wanted: DataFrame, translations: DataFrame) -> DataFrame:
    """Semi-joins with the requested ids and with translations that are not skipped."""
    return segments.join(wanted.select("segment_id"), "segment_id", "left_semi").join(translations.where("status <> 'skipped'").select("segment_id"), "segment_id", "left_semi")


def block_texts(blocks: DataFrame, segments: DataFrame, fallback: bool = True) -> DataFrame:
    """Blocks with the ordered text of their segments: translation, else (with fallback) source."""
    own = F.coalesce(F.when(~T.is_blank(F.coalesce("translated_text", F.lit(""))), F.col("translated_text")), F.col("source_text") if fallback else F.lit(""))
    s = segments.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("idx", T.trim(own).alias("t")))).alias("xs"), F.min_by("target_lang", "idx").alias("lang"))
    parts = F.transform("xs", lambda x: x["t"])
    joined = F.when(T.is_compact(F.col("lang")), F.array_join(parts, "")).otherwise(F.array_join(parts, " "))
    out = blocks.join(s.select("block_id", joined.alias("joined")), "block_id", "left")
    whole = F.col("block_text") if fallback else F.lit("")
    return out.withColumn("text", F.when(F.col("joined").isNull() | T.is_blank(F.col("joined")), whole).otherwise(F.col("joined"))).drop("joined")


def pages_to_run(pages: DataFrame, selected: DataFrame, force: bool = False) -> DataFrame:
    """Selected pages without those that are translated and have an artifact."""
    done = pages.where("status = 'translated' and path is not null").select("job_id", "page_number")
    return selected if force else selected.join(done, ["job_id", "page_number"], "left_anti")


def page_sources(counts: DataFrame, pages: DataFrame) -> DataFrame:
    """For pages 1 to n of each job: the translated artifact, else the source page."""
    every = counts.select("job_id", F.explode(F.sequence(F.lit(1), "n")).alias("page_number"))
    done = pages.where("status = 'translated' and path is not null").select("job_id", "page_number", "path")
    return every.join(done, ["job_id", "page_number"], "left").withColumn("origin", F.when(F.col("path").isNull(), "source").otherwise("translated"))


def live_pages(pages: DataFrame, run: DataFrame) -> DataFrame:
    """Page states under a live run: requested pages are queued, those of the current chunk translating;
    translated pages stay."""
    out = pages.select("job_id", "page_number", "status").join(run.select("job_id", "page_number", "current"), ["job_id", "page_number"], "full_outer")
    return out.select("job_id", "page_number", F.when(F.col("status") == "translated", "translated").when(F.col("current"), "translating").when(F.col("current").isNotNull(), "queued").otherwise(F.col("status")).alias("status"))


def reuse(texts: DataFrame, translated: DataFrame, text: str = "source_text") -> DataFrame:
    """Each text with the translation that stands first for it; every miss is an error row."""
    first = translated.groupBy(text).agg(F.min_by("translation", "position").alias("translation"))
    return texts.join(first, text, "left").withColumn("missing", F.col("translation").isNull())


def zipped_update(segments: DataFrame, ids: DataFrame) -> DataFrame:
    """Set translation and status done for ids zipped with texts (the shorter list ends the zip)."""
    pair = F.arrays_zip(F.slice("ids", 1, F.least(F.size("ids"), F.size("texts"))).alias("segment_id"), F.slice("texts", 1, F.least(F.size("ids"), F.size("texts"))).alias("text"))
    pairs = ids.select(F.posexplode(pair).alias("position", "p")).select("position", F.col("p.segment_id").alias("segment_id"), F.col("p.text").alias("new_text"))
    last = last_per_key(pairs, ["segment_id"], ["position"]).select("segment_id", "new_text")
    out = segments.join(last, "segment_id", "left")
    return out.withColumns({"translated_text": F.coalesce("new_text", "translated_text"), "status": F.when(F.col("new_text").isNotNull(), "done").otherwise(F.col("status"))}).drop("new_text")


def matching_pages(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates whose page is still as they saw it; null version equals null."""
    c = candidates.alias("c")
    p = pages.alias("p")
    on = (F.col("c.job_id") == F.col("p.job_id")) & (F.col("c.page_number") == F.col("p.page_number")) & F.col("c.path").eqNullSafe(F.col("p.path")) & F.col("c.version").eqNullSafe(F.col("p.version"))
    return c.join(p, on, "left_semi")


def requests_in_runs(requests: DataFrame, runs: DataFrame, slop_ms: int = 5000) -> DataFrame:
    """Requests within each run's window widened by slop.

    The window is cut into slots as wide as its slop-bounded bucket so that the range
    condition rides on an equi-join; a request is in one slot, a run in each slot it covers.
    A run whose own context matches no request takes all in its window.  Which runs these are
    is told by the first and last time of each context in a slot, as a window of several slots holds
    an end of each; windows within one slot look at the requests.  So the requests in the windows
    are the result as they are joined, and are not gathered by run.
    """
    slot = 3_600_000
    lo, hi = F.col("start_ms") - slop_ms, F.col("end_ms") + slop_ms
    runs = runs.where(lo <= hi)
    slots = F.sequence(F.floor(lo / slot), F.floor(hi / slot))
    q = requests.withColumn("slot", F.floor(F.col("timestamp_ms") / slot))
    own = F.col("context") == F.col("wanted")
    within = F.col("timestamp_ms").between(lo, hi)

    times = q.where("context is not null").groupBy("slot", "context").agg(F.min("timestamp_ms").alias("least"), F.max("timestamp_ms").alias("most"))
    times = times.groupBy("slot").agg(F.collect_list(F.struct("context", "least", "most")).alias("times"))
    r = runs.select("run_id", "start_ms", "end_ms", "wanted", F.explode(slots).alias("slot"))
    several = F.floor(lo / slot) < F.floor(hi / slot)
    met = r.where(several).join(times, "slot").select("run_id", "wanted", F.filter("times", lambda x: (x["most"] >= lo) & (x["least"] <= hi)).alias("met"))
    told = met.select("run_id", F.exists("met", lambda x: x["context"] == F.col("wanted")).alias("some"), (F.col("wanted").isNotNull() & (F.size("met") > 0)).alias("known"))
    if not runs.where(~several).isEmpty():
        told = told.unionByName(r.where(~several).join(q.select("slot", "timestamp_ms", "context"), "slot").where(within).select("run_id", own.alias("some"), own.isNotNull().alias("known")))
    told = told.groupBy("run_id").agg(F.coalesce(F.bool_or("some"), F.lit(False)).alias("some"), F.bool_or("known").alias("known"))

    taking = runs.join(told.where("known").drop("known"), "run_id").withColumn("slot", F.explode(slots))
    return taking.join(q.withColumnRenamed("run_id", "q_run"), "slot").where(within & (own | ~F.col("some"))).drop("slot", "some")


def reconciled_pages(pages: DataFrame, listing: DataFrame) -> DataFrame:
    """State against files, both ways: translated without a file is pending, a file without state is translated."""
    out = pages.select("job_id", "page_number", "status", "path").join(listing.select("job_id", "page_number", F.col("path").alias("file")), ["job_id", "page_number"], "full_outer")
    return out.select("job_id", "page_number", F.when(F.col("file").isNotNull() & F.coalesce(F.col("status") != "failed", F.lit(True)), "translated").when((F.col("status") == "translated") & F.col("file").isNull(), "pending").otherwise(F.col("status")).alias("status"), F.coalesce("file", F.when(F.col("status") != "translated", F.col("path"))).alias("path"))


def requested_page_states(requested_: DataFrame, pages: DataFrame) -> DataFrame:
    out = requested_.join(pages.select("job_id", "page_number", "status"), ["job_id", "page_number"], "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    s = F.col("status")
    return out.groupBy("job_id").agg(F.count(F.lit(1)).alias("requested"), F.count_if(s == "translated").alias("translated"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "missing").alias("missing"))


def first_artifact(candidates: DataFrame) -> DataFrame:
    """The existing candidate of least priority per page."""
    return candidates.where("present").groupBy("job_id", "page_number").agg(F.min_by("path", "priority").alias("path"))


def running_total(rows: DataFrame, part: list[str], order: list, column: str, name: str) -> DataFrame:
    """Sum of column over the rows before each row."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(column).over(w), F.lit(0)))
