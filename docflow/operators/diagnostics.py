"""Summaries of request logs and run timelines.

Percentiles are nearest-rank (``percentile_disc``), 0 of nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions import values as V


def nearest_rank(column: str, p: float) -> Column:
    return F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})"), F.lit(0)).cast("long")


def snapshot(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Counters of a group of requests: sums, maximum, p95 and whole means."""
    out = requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("request_count"),
        F.count_if(~F.col("ok")).alias("failed_request_count"),
        F.sum("latency_ms").alias("total_request_ms"),
        F.max("latency_ms").alias("max_request_ms"),
        nearest_rank("latency_ms", 0.95).alias("p95_request_ms"),
        F.sum("batch_size").alias("total_batch_items"),
        F.sum("input_chars").alias("input_chars"),
        F.sum("output_chars").alias("output_chars"),
    )
    return out.withColumn("mean_request_ms", V.whole_mean(F.col("total_request_ms"), F.col("request_count")))


def merged(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Snapshots added up.  max_p95_request_ms is the greatest of the p95s, not a percentile."""
    out = snapshots.groupBy(*keys).agg(
        F.sum("request_count").alias("request_count"),
        F.sum("failed_request_count").alias("failed_request_count"),
        F.sum("total_request_ms").alias("total_request_ms"),
        F.max("max_request_ms").alias("max_request_ms"),
        F.max("p95_request_ms").alias("max_p95_request_ms"),
        F.sum("total_batch_items").alias("total_batch_items"),
    )
    return out.withColumns({"mean_request_ms": V.whole_mean(F.col("total_request_ms"), F.col("request_count")), "mean_batch_size": F.col("total_batch_items") / F.col("request_count")})


def histogram(requests: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Sorted array of (value, n) per group, counted before it is gathered."""
    n = requests.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(column, "n"))).alias("sizes"))


def merged_histograms(histograms: DataFrame, keys: list[str], column: str) -> DataFrame:
    flat = histograms.select(*keys, F.explode("sizes").alias("x")).select(*keys, "x.*")
    n = flat.groupBy(*keys, column).agg(F.sum("n").alias("n"))
    return n.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(column, "n"))).alias("sizes"))


def throughput(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Wall time by time stamps (summed latency below two requests) and rates over it."""
    wall = F.when(F.count(F.lit(1)) < 2, F.sum("latency_ms")).otherwise(F.max("timestamp_ms") - F.min("timestamp_ms"))
    out = requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), F.sum("batch_size").alias("items"), F.sum("input_chars").alias("input_chars"), wall.alias("wall_ms"), nearest_rank("latency_ms", 0.5).alias("median_ms"), nearest_rank("latency_ms", 0.95).alias("p95_ms"), F.max("latency_ms").alias("max_ms"))
    return out.withColumns({"requests_per_s": V.rate(F.col("requests"), F.col("wall_ms")), "items_per_s": V.rate(F.col("items"), F.col("wall_ms")), "chars_per_s": V.rate(F.col("input_chars"), F.col("wall_ms"))})


def percentiles(requests: DataFrame, keys: list[str], column: str) -> DataFrame:
    return requests.groupBy(*keys).agg(F.min(column).alias("least"), *[nearest_rank(column, p / 100).alias(f"p{p}") for p in (50, 90, 95, 99)], F.max(column).alias("most"), F.avg(column).alias("mean"))


def completion_wall(requests: DataFrame, keys: list[str]) -> DataFrame:
    """From the first request's start to the last one's end."""
    return requests.groupBy(*keys).agg((F.max("timestamp_ms") - F.min(F.col("timestamp_ms") - F.col("latency_ms"))).alias("wall_ms"))


def stages(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("latency_ms").alias("total_ms"), F.max("latency_ms").alias("max_ms"), V.round_half_up(F.avg("latency_ms"), 2).alias("mean_ms"))


def latest_context(requests: DataFrame) -> DataFrame:
    """The requests that share the context of the last one."""
    last = requests.agg(F.max_by("context", F.struct("timestamp_ms", "event_id")).alias("context"))
    return requests.join(F.broadcast(last), "context", "left_semi")  # one row


def first_failures(requests: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """The first n failures of each group (a report)."""
    w = Window.partitionBy(*keys).orderBy("timestamp_ms", "event_id")
    return requests.where("not ok").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def since_start(events: DataFrame, part: list[str]) -> DataFrame:
    w = Window.partitionBy(*part)
    return events.withColumn("elapsed_ms", F.col("timestamp_ms") - F.min("timestamp_ms").over(w))


def repeated_runs(events: DataFrame, part: list[str], value: str, least: int = 6) -> DataFrame:
    """Runs of at least so many equal values in a row."""
    w = Window.partitionBy(*part).orderBy("timestamp_ms", "event_id")
    marked = events.withColumn("new", F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(w))
    return marked.groupBy(*part, "island", value).agg(F.count(F.lit(1)).alias("n"), F.min("timestamp_ms").alias("first_ms")).where(F.col("n") >= least).drop("island")


def failures(summary: DataFrame) -> DataFrame:
    """Acceptance rules as an array of messages, empty if all hold."""
    rule = lambda c, m: F.when(c, F.lit(m))
    c = F.col
    return summary.withColumn("failures", F.array_compact(F.array(rule(c("failed_request_count") > 0, "failed requests"), rule(c("request_count") == 0, "no requests"), rule(c("p95_request_ms") > 900, "slow p95"), rule(c("max_request_ms") > 1500, "slow request"), rule(c("output_chars") * 4 < c("input_chars"), "short output"))))


def phase_of(line: Column) -> Column:
    """parse, render or translate by keywords of a log line, else null."""
    x = F.lower(line)
    return F.when(x.contains("parse"), "parse").when(x.contains("render"), "render").when(x.contains("translate"), "translate")


def failure_message(failed: Column, total: Column) -> Column:
    return F.when(failed > 0, F.concat(failed.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" requests failed")))
