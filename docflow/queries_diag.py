"""Queries of request-log and timeline diagnostics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.fixtures import REQ, requests
from docflow.operators import diagnostics as D
from docflow.operators import joins
from docflow.plans import batches

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


_P = "CAST(quantile_disc(latency_ms, {}) AS BIGINT)"
_SNAP = f"request_count, failed_request_count, total_request_ms, max_request_ms, p95_request_ms, total_batch_items, input_chars, output_chars, total_request_ms // request_count AS mean_request_ms"
_SNAPS = f"SELECT {{0}}, count(*) AS request_count, count(*) FILTER (NOT ok) AS failed_request_count, CAST(sum(latency_ms) AS BIGINT) AS total_request_ms, max(latency_ms) AS max_request_ms, {_P.format(0.95)} AS p95_request_ms, CAST(sum(batch_size) AS BIGINT) AS total_batch_items, CAST(sum(input_chars) AS BIGINT) AS input_chars, CAST(sum(output_chars) AS BIGINT) AS output_chars FROM req GROUP BY {{0}}"


@query(f"WITH {REQ}, s AS ({_SNAPS.format('run_id')}) SELECT run_id, {_SNAP} FROM s")
def agg_09_12_17_snapshot(spark, d):
    return D.snapshot(requests(spark, d), ["run_id"])


@query(f"WITH {REQ}, s AS ({_SNAPS.format('run_id, context')}), m AS (SELECT run_id, CAST(sum(request_count) AS BIGINT) AS request_count, CAST(sum(failed_request_count) AS BIGINT) AS failed_request_count, CAST(sum(total_request_ms) AS BIGINT) AS total_request_ms, max(max_request_ms) AS max_request_ms, max(p95_request_ms) AS max_p95_request_ms, CAST(sum(total_batch_items) AS BIGINT) AS total_batch_items FROM s GROUP BY run_id) SELECT *, total_request_ms // request_count AS mean_request_ms, total_batch_items / request_count AS mean_batch_size FROM m")
def agg_10_mth_03_merged_snapshots(spark, d):
    return D.merged(D.snapshot(requests(spark, d), ["run_id", "context"]), ["run_id"])


@query(f"WITH {REQ}, h AS (SELECT run_id, batch_size, count(*) AS n FROM req GROUP BY ALL) SELECT run_id, list(batch_size || ':' || n ORDER BY batch_size) AS sizes FROM h GROUP BY run_id")
def agg_11_histograms(spark, d):
    parts = D.histogram(requests(spark, d), ["run_id", "context"], "batch_size")
    whole = D.merged_histograms(parts, ["run_id"], "batch_size")
    return whole.select("run_id", F.transform("sizes", lambda x: F.concat_ws(":", x["batch_size"].cast("string"), x["n"].cast("string"))).alias("sizes"))


_RATE = "CASE WHEN wall_ms > 0 THEN floor({} * 1000.0::DOUBLE / wall_ms * 100 + 0.5) / 100 ELSE 0 END"


@query(f"WITH {REQ}, t AS (SELECT run_id, count(*) AS requests, CAST(sum(batch_size) AS BIGINT) AS items, CAST(sum(input_chars) AS BIGINT) AS input_chars, CAST(CASE WHEN count(*) < 2 THEN sum(latency_ms) ELSE max(timestamp_ms) - min(timestamp_ms) END AS BIGINT) AS wall_ms, {_P.format(0.5)} AS median_ms, {_P.format(0.95)} AS p95_ms, max(latency_ms) AS max_ms FROM req GROUP BY run_id) SELECT *, {_RATE.format('requests')} AS requests_per_s, {_RATE.format('items')} AS items_per_s, {_RATE.format('input_chars')} AS chars_per_s FROM t")
def agg_13_18_mth_02_throughput(spark, d):
    return D.throughput(requests(spark, d), ["run_id"])


@query(f"WITH {REQ} SELECT context, min(latency_ms) AS least, {_P.format(0.5)} AS p50, {_P.format(0.9)} AS p90, {_P.format(0.95)} AS p95, {_P.format(0.99)} AS p99, max(latency_ms) AS most, avg(latency_ms) AS mean FROM req GROUP BY context")
def agg_16_20_percentiles(spark, d):
    return D.percentiles(requests(spark, d), ["context"], "latency_ms")


@query(f"WITH {REQ} SELECT run_id, max(timestamp_ms) - min(timestamp_ms - latency_ms) AS wall_ms FROM req GROUP BY run_id")
def agg_17_completion_wall(spark, d):
    return D.completion_wall(requests(spark, d), ["run_id"])


@query(f"WITH {REQ} SELECT run_id, context, count(*) AS n, CAST(sum(latency_ms) AS BIGINT) AS total_ms, max(latency_ms) AS max_ms, floor(avg(latency_ms) * 100 + 0.5) / 100 AS mean_ms FROM req GROUP BY ALL")
def agg_14_19_26_stages(spark, d):
    return D.stages(requests(spark, d), ["run_id", "context"])


@query(f"WITH {REQ} SELECT run_id, event_id, timestamp_ms - min(timestamp_ms) OVER (PARTITION BY run_id) AS elapsed_ms FROM req")
def agg_15_win_07_elapsed(spark, d):
    return D.since_start(requests(spark, d), ["run_id"]).select("run_id", "event_id", "elapsed_ms")


@query(f"WITH {REQ}, x AS (SELECT *, CASE WHEN lag(g, 1, NULL) OVER w = g THEN 0 ELSE 1 END AS nw FROM (SELECT *, latency_ms > 200 AS g FROM req) WINDOW w AS (PARTITION BY run_id ORDER BY timestamp_ms, event_id)), y AS (SELECT *, sum(nw) OVER (PARTITION BY run_id ORDER BY timestamp_ms, event_id) AS island FROM x) SELECT run_id, any_value(g) AS g, count(*) AS n, min(timestamp_ms) AS first_ms FROM y GROUP BY run_id, island HAVING count(*) >= 6")
def win_08_stm_08_repeated_runs(spark, d):
    r = requests(spark, d).withColumn("g", F.col("latency_ms") > 200)
    return D.repeated_runs(r, ["run_id"], "g")


@query(f"WITH {REQ}, c AS (SELECT max_by(context, timestamp_ms) AS context FROM req) SELECT event_id FROM req JOIN c USING (context)")
def srt_04_latest_context(spark, d):
    return D.latest_context(requests(spark, d)).select("event_id")


@query(f"WITH {REQ} SELECT run_id, event_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY timestamp_ms, event_id) AS nth FROM req WHERE NOT ok) WHERE nth <= 20")
def srt_05_first_failures(spark, d):
    return D.first_failures(requests(spark, d), ["run_id"]).select("run_id", "event_id", "nth")


@query(f"WITH {REQ}, s AS ({_SNAPS.format('run_id')}) SELECT run_id, list_filter([CASE WHEN failed_request_count > 0 THEN 'failed requests' END, CASE WHEN p95_request_ms > 900 THEN 'slow p95' END, CASE WHEN max_request_ms > 1500 THEN 'slow request' END, CASE WHEN output_chars * 4 < input_chars THEN 'short output' END], lambda x: x IS NOT NULL) AS failures, CASE WHEN failed_request_count > 0 THEN failed_request_count || ' of ' || request_count || ' requests failed' END AS message FROM s")
def prd_16_17_failures(spark, d):
    s = D.failures(D.snapshot(requests(spark, d), ["run_id"]))
    return s.select("run_id", "failures", D.failure_message(F.col("failed_request_count"), F.col("request_count")).alias("message"))


_RUNS = "rn AS (SELECT run_id, min(timestamp_ms) AS start_ms, min(timestamp_ms) + 86400000 AS end_ms, CASE run_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'none' ELSE 'view' END AS wanted FROM req GROUP BY run_id)"


@query(f"WITH {REQ}, {_RUNS}, h AS (SELECT rn.run_id, event_id, context = wanted AS own FROM rn JOIN req q ON q.timestamp_ms BETWEEN start_ms - 5000 AND end_ms + 5000), s AS (SELECT run_id, bool_or(own) AS any_own FROM h GROUP BY run_id) SELECT run_id, event_id FROM h JOIN s USING (run_id) WHERE own OR NOT any_own")
def join_13_requests_in_runs(spark, d):
    r = requests(spark, d)
    runs = r.groupBy("run_id").agg(F.min("timestamp_ms").alias("start_ms")).select("run_id", "start_ms", (F.col("start_ms") + 86_400_000).alias("end_ms"), F.expr("CASE run_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'none' ELSE 'view' END").alias("wanted"))
    return joins.requests_in_runs(r, runs).select("run_id", "event_id")


@query(f"WITH {REQ} SELECT max_by(run_id, coalesce(nullif(CASE WHEN run_id % 2 = 0 THEN 0 ELSE timestamp_ms END, 0), timestamp_ms - 1)) AS run_id FROM req")
def src_13_latest_profile(spark, d):
    r = requests(spark, d)
    started = F.when(F.col("run_id") % 2 == 0, 0).otherwise(F.col("timestamp_ms"))
    return r.agg(F.max_by("run_id", F.coalesce(F.nullif(started, F.lit(0)), F.col("timestamp_ms") - 1)).alias("run_id"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'parse' WHEN 1 THEN 'render' WHEN 2 THEN 'translate' END AS phase FROM events")
def prj_12_phase_of_line(spark, d):
    line = F.expr("CASE event_id % 4 WHEN 0 THEN 'Parse PDF' WHEN 1 THEN 'RENDERing' WHEN 2 THEN 'translate batch' ELSE 'idle' END")
    return requests(spark, d).select("event_id", D.phase_of(line).alias("phase"))


@query(f"WITH {REQ}, a AS (SELECT context, avg(latency_ms) AS m FROM req GROUP BY context) SELECT context, m / (SELECT avg(latency_ms) FROM req WHERE ok) AS ratio FROM a")
def prj_11_comparison(spark, d):
    r = requests(spark, d)
    base = r.where("ok").agg(F.avg("latency_ms").alias("b")).first()[0]
    return r.groupBy("context").agg((F.avg("latency_ms") / F.lit(base)).alias("ratio"))


@query(f"WITH {REQ} SELECT run_id, to_json({{'n': count(*), 'ok': count(*) FILTER (ok)}}) AS details FROM req GROUP BY run_id")
def prj_09_17_details_json(spark, d):
    return requests(spark, d).groupBy("run_id").agg(F.to_json(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ok")).alias("ok"))).alias("details"))


@query(f"WITH {REQ} SELECT event_id, row_number() OVER (PARTITION BY run_id ORDER BY timestamp_ms, event_id) AS idx, (row_number() OVER (PARTITION BY run_id ORDER BY timestamp_ms, event_id) - 1) // 4 AS wave FROM req")
def win_09_waves(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("run_id").orderBy("timestamp_ms", "event_id"))
    return requests(spark, d).select("event_id", n.alias("idx"), F.floor((n - 1) / 4).cast("long").alias("wave"))


@query(f"""WITH RECURSIVE {REQ}, r AS (SELECT run_id, event_id, timestamp_ms, row_number() OVER (PARTITION BY run_id ORDER BY timestamp_ms, event_id) AS k FROM req),
b(run_id, event_id, k, batch, n, opened) AS (SELECT run_id, event_id, k, 0, 1, timestamp_ms FROM r WHERE k = 1 UNION ALL SELECT r.run_id, r.event_id, r.k, CASE WHEN b.n >= 8 OR r.timestamp_ms - opened >= 36000000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.n >= 8 OR r.timestamp_ms - opened >= 36000000 THEN 1 ELSE b.n + 1 END, CASE WHEN b.n >= 8 OR r.timestamp_ms - opened >= 36000000 THEN r.timestamp_ms ELSE opened END FROM b JOIN r ON r.run_id = b.run_id AND r.k = b.k + 1)
SELECT run_id, event_id, batch FROM b""")
def stm_01_replayed_windows(spark, d):
    """STM-01 offline: count-or-time windows over each run's requests."""
    g = requests(spark, d).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("timestamp_ms", "event_id"))).alias("xs"))
    b = batches.windowed_batches(F.transform("xs", lambda x: x["timestamp_ms"]), 8, 36_000_000)
    return g.select("run_id", F.explode(F.arrays_zip(F.transform("xs", lambda x: x["event_id"]).alias("event_id"), b.alias("batch"))).alias("x")).select("run_id", "x.event_id", "x.batch")
