"""Structured Streaming: worker events, page commits and count-or-time micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docflow.operators.state import upsert_pages

EVENT = "job_id string, event string, page_number int, path string, ts_ms long"


def demux(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON event lines with kind page, stage, done, error or fatal; others and bad lines are other."""
    e = lines.select(F.from_json(column, EVENT).alias("e")).select("e.*")
    known = F.col("event").isin("page", "stage", "done", "error", "fatal")
    return e.withColumn("kind", F.when(known, F.col("event")).otherwise("other"))


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 32) -> DataFrame:
    """Event lines of a folder as they arrive; the rate limit is the back-pressure."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(folder)


def commit_pages(stream: DataFrame, state_path: str, checkpoint: str):
    """Upsert page events into a versioned page table; each micro-batch writes a version once.

    An event older than the state it meets, because files came out of order, changes nothing.
    A batch that is run again after a failure overwrites its own version, so every event takes effect once.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        schema = "job_id string, page_number int, status string, path string, version string, seq long"
        old = spark.read.schema(schema).parquet(f"{state_path}/v={number - 1}") if number else spark.createDataFrame([], schema)
        new = demux(batch).where("kind in ('page', 'error')").select("job_id", "page_number", F.when(F.col("kind") == "page", "translated").otherwise("failed").alias("status"), "path", F.lit(None).cast("string").alias("version"), F.col("ts_ms").alias("seq"))
        upsert_pages(old, new).write.mode("overwrite").parquet(f"{state_path}/v={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def micro_batches(stream: DataFrame, key: str, size: int, wait_ms: int) -> DataFrame:
    """Rows (key, item, ts_ms) of a stream gathered per key: batch closes at size items or wait_ms of processing time.

    Returns key, items (array), reason (size or time).
    """
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            if held:
                yield pd.DataFrame({key: [k[0]], "items": [held], "reason": ["time"]})
            return
        out = []
        for f in frames:
            held += f.sort_values("ts_ms")["item"].tolist()
        while len(held) >= size:
            out.append(held[:size])
            held = held[size:]
        state.update((held,))
        state.setTimeoutDuration(wait_ms)
        if out:
            yield pd.DataFrame({key: [k[0]] * len(out), "items": out, "reason": ["size"] * len(out)})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, items array<string>, reason string", "held array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_timeline(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Extension: event-time windows with a watermark over (ts, event_type, value).

    A zoneless ts is read in the session's time zone, as a watermark needs an instant.
    """
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


#: States after which a run reports nothing new.
ENDED = ("completed", "failed", "cancelled")


def reported_ids(polls: DataFrame) -> DataFrame:
    """run_id, poll, kind (completed or failed), id: one row per id of each status report."""
    kinds = F.explode(F.create_map(F.lit("completed"), "completed", F.lit("failed"), "failed"))
    return polls.select("run_id", "poll", kinds.alias("kind", "ids")).select("run_id", "poll", "kind", F.explode("ids").alias("id"))


def new_ids(polls: DataFrame) -> DataFrame:
    """run_id, poll, kind, id: the ids that no earlier report of the run named.

    polls holds run_id, poll, state and the arrays completed and failed; reports after the first
    that ends the run are ignored.  Ids are counted where they lie before the shuffle, and no run is gathered in a row.
    """
    end = polls.where(F.col("state").isin(*ENDED)).groupBy("run_id").agg(F.min("poll").alias("end"))
    live = polls.join(end, "run_id", "left").where("end is null or poll <= end")
    return reported_ids(live).groupBy("run_id", "kind", "id").agg(F.min("poll").alias("poll")).select("run_id", "poll", "kind", "id")


def new_id_stream(polls: DataFrame) -> DataFrame:
    """Ids of a stream of reports as they are first seen; reports after a run's end are not told apart.

    The state holds every id of every run, without a bound.
    """
    return reported_ids(polls).dropDuplicates(["run_id", "kind", "id"])
