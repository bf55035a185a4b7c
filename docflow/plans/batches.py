"""Batch planning over ordered texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions import values as V


def batch_numbers(lengths: Column, ceiling: int) -> Column:
    """Batch number (from 0) of each length in order.

    A batch is closed when one more text would exceed the slots that the longest text,
    the new one included, allows.
    """
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("batch"), F.lit(0).alias("size"), F.lit(0).alias("longest"))

    def step(a: Column, n: Column) -> Column:
        n = n.cast("int")
        full = (a["size"] > 0) & (a["size"] + 1 > V.batch_cap(ceiling, F.greatest(a["longest"], n)))
        batch = a["batch"] + full.cast("int")
        return F.struct(F.array_append(a["out"], batch).alias("out"), batch.alias("batch"), F.when(full, 1).otherwise(a["size"] + 1).alias("size"), F.when(full, n).otherwise(F.greatest(a["longest"], n)).alias("longest"))

    return F.aggregate(lengths, start, step, lambda a: a["out"])


def plan(rows: DataFrame, key: str, order: str, text: str, ceiling: int) -> DataFrame:
    """rows with batch_no within key, in order."""
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.length(text).alias("n")))).alias("xs"))
    numbered = F.zip_with("xs", batch_numbers(F.transform("xs", lambda x: x["n"]), ceiling), lambda x, b: F.struct(x[order].alias(order), x["n"].alias("n_chars"), b.alias("batch_no")))
    return g.select(key, F.explode(numbered).alias("x")).select(key, "x.*")


def windowed_batches(times: Column, size: int, wait_ms: int) -> Column:
    """Replay of a count-or-time window: batch number of each arrival time in order.

    A window opens with its first item and closes when it holds size items or wait_ms have passed.
    """
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(-1).alias("batch"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("opened"))

    def step(a: Column, t: Column) -> Column:
        new = a["opened"].isNull() | (a["n"] >= size) | (t - a["opened"] >= wait_ms)
        batch = a["batch"] + new.cast("int")
        return F.struct(F.array_append(a["out"], batch).alias("out"), batch.alias("batch"), F.when(new, 1).otherwise(a["n"] + 1).alias("n"), F.when(new, t).otherwise(a["opened"]).alias("opened"))

    return F.aggregate(times, start, step, lambda a: a["out"])
