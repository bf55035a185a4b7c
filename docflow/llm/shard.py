"""Operator 8: sharding by sampled splitters.

The key of a row is the hash of its text, then a hash of its id, so equal texts lie
next to each other and still can be divided.  A sample drawn with probability in
proportion to size gives the splitters: its quantiles bound key ranges of about equal
bytes.  Ranges that turn out overfull are sampled again and subdivided.  The exact
bytes and rows before each range come from one small aggregation, the position inside
a range from a window over that range only, and the shard of a row is the n-th part of
all bytes in which the row's middle lies (law ``bytes``).  A group of equal texts is divided only
where a shard ends, so at most ``shards - 1`` groups lie in more than one shard.

Bounds: the sample is about ``32 * ranges`` keys of 16 bytes with
``ranges <= max_ranges``; splitters and range totals have ``ranges`` rows and are the
only data that is broadcast.  Texts are never shuffled.

Null text counts as empty (size 16); a null id takes part like any other value;
repeated rows are separate rows.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

#: Per-record overhead in bytes.
RECORD = 16


def locate(h: np.ndarray, g: np.ndarray, sh: np.ndarray, sg: np.ndarray) -> np.ndarray:
    """How many splitters (sh, sg), sorted, are at or below each key (h, g)."""
    out, hi = np.searchsorted(sh, h, "left"), np.searchsorted(sh, h, "right")
    tied = np.flatnonzero(hi > out)
    if len(tied):
        for value in np.unique(h[tied]):
            own = tied[h[tied] == value]
            a, b = out[own[0]], hi[own[0]]
            out[own] = a + np.searchsorted(sg[a:b], g[own], "right")
    return out


def _ranged(batches: Iterator[pa.RecordBatch], splitters) -> Iterator[pa.RecordBatch]:
    sh, sg = splitters.value
    for b in batches:
        f = locate(b.column("h").to_numpy(), b.column("g").to_numpy(), sh, sg)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(f.astype(np.int64))], [*b.schema.names, "f"])


def _sample(df: DataFrame, want: int, total: int, seed: int) -> list[tuple[int, int, float]]:
    """(h, g, weight) of rows drawn with probability min(1, want * size / total), by hash: repeatable."""
    u = (F.xxhash64("h", "g", F.lit(seed)).cast("double") + 2.0**63) / 2.0**64
    p = F.least(F.lit(1.0), F.col("size") * (want / max(1, total)))
    return sorted(map(tuple, df.where(u < p).select("h", "g", (F.col("size") / p).alias("w")).collect()))


def _quantiles(sample: list, parts: int) -> list[tuple[int, int]]:
    if not sample or parts < 2:
        return []
    w = np.cumsum([x[2] for x in sample])
    at = np.searchsorted(w, w[-1] * np.arange(1, parts) / parts)
    return [sample[int(i)][:2] for i in np.minimum(at, len(sample) - 1)]


def shards(docs: DataFrame, n_shards: int = 40, max_rows: int = 1_000_000, max_ranges: int = 32_768, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stash(docs.select("doc_id", (F.octet_length(text) + F.lit(RECORD)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.xxhash64("doc_id", F.lit(seed)).alias("g")), "keys")
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = min(max_ranges, max(16 * n_shards, -(-count // max_rows)))
    splitters = sorted(set(_quantiles(_sample(rows, 32 * ranges, total, seed), ranges)))
    schema = "doc_id {}, size long, text_crc32 long, h long, g long, f long".format(rows.schema["doc_id"].dataType.simpleString())
    for again in range(4):
        cut = spark.sparkContext.broadcast((np.array([s[0] for s in splitters], np.int64), np.array([s[1] for s in splitters], np.int64)))
        placed = rows.mapInArrow(lambda it, cut=cut: _ranged(it, cut), schema)
        sums = stash(placed.groupBy("f").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "ranges")
        over = sums.where(f"n > {2 * max_rows}").select("f", "n", "bytes").collect()
        finer = set(splitters)
        for f, n, size in over:
            finer |= set(_quantiles(_sample(placed.where(F.col("f") == f), 32 * (n // max_rows + 1), size, seed + again + 1), n // max_rows + 1))
        if len(finer) == len(splitters):
            break
        splitters = sorted(finer)
    before = Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("f", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("f").orderBy("h", "g", "doc_id")
    at = placed.join(F.broadcast(offsets), "f")
    at = at.withColumn("b", F.col("b0") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("r", F.col("n0") + F.row_number().over(inside) - 1)
    at = at.withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"((2 * b + size) * {n_shards}) div {max(1, 2 * total)}")).cast("int"))
    at = stash(at.select("doc_id", "size", "text_crc32", "shard", "r"), "placed")
    start = at.groupBy("shard").agg(F.min("r").alias("r0"))
    return at.join(F.broadcast(start), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("r") - F.col("r0")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_sampled_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))
