"""From raw documents to training shards: five stages over the corpus operators.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of ``documents``.  ``run`` writes each stage to a
table in the shared folder and reads it again as the next one's input.

SQL can't express the fitted classifier, so there is no ORACLE_SQL.  Tests hold near-dedup and
decontamination against a brute-force version on a whole table; the classifier is tested on held-out labels,
mixing and sharding by their shares, sizes and slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docflow.llm import decontaminate, mixing, near_dup, quality, shard
from docflow.llm.common import stash, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.select_quality(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least id of each near-duplicate group stays (five-word shingles, similarity 0.8).

    Of several rows with that id the one whose columns hash least stays; rows with a null id all stay.
    """
    gone = stash(near_dup.near_duplicates(docs).where("not kept").select("doc_id").distinct(), "gone")
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("doc_id is not null and rows > 1").select("doc_id")
    again = stash(again.join(gone, "doc_id", "left_anti"), "repeated-ids")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns))
    one = left.join(again, "doc_id", "left_semi").withColumn("row in id", F.row_number().over(order)).where("`row in id` = 1").select(docs.columns)
    return left.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(one)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, by the target weights, each document at most once."""
    return mixing.mixed_documents(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Forty shards of near-equal bytes."""
    return shard.shards(docs)


STAGES = [
    ("quality_classifier", classify),
    ("minhash_near_dedup", deduplicate),
    ("benchmark_decontamination", remove_leaks),
    ("source_mixing", mix_sources),
    ("sharding", assign_shards),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
