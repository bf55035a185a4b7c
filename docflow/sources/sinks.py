"""Writing: Spark's committer makes each write atomic; keys become partition folders."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docflow.functions import text as T


def write_json(df: DataFrame, path: str, keys: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").option("ignoreNullFields", "false")
    (w.partitionBy(*keys) if keys else w).json(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_bundle(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace only the partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def export_documents(documents: DataFrame, path: str, key: str = "doc_id", text: str = "document") -> None:
    """One text file folder per document."""
    documents.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).option("lineSep", "\n").text(path)


def publish(df: DataFrame, path: str, valid) -> tuple[int, int]:
    """Validate, then append the valid rows; returns (published, rejected), counted in the same pass.

    A row for which validity is null is rejected.
    """
    seen = Observation()
    checked = df.withColumn("valid_", F.coalesce(valid, F.lit(False)))
    checked = checked.observe(seen, F.count_if("valid_").alias("good"), F.count_if(~F.col("valid_")).alias("bad"))
    checked.where("valid_").drop("valid_").write.mode("append").parquet(path)
    return seen.get["good"], seen.get["bad"]


def without_deleted(df: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    return df.join(tombstones.select(key), key, "left_anti")


def rewrite_partition(spark: SparkSession, path: str, keep) -> None:
    """Replace a table by its rows that keep holds for: written beside it, then renamed into its place.

    The former folder is ``.old`` until the new one stands, so a failure in between loses nothing.
    """
    spark.read.parquet(path).where(keep).write.mode("overwrite").parquet(path + ".next")
    fs, at = _files(spark, path)
    fs.delete(at(path + ".old"), True)
    for source, target in ((path, path + ".old"), (path + ".next", path)):
        if not fs.rename(at(source), at(target)):
            raise OSError(f"cannot rename {source} to {target}")
    fs.delete(at(path + ".old"), True)


def _files(spark: SparkSession, path: str):
    """(file system of the path, its path class)."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_profiles(profiles: DataFrame, path: str) -> bool:
    """One JSON folder per (job_id, run_id), replacing those that are there; false if that failed.

    Diagnostics never stop a run, so a failure is only logged.
    """
    try:
        profiles.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("job_id", "run_id").json(path)
    except Exception:
        logging.getLogger(__name__).warning("profiles were not written to %s", path, exc_info=True)
        return False
    return True


def remove_artifacts(spark: SparkSession, folder: str) -> list[str]:
    """Delete the page translation artifacts of one job's folder; returns their paths in it.

    Folders go whole and are not listed, so the driver holds the folder's own entries only.
    """
    fs, at = _files(spark, folder)
    found = [(s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(at(folder))] + [("exports/translated.pdf", False)]
    rows = spark.createDataFrame(found, "path string, folder boolean").where(T.is_translation_artifact(F.col("path")) & (~F.col("folder") | F.col("path").isin(*T.ARTIFACT_FOLDERS)))
    return sorted(r.path for r in rows.collect() if fs.delete(at(f"{folder}/{r.path}"), True))
