"""Reading documents from folders and keyed JSON state from files."""

from __future__ import annotations

import re
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from docflow.functions import text as T
from docflow.operators import generators as G

#: Limits of an import (fixed values).
MAX_TEXT_BYTES = 5 * 1024 * 1024
MAX_PDF_BYTES = 100 * 1024 * 1024
MAX_PDF_PAGES = 500
MAX_FOLDER_FILES = 200


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared folder; where none is set, a local one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docflow-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/docflow/{uuid.uuid4().hex[:12]}-{name}"


def list_folder(spark: SparkSession, root: str, max_files: int | None = MAX_FOLDER_FILES) -> DataFrame:
    """path, relative_path, format, length, content of the text and Markdown files below root.

    Files in folders whose name begins with a dot are left out; more than max_files is an
    error.  Contents are read lazily by the tasks.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^[a-z0-9]+:/*", "/", root.rstrip("/"))
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), "^" + re.escape(base) + "/?", "")
    out = files.select("path", relative.alias("relative_path"), T.document_format(F.col("path")).alias("format"), "length", "content")
    out = out.where(F.col("format").isin("txt", "markdown") & ~F.col("relative_path").rlike(r"(^|/)\.[^/]*/"))
    if max_files is not None:
        n = out.select("path").limit(max_files + 1).count()
        if n > max_files:
            raise ValueError(f"{root} holds more than {max_files} supported files")
    return out


def decoded(files: DataFrame, max_bytes: int | None = MAX_TEXT_BYTES) -> DataFrame:
    """files with text and error (null if good): over-long, not UTF-8, or blank files are errors.

    Without max_bytes no file is over-long.
    """
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    large = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    error = F.when(large, "too large").when(text.isNull(), "not UTF-8").when(T.is_blank(text), "blank")
    return files.select("relative_path", "format", F.when(error.isNull(), text).alias("text"), error.alias("error"))


def rejected(files: DataFrame) -> DataFrame:
    """relative_path, format, error of the decoded files that import_documents leaves out."""
    return files.where("error is not null").select("relative_path", "format", "error")


def all_accepted(files: DataFrame) -> DataFrame:
    """The decoded files; reading one that was rejected, other than for being blank, is an error."""
    failure = F.raise_error(F.concat_ws(": ", "relative_path", "error")).cast("string")
    return files.withColumn("text", F.when(F.coalesce(F.col("error"), F.lit("blank")) != "blank", failure).otherwise(F.col("text")))


def import_documents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, segments) of good files(relative_path, format, text), numbered within a file.

    Other files are left out; ``rejected`` lists them, ``all_accepted`` makes them an error.
    file_id is the path's rank among the imported paths.
    """
    good = files.where("text is not null")
    blocks = G.parse(good, F.col("format"), "relative_path")
    return blocks, G.block_segments(blocks)


def project_format(files: DataFrame) -> str:
    """markdown if any file is, else txt."""
    return "markdown" if files.where("format = 'markdown'").limit(1).count() else "txt"


def pdf_check(files: DataFrame) -> DataFrame:
    """Add page_count and error to binary files of PDF kind."""

    @F.pandas_udf("int")
    def count_pages(content: pd.Series) -> pd.Series:
        return content.map(lambda b: len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", b)) if b else 0)

    out = files.withColumn("page_count", count_pages("content"))
    n = F.col("page_count")
    return out.withColumn("error", F.when(F.col("length") > MAX_PDF_BYTES, "too large").when(n < 1, "no pages").when(n > MAX_PDF_PAGES, "too many pages"))


def read_json(spark: SparkSession, path: str, schema: S.StructType | str, lines: bool = False, tolerant: bool = False) -> DataFrame:
    """Typed JSON.  Tolerant reading keeps rows it can't parse as nulls; else one is an error."""
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE" if tolerant else "FAILFAST").json(path)


def read_jsonl_if_exists(spark: SparkSession, path: str, schema: S.StructType | str) -> DataFrame:
    try:
        return read_json(spark, path, schema, lines=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def bundle(jobs: DataFrame, segments: DataFrame, job_id: Column | str) -> DataFrame:
    """One job with its segments nested in order."""
    own = segments.where(F.col("job_id") == job_id).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "idx", "segment_id", "status"))).alias("segments"))
    return jobs.where(F.col("job_id") == job_id).join(own, "job_id", "left")
