"""Tables between stages, connected components and small helpers for the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder from spark.checkpoint.dir; where unset, a new folder in local mode only, set once."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="docflow-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/docflow/{uuid.uuid4().hex[:12]}-{name}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table in the shared folder and read it: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(stashed: DataFrame) -> None:
    """Delete the files of a stash that nothing reads any more."""
    spark = stashed.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in stashed.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished plans: it acts on the driver's collector."""
    spark._jvm.java.lang.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_join(big: DataFrame, small: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """big joined to small by key (one column or several), where small has a row per key and c, the number of big's rows with it.

    At most HEAVY keys can have more than total / HEAVY of big's total rows; these are broadcast, so their
    rows stay where they are, and only the rows of the others are shuffled by key.
    """
    heavy = F.col("c") > F.lit(max(LIGHT, total // HEAVY))
    key = [key] if isinstance(key, str) else key
    hot = small.where(heavy).drop("c")
    return big.join(F.broadcast(hot), key).unionByName(big.join(F.broadcast(hot.select(*key)), key, "left_anti").join(small.where(~heavy).drop("c"), key))


#: Keys that spread_join may broadcast at most, and rows of a key that are never too many for a task.
HEAVY, LIGHT = 10_000, 2_000


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("ups"), F.lit(0).alias("hub")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("ups"), F.lit(1).alias("hub")))
    return ends.groupBy("x").agg(F.sum("ups").alias("ups"), F.max("hub").alias("hub")).where("ups > 1 or (ups = 1 and hub = 1)").isEmpty()


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component) for the nodes of edges(u, v); a component is named by its least node.

    Large-star / small-star contraction: every round replaces edges by edges to the
    least neighbour, with partial aggregation before each shuffle, until only stars
    are left.  A node with very many neighbours is met by a broadcast of its least one
    (see spread_join), so no step gathers a hub's edges in one task.  Null ends and loops are
    ignored.  Edges that aren't stars after ``rounds`` (a path of n nodes takes about log n)
    raise an error.
    """
    spark = edges.sparkSession
    e = stash(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        if _stars(e):
            release(spark)
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        total = 2 * e.count()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).select("u", F.least("m", "u").alias("m"), "c")
        large = spread_join(both, least, "u", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, stash(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        drop(before)
    raise RuntimeError(f"components: edges are not stars after {rounds} rounds")
