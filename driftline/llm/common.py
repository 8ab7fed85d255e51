"""Small helpers of the operators: input columns, lineage cuts, table reading."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of the tables that written() has made and nobody has released yet, in order.
SCRATCH: list[str] = []
#: Bytes of an Arrow batch of a plan that written() runs.
BATCH = 4 << 20


def folder(spark: SparkSession) -> str:
    """The shared folder for intermediate data: that of spark.checkpoint.dir; one of our own only in local mode, where driver and executors are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="driftline-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of about BATCH bytes at most to the workers of what runs meanwhile.

    Spark's own limit is 64 MB and 10,000 rows, and a batch is there several times, in the executor, outside its heap, and in the worker.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, which goes with release() or when the driver ends.

    For loops with several joins: on checkpoints alone the planning of each round took twice as long as that of the last.
    """
    spark = df.sparkSession
    out = f"{folder(spark)}/written-{uuid.uuid4().hex}"
    SCRATCH.append(out)
    with small_batches(spark):
        df.write.parquet(out)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(out)


def release(spark: SparkSession, paths: list[str], needed: DataFrame | None = None) -> list[str]:
    """Removes these tables but those that `needed` reads, and has Spark free what nothing refers to any more; returns the paths that stay."""
    read = needed.inputFiles() if needed is not None and paths else []
    stay = [p for p in paths if any(p.rsplit("/", 1)[1] in f for f in read)]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        if p not in stay:
            at = jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(conf).delete(at, True)
            SCRATCH[:] = [x for x in SCRATCH if x != p]
    gc.collect()
    jvm.System.gc()  # the cleaner of shuffle files and checkpoints goes by the driver's garbage
    return stay


def plain(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns' names can't clash with ours."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def same_columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    """df with the columns of docs, in their order."""
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def connected(links: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable over undirected links (u, v), by minimum labels and pointer jumping.

    Work is joins and grouped minima; labels are checkpointed each round and only
    the number of changes reaches the driver.
    """
    both = cut(links.select("u", "v").union(links.select("v", "u")).distinct())
    label = cut(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("near")).select("id", F.least("id", "near").alias("component")))
    while True:
        seen = both.join(label.select(F.col("id").alias("v"), "component"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("near"))
        step = label.join(seen, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        jump = label.select(F.col("id").alias("now"), F.col("component").alias("far"))
        step = cut(step.join(jump, "now", "left").select("id", "was", F.least("now", F.coalesce("far", "now")).alias("component")))
        label = step.select("id", "component")
        if step.filter("component < was").isEmpty():
            return label


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers of a session that began without this repository on its path import it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, have)])
    return spark
