"""Tables that a query writes once and reads more than once, and chains that are followed through them."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """That of spark.checkpoint.dir; one of our own only in local mode, where driver and executors are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="driftline-checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, which goes with forget() or when the driver ends."""
    spark = df.sparkSession
    out = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(out)
    at, fs = _store(spark, out)
    fs.deleteOnExit(at)
    table = spark.read.schema(df.schema).parquet(out)
    table._kept_at = out
    return table


def forget(*tables: DataFrame) -> None:
    """Removes tables of kept() that nothing reads any more."""
    for t in tables:
        at, fs = _store(t.sparkSession, t._kept_at)
        fs.delete(at, True)


def same(left: DataFrame, right: DataFrame, pairs: dict[str, str]):
    """The join condition that columns of left equal those of right, nulls together."""
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in pairs.items()])


def last_before(rows: DataFrame, at: str, marks: DataFrame, keys: list[str], value: str, block: int = 1 << 20) -> DataFrame:
    """rows with the value of the last mark (keys, at, value) of their key at or before rows' number `at`, null before the first.

    Rows and marks are united and values carried on inside blocks of numbers; what a block begins with is one row a block.
    """
    kind = marks.schema[value].dataType
    mine = rows.withColumns({"_at": F.col(at), "_mark": F.lit(1), "_v": F.lit(None).cast(kind)})
    theirs = marks.select(*keys, F.col("at").alias("_at"), F.lit(0).alias("_mark"), F.col(value).alias("_v"))
    both = mine.unionByName(theirs, allowMissingColumns=True).withColumn("_b", F.floor(F.col("_at") / block))
    inside = F.last("_v", True).over(Window.partitionBy(*keys, "_b").orderBy("_at", "_mark").rowsBetween(Window.unboundedPreceding, 0))
    ends = both.groupBy(*keys, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_at"))).alias("_end"))
    start = F.last("_end", True).over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    begin = ends.select(*[F.col(c).alias(f"_k_{c}") for c in keys], F.col("_b").alias("_k_b"), start.alias("_start"))
    held = both.withColumn("_in", inside).filter("_mark = 1")
    out = held.join(begin, same(held, begin, {c: f"_k_{c}" for c in keys} | {"_b": "_k_b"}), "left")
    return out.select(*rows.columns, F.coalesce("_in", "_start").alias(value))


def reachable(edges: DataFrame, roots: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at): the roots (keys, at), and what their chains lead to over edges (keys, at, to) of at most one a node, always upwards.

    Pointers double: round r knows each node's 2^r-th successor, and finds what lies within 2^(r+1) steps of a root. So a
    chain of n nodes takes log2(n) rounds of joins on (keys, at), and no chain is ever one task. A round's tables go when the next one has its own.
    """
    jump, found = kept(edges.select(*keys, "at", "to")), kept(roots.select(*keys, "at").distinct())
    size = found.count()
    mine = {c: c for c in keys}
    while size:
        more = found.join(jump, same(found, jump, mine | {"at": "at"})).select(*[jump[c] for c in keys], F.col("to").alias("at"))
        new = kept(found.unionByName(more).distinct())
        forget(found)
        found = new
        size, before = found.count(), size
        if size == before:
            break
        far = jump.select(*[F.col(c).alias(f"_f_{c}") for c in keys], F.col("at").alias("_f_at"), F.col("to").alias("_f_to"))
        new = kept(jump.join(far, same(jump, far, {c: f"_f_{c}" for c in keys} | {"to": "_f_at"})).select(*[jump[c] for c in keys], jump["at"], F.col("_f_to").alias("to")))
        forget(jump)
        jump = new
    forget(jump)
    return found
