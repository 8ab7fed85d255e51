"""A table of the latest row of each key, kept over micro-batches: what a compacted topic holds.

Each batch writes the latest rows of its keys under its own number, and what is read is
the latest over all of them. Now and then these are merged into one base. A batch that runs again
overwrites its own rows, or finds that a base has them already, so nothing changes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class LatestTable:
    """The row with the greatest `order` of each of `keys`, in folders base-<batch> and delta-<batch> of path."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, merge_every: int = 20):
        self.spark, self.path, self.keys, self.order, self.every = spark, path.rstrip("/"), keys, order, merge_every

    def _fs(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def parts(self) -> tuple[int, list[int]]:
        """Number of the latest base (-1: none), and of the deltas after it; only what has been written to its end."""
        at, fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        found = [(m[1], int(m[2])) for n in names if (m := re.fullmatch(r"(base|delta)-(\d+)", n)) and fs.exists(path(f"{self.path}/{n}/_SUCCESS"))]
        base = max((k for kind, k in found if kind == "base"), default=-1)
        return base, sorted(k for kind, k in found if kind == "delta" and k > base)

    def latest(self, rows: DataFrame) -> DataFrame:
        """The last row of each key; of equal ones the greatest."""
        rest = [c for c in rows.columns if c not in self.keys]
        best = rows.groupBy(*self.keys).agg(F.max(F.struct(self.order, *[c for c in rest if c != self.order])).alias("_r"))
        return best.select(*[F.col(c) if c in self.keys else F.col(f"_r.{c}").alias(c) for c in rows.columns])

    def read(self, schema=None) -> DataFrame | None:
        """The latest rows; without any an empty table of the schema, or None."""
        base, deltas = self.parts()
        folders = [f"{self.path}/base-{base}"] * (base >= 0) + [f"{self.path}/delta-{k}" for k in deltas]
        if not folders:
            return self.spark.createDataFrame([], schema) if schema else None
        rows = self.spark.read.parquet(*folders)
        return self.latest(rows) if deltas else rows

    def upsert(self, batch: DataFrame, number: int) -> None:
        base, deltas = self.parts()
        if number <= base:
            return
        self.latest(batch).write.mode("overwrite").parquet(f"{self.path}/delta-{number}")
        if len({*deltas, number}) >= self.every:
            self.merge()

    def merge(self) -> None:
        """All that is read now becomes the next base; the base before it and its deltas stay for readers that have begun."""
        base, deltas = self.parts()
        if not deltas:
            return
        self.read().write.mode("overwrite").parquet(f"{self.path}/base-{deltas[-1]}")
        at, fs = self._fs()
        for s in fs.listStatus(at):
            if (m := re.fullmatch(r"(base|delta)-(\d+)", s.getPath().getName())) and (int(m[2]) < base or m[1] == "delta" and int(m[2]) <= base):
                fs.delete(s.getPath(), True)
