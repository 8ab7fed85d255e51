"""Delays and rates as release times: what a sender that waits would do, computed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import forget, kept, reachable, same


def delayed(events: DataFrame, threads: dict[str, int]) -> DataFrame:
    """Each event once per sending thread {name: -seconds}, with thread and send_ts."""
    rows = F.array(*[F.struct(F.lit(n).alias("thread"), F.lit(abs(s)).alias("_delay")) for n, s in threads.items()])
    out = events.withColumn("_t", F.explode(rows)).select(*events.columns, "_t.*")
    return out.withColumn("send_ts", F.timestamp_add("SECOND", F.col("_delay"), F.col("ts"))).drop("_delay")


def _numbered_reach(events: DataFrame, keys: list[str], seconds: str, block: int, weight: float, fall: float) -> DataFrame:
    """events with _k, the number of a row in its key by seconds and n, and _reach, the greatest weight * second - fall * _k so far.

    Two levels keep a hot key from being one task: counts and maxima of blocks of seconds, what comes before each block
    (one row a block), and a window inside each block.
    """
    rows = events.withColumn("_block", F.floor(F.col(seconds) / block))
    order = Window.partitionBy(*keys, "_block").orderBy(seconds, "n")
    rows = rows.withColumn("_in", F.row_number().over(order)).withColumn("_up", F.col(seconds) * weight - F.col("_in") * fall)
    blocks = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_rows"), F.max("_up").alias("_top"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # Rows before a block lower all its values by the same.
    blocks = blocks.withColumn("_ahead", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    blocks = blocks.withColumn("_before", F.max(F.col("_top") - F.col("_ahead") * fall).over(before)).drop("_rows", "_top")
    rows = rows.withColumn("_up", F.max("_up").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # <=>: keys may be null.
    blocks = blocks.select(*[F.col(c).alias(f"_b_{c}") for c in (*keys, "_block")], "_ahead", "_before")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in (*keys, "_block")])
    rows = rows.join(blocks, same).drop(*[f"_b_{c}" for c in (*keys, "_block")])
    own = F.col("_up") - F.col("_ahead") * fall
    return rows.withColumns({"_k": F.col("_in") + F.col("_ahead"), "_reach": F.greatest(own, F.col("_before"))}).drop("_block", "_in", "_up", "_ahead", "_before")


def token_bucket(events: DataFrame, keys: list[str], rate: int, seconds: str = "t", block: int = 1 << 12) -> DataFrame:
    """Release second of each event under a bucket of capacity rate that refills rate tokens a second.

    With n the event's number and t its second, the earliest release is the greatest over all earlier events m of
    t_m + (n - m - rate + 1) / rate, and its own t: one running maximum.
    """
    rows = events if "n" in events.columns else events.withColumn("n", F.monotonically_increasing_id())
    rows = _numbered_reach(rows, keys, seconds, block, rate, 1)
    return rows.withColumn("release", F.greatest(F.col(seconds).cast("double"), (F.col("_reach") + F.col("_k") - rate + 1) / rate)).drop("_k", "_reach")


def spaced(events: DataFrame, keys: list[str], gap: float, seconds: str = "t", block: int = 1 << 12) -> DataFrame:
    """Release second when at least gap seconds lie between two: t_n' = max(t_n, t_(n-1)' + gap), as a running maximum."""
    rows = _numbered_reach(events, keys, seconds, block, 1, gap)
    return rows.withColumn("release", F.col("_reach") + F.col("_k") * gap).drop("_k", "_reach")


def _next_after(times: DataFrame, gap: float) -> DataFrame:
    """(_k, at, to): for each of the distinct times (_k, at) of a key the least that is at least gap later, where there is one.

    Times are dealt by intervals of gap: what is at least gap later than a time of interval b lies in b + 1 or beyond. In b + 1 it is found by a
    running minimum over that interval alone; beyond it is the first time of the next interval that has any, one row an interval.
    """
    rows = times.withColumn("_b", F.floor(F.col("at") / gap))
    given = rows.select("_k", "_b", F.col("at").alias("_x"), F.lit(None).cast(times.schema["at"].dataType).alias("at"), F.lit(1).alias("_given"))
    asked = rows.select("_k", (F.col("_b") + 1).alias("_b"), (F.col("at") + gap).alias("_x"), "at", F.lit(0).alias("_given"))
    down = Window.partitionBy("_k", "_b").orderBy(F.desc("_x"), F.desc("_given")).rowsBetween(Window.unboundedPreceding, 0)
    near = given.unionByName(asked).withColumn("_near", F.min(F.when(F.col("_given") == 1, F.col("_x"))).over(down)).filter("_given = 0")
    firsts = rows.groupBy("_k", "_b").agg(F.min("at").alias("_first"))
    order = Window.partitionBy("_k").orderBy("_b")
    skip = F.lead("_b").over(order) == F.col("_b") + 1
    beyond = F.when(skip, F.lead("_first", 2).over(order)).otherwise(F.lead("_first").over(order))
    beyond = firsts.select(F.col("_k").alias("_fk"), (F.col("_b") + 1).alias("_fb"), beyond.alias("_beyond"))
    both = near.join(beyond, same(near, beyond, {"_k": "_fk", "_b": "_fb"}))
    return both.select("_k", "at", F.coalesce("_near", "_beyond").cast(times.schema["at"].dataType).alias("to")).filter("to IS NOT NULL")


def accepted_every(events: DataFrame, key: str, gap: float, seconds: str = "t") -> DataFrame:
    """Events that come at least gap seconds after the last accepted one of their key; the first is accepted.

    Each time has one successor, the next that may be accepted after it; what is reachable from a key's first time is accepted. Pointers
    to successors double, so no key is one task. Of several events at an accepted time the least row is taken. Events
    without a time are never accepted; those without a key are one key. A gap of 0 or less accepts every event that has a time. Exact for whole numbers.
    """
    rows = events.filter(F.col(seconds).isNotNull())
    if gap <= 0:
        return rows
    times = kept(rows.select(F.col(key).alias("_k"), F.col(seconds).alias("at")).distinct())
    taken = reachable(_next_after(times, gap), times.groupBy("_k").agg(F.min("at").alias("at")), ["_k"])
    forget(times)
    rest = [c for c in events.columns if c not in (key, seconds)]
    one = rows.groupBy(key, seconds).agg(F.min(F.struct(*rest)).alias("_r")) if rest else rows.distinct()
    got = one.join(taken, same(one, taken, {key: "_k", seconds: "at"}), "left_semi")
    return got.select(*[F.col(f"_r.{c}").alias(c) if c in rest else F.col(c) for c in events.columns])
