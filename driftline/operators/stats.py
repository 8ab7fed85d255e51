"""Interval statistics, reports and the reconciliation of what was sent with what arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def intervals(events: DataFrame, seconds: int, keys: list[str] | None = None, received=None, sent=None) -> DataFrame:
    """(keys, time_start, received, sent, eps, total_received, total_sent) per tumbling interval; eps is a whole number."""
    keys, received, sent = keys or [], F.lit(1) if received is None else received, F.lit(1) if sent is None else sent
    start = F.window("ts", f"{int(seconds)} seconds")["start"]
    rows = events.groupBy(*keys, start.alias("time_start")).agg(F.sum(received).cast("long").alias("received"), F.sum(sent).cast("long").alias("sent"))
    return with_totals(rows.withColumn("eps", F.floor(F.col("received") / seconds).cast("long")), keys)


def with_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Interval counters with their running totals; one row per interval, so these are small."""
    so_far = Window.partitionBy(*keys).orderBy("time_start").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"total_received": F.sum("received").over(so_far), "total_sent": F.sum("sent").over(so_far)})


def missing_report(statuses: DataFrame, gaps: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by status of each key, with what is missing."""
    count = lambda s: F.count_if(F.col("status") == s).alias
    empty = F.octet_length("payload") == 0
    rows = statuses.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if((F.col("status") != 1) & ~empty).alias("emitted"),
        count(1)("duplicates"),
        count(-1)("gap_fill"),
        count(-2)("below_range"),
    )
    lost = gaps.groupBy(*keys).agg(F.sum(F.col("gap_to") - F.col("gap_from") + 1).alias("total_missing"))
    return rows.join(lost, keys, "left").withColumn("total_missing", F.coalesce("total_missing", F.lit(0)))


def missing_ticks(rows: DataFrame, every: int, keys: list[str]) -> DataFrame:
    """The report at each tick of a clock, of all arrivals until then: (tick, keys, total_missing, delta_missing, received, delta_received,
    emitted, delta_emitted, duplicates, gap_fill, below_range, eps), from a key's first tick to the last of all.

    rows: (keys, win, off, arrival, status, payload), and evicted: null, or the arrival at which the row's window went. A number is missing from the
    arrival of a greater one in its window until its own, or until the window goes. So an arrival that is greater than all before it in its
    window opens what it skips, as one count, and one that isn't closes one; sums of these over ticks, one row a tick,
    give the totals. Nothing is expanded, and only rows of one window meet, at most its width.
    """
    win = [*keys, "win"]
    came = F.col("status").isin(0, -1)
    rows = rows if "evicted" in rows.columns else rows.withColumn("evicted", F.lit(None).cast("long"))
    tick = lambda t: F.call_function("div", F.col(t), F.lit(every))  # noqa: E731  whole numbers: arrivals may be nanoseconds
    rows = rows.withColumn("tick", tick("arrival"))
    before = F.coalesce(F.max("off").over(Window.partitionBy(*win, "evicted").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)), F.col("win") - 1)
    change = F.when(F.col("off") > before, F.col("off") - before - 1).otherwise(-1)
    opened = rows.filter(came).select(*win, "evicted", "tick", change.alias("change"))
    gone = opened.filter("evicted IS NOT NULL").groupBy(*win, "evicted").agg((-F.sum("change")).alias("change"))
    moves = opened.select(*keys, "tick", "change").unionByName(gone.select(*keys, tick("evicted").alias("tick"), "change"))
    moved = moves.groupBy(*keys, "tick").agg(F.sum("change").alias("delta_missing"))
    n = {"delta_received": F.lit(True), "delta_emitted": (F.col("status") != 1) & (F.octet_length("payload") > 0), "_dup": F.col("status") == 1, "_fill": F.col("status") == -1, "_below": F.col("status") == -2}
    counted = rows.groupBy(*keys, "tick").agg(*[F.count_if(c).alias(k) for k, c in n.items()])
    last = rows.agg(F.max("tick").alias("_last"))  # one row
    grid = counted.groupBy(*keys).agg(F.min("tick").alias("_first")).join(F.broadcast(last), F.lit(True)).select(*keys, F.explode(F.sequence("_first", "_last")).alias("tick"))
    grid = grid.join(counted, [*keys, "tick"], "left").join(moved, [*keys, "tick"], "left").fillna(0, [*n, "delta_missing"])
    so_far = Window.partitionBy(*keys).orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    total = {"total_missing": "delta_missing", "received": "delta_received", "emitted": "delta_emitted", "duplicates": "_dup", "gap_fill": "_fill", "below_range": "_below"}
    out = grid.withColumns({t: F.sum(d).over(so_far) for t, d in total.items()}).withColumn("eps", F.floor(F.col("delta_received") / every))
    return out.select("tick", *keys, "total_missing", "delta_missing", "received", "delta_received", "emitted", "delta_emitted", "duplicates", "gap_fill", "below_range", "eps")


def deltas(reports: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Change of a value since the key's report before (the first report's is the value)."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return reports.withColumn(f"delta_{value}", F.col(value) - F.coalesce(before, F.lit(0)))


def frame_counts(frames: DataFrame) -> DataFrame:
    """(frames, messages) sent."""
    return frames.agg(F.count(F.lit(1)).alias("frames"), F.count_distinct("id").alias("messages"))


def reconcile(produced: DataFrame, consumed: DataFrame, hash: str = "hash") -> DataFrame:
    """(hash, state, duplicated_times): SENT, RECEIVED, DUPLICATED, UNKNOWN or UNKNOWN_DUPLICATED, by a full outer join of counts."""
    sent = produced.select(hash).distinct().withColumn("_sent", F.lit(True))
    got = consumed.groupBy(hash).agg(F.count(F.lit(1)).alias("_n"))
    both = sent.join(got, hash, "full_outer").withColumn("_n", F.coalesce("_n", F.lit(0)))
    known = F.when(F.col("_n") == 0, "SENT").when(F.col("_n") == 1, "RECEIVED").otherwise("DUPLICATED")
    state = F.when(F.col("_sent"), known).when(F.col("_n") == 1, "UNKNOWN").otherwise("UNKNOWN_DUPLICATED")
    return both.select(hash, state.alias("state"), F.greatest(F.col("_n") - 1, F.lit(0)).alias("duplicated_times"))


def state_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def loss_report(sent: DataFrame, received: DataFrame) -> DataFrame:
    """Latest statistics of both sides (time, total, overflow on the receiving one): loss, percent and where it arises. One row each side."""
    up = sent.agg(F.max_by("total", "time").alias("sent"))
    down = received.agg(F.max_by("total", "time").alias("received"), F.max_by("overflow", "time").alias("overflow"))
    loss = F.col("sent") - F.col("received")
    verdict = F.when((loss > 1000) & (F.col("overflow") == 0), "outside the host").when(loss > 1000, "receiver too slow").when(loss > 0, "minor loss").otherwise("no loss")
    # Both sides are global aggregates of exactly one row.
    both = up.withColumn("_one", F.lit(1)).join(down.withColumn("_one", F.lit(1)), "_one")
    return both.select("sent", "received", "overflow", loss.alias("loss"), F.round(loss / F.col("sent") * 100, 2).alias("loss_percent"), verdict.alias("verdict"))
