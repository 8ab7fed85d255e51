"""Gaps, intervals and bundles. Bounds are absolute and inclusive unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import last_before
from .dedup import KEY, WINDOW, statuses

WIN = [*KEY, "win"]


def window_of(off: Column, width: int = WINDOW) -> Column:
    return off - off % width


def received(log: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct (topic, part, win, off) that detectors have marked."""
    return statuses(log, width).filter("status <> -2").select(*WIN, "off").distinct()


def ranges(marked: DataFrame) -> DataFrame:
    """(topic, part, win, gap_from, gap_to): head and inner gaps of each window; what follows its last number isn't reported."""
    before = F.lag("off").over(Window.partitionBy(*WIN).orderBy("off"))
    rows = marked.withColumn("gap_from", F.coalesce(before + 1, F.col("win"))).withColumn("gap_to", F.col("off") - 1)
    return rows.filter("gap_from <= gap_to").select(*WIN, "gap_from", "gap_to")


def complete_ranges(marked: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(topic, part, gap_from, gap_to) up to the greatest number, with tails of windows and skipped windows.

    Gaps inside a window come from a window over it, gaps between windows from one row per window, so no key is one sort.
    ends (topic, part, end) can give a greater last number.
    """
    before = F.lag("off").over(Window.partitionBy(*WIN).orderBy("off"))
    inner = marked.withColumn("gap_from", before + 1).withColumn("gap_to", F.col("off") - 1).filter("gap_from <= gap_to").select(*KEY, "gap_from", "gap_to")
    edge = marked.groupBy(*WIN).agg(F.min("off").alias("lo"), F.max("off").alias("hi"))
    last = F.lag("hi").over(Window.partitionBy(*KEY).orderBy("win"))
    between = edge.withColumn("gap_from", F.coalesce(last + 1, F.col("win"))).withColumn("gap_to", F.col("lo") - 1).filter("gap_from <= gap_to").select(*KEY, "gap_from", "gap_to")
    out = inner.unionByName(between)
    if ends is not None:
        tail = edge.groupBy(*KEY).agg((F.max("hi") + 1).alias("gap_from")).join(ends, KEY).filter("gap_from <= end")
        out = out.unionByName(tail.select(*KEY, "gap_from", F.col("end").alias("gap_to")))
    return out


def islands(numbers: DataFrame, keys: list[str], n: str = "off", block: int = 1 << 20) -> DataFrame:
    """(keys, run_from, run_to): runs of consecutive distinct numbers.

    Runs are found inside blocks of numbers; only those that reach a block's edge, two a block at most, meet once more by key.
    """
    rows = numbers.select(*keys, F.col(n).alias("_n")).distinct().withColumn("_block", F.floor(F.col("_n") / block))
    rank = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("_n"))
    runs = rows.withColumn("_run", F.col("_n") - rank).groupBy(*keys, "_block", "_run").agg(F.min("_n").alias("run_from"), F.max("_n").alias("run_to"))
    edge = (F.col("run_from") == F.col("_block") * block) | (F.col("run_to") == (F.col("_block") + 1) * block - 1)
    order = Window.partitionBy(*keys).orderBy("run_from")
    new = F.when(F.lag("run_to").over(order) + 1 == F.col("run_from"), 0).otherwise(1)
    joined = runs.filter(edge).withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.groupBy(*keys, "_run").agg(F.min("run_from").alias("run_from"), F.max("run_to").alias("run_to"))
    return runs.filter(~edge).select(*keys, "run_from", "run_to").unionByName(joined.drop("_run"))


def expand(gaps: DataFrame) -> DataFrame:
    """One row per missing number."""
    return gaps.withColumn("off", F.explode(F.sequence("gap_from", "gap_to"))).drop("gap_from", "gap_to")


def missing(gaps: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return gaps.groupBy(*keys).agg(F.sum(F.col("gap_to") - F.col("gap_from") + 1).alias("missing"))


def compact(gaps: DataFrame, relative: bool = False) -> DataFrame:
    """(topic, part, win, gaps): ascending [from] or [from, to], absolute or from the window's start."""
    base = F.col("win") if relative else F.lit(0)
    one = F.when(F.col("gap_from") == F.col("gap_to"), F.array(F.col("gap_from") - base)).otherwise(F.array(F.col("gap_from") - base, F.col("gap_to") - base))
    return gaps.groupBy(*WIN).agg(F.array_sort(F.collect_list(one)).alias("gaps"))


def absolute(gaps: Column, window_min: Column) -> Column:
    return F.transform(gaps, lambda g: F.transform(g, lambda x: x + window_min))


def full_windows(marked: DataFrame, width: int = WINDOW) -> DataFrame:
    return marked.groupBy(*WIN).agg((F.count_distinct("off") == width).alias("full"))


def interval_tracker(numbers: DataFrame, keys: list[str], n: str = "off", block: int = 1 << 20) -> DataFrame:
    """Final intervals of the legacy tracker: what is missing of 0 to the greatest number, with gap_from and gap_to.

    The number before comes from a window over a block of numbers, for a block's least from one row a block.
    """
    rows = numbers.select(*keys, F.col(n).alias("_n")).distinct().withColumn("_block", F.floor(F.col("_n") / block))
    inner = rows.withColumn("gap_from", F.lag("_n").over(Window.partitionBy(*keys, "_block").orderBy("_n")) + 1)
    edge = rows.groupBy(*keys, "_block").agg(F.min("_n").alias("_n"), F.max("_n").alias("_last"))
    edge = edge.withColumn("gap_from", F.coalesce(F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block")) + 1, F.lit(0)))
    every = inner.select(*keys, "gap_from", "_n").unionByName(edge.select(*keys, "gap_from", "_n"))
    return every.withColumn("gap_to", F.col("_n") - 1).filter("gap_from <= gap_to").select(*keys, "gap_from", "gap_to")


def tracker_history(log: DataFrame, keys: list[str], block: int = 1 << 20) -> DataFrame:
    """log (keys, off, arrival, ...) with duplicate, and gap_from and gap_to of the interval that an arrival opens, else null.

    The tracker expects 0 at first, then one more than the greatest number so far: a greater one opens the interval before it. A number
    below is in an interval unless it has come before. What came before a block of arrivals is one row a block.
    """
    rows = log.withColumn("_b", F.floor(F.col("arrival") / block))
    inside = F.max("off").over(Window.partitionBy(*keys, "_b").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    tops = rows.groupBy(*keys, "_b").agg(F.max("off").alias("_top"))
    before = F.max("_top").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_in", inside).join(tops.select(*keys, "_b", before.alias("_before")), [*keys, "_b"])
    hi = F.coalesce(F.greatest("_in", "_before"), F.lit(-1))
    again = F.row_number().over(Window.partitionBy(*keys, "off").orderBy("arrival")) > 1
    opens = lambda c: F.when(F.col("off") > F.col("_hi") + 1, c)
    rows = rows.withColumns({"_hi": hi, "duplicate": again})
    return rows.withColumns({"gap_from": opens(F.col("_hi") + 1), "gap_to": opens(F.col("off") - 1)}).drop("_b", "_in", "_before", "_hi")


def tracker_found(log: DataFrame, keys: list[str], block: int = 1 << 20) -> DataFrame:
    """interval_tracker with found: the arrival that opened the interval of which it is left.

    The opened intervals are disjoint, so what is left of one lies after its first number and before the next one's: the last opening at or below gap_from.
    """
    opened = tracker_history(log, keys, block).filter("gap_from IS NOT NULL").select(*keys, F.col("gap_from").alias("at"), F.col("arrival").alias("found"))
    return last_before(interval_tracker(log, keys, block=block), "gap_from", opened, keys, "found", block)


def first_old_gaps(gaps: DataFrame, now, keys: list[str], seconds: int = 30, compat: bool = False) -> DataFrame:
    """(keys, first_gap, total): least gap found more than seconds ago, and the missing numbers of all gaps (compat: without the +1)."""
    old = F.col("found") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(seconds)} SECONDS")
    size = F.col("gap_to") - F.col("gap_from") + (0 if compat else 1)
    return gaps.groupBy(*keys).agg(F.min(F.when(old, F.col("gap_from"))).alias("first_gap"), F.sum(size).alias("total"))


def emissions(marked: DataFrame, every: int, last_tick: DataFrame) -> DataFrame:
    """(tick, topic, part, win, gaps): what detectors report when a clock ticks after every `every` arrivals' time; see reports()."""
    return each_tick(reports(marked, every, last_tick))


def each_tick(reports: DataFrame) -> DataFrame:
    """Reports (since, until, ...) as one row for each tick from since to until: a window with gaps stays in all ticks to come, so these grow with the square of a log."""
    rest = [c for c in reports.columns if c not in ("since", "until")]
    return reports.select(F.explode(F.sequence("since", "until")).alias("tick"), *rest)


def reports(marked: DataFrame, every: int, last_tick: DataFrame) -> DataFrame:
    """(topic, part, win, gaps, since, until): what detectors report at each tick from since to until, when a clock ticks after every `every` arrivals' time.

    What is made of a report, its text for instance, is best made here, before it is repeated for each tick. marked: (topic, part, win, off, arrival, died) of the numbers that windows saw first, died null where the window stays;
    last_tick: one row (last). A window with gaps is reported at each tick, one without when it had some at the tick before it changed,
    and once at first. A window's numbers, at most its width, meet in one row; between the ticks at which it changes, its state stays.
    """
    tick = lambda t: F.call_function("div", t, F.lit(every))  # noqa: E731  whole numbers: arrivals may be nanoseconds
    each = marked.groupBy(*WIN, "died").agg(F.array_sort(F.collect_list(F.struct(tick(F.col("arrival")).alias("t"), "off"))).alias("seen"))

    def ranges_at(t):
        offs = F.array_sort(F.transform(F.filter("seen", lambda x: x["t"] <= t), lambda x: x["off"]))
        before = F.concat(F.array(F.col("win") - 1), F.slice(offs, 1, F.size(offs) - 1))
        return F.filter(F.zip_with(before, offs, lambda p, o: F.array(p + 1, o - 1)), lambda g: g[0] <= g[1])

    states = F.transform(F.array_distinct(F.transform("seen", lambda x: x["t"])), lambda t: F.struct(t.alias("t"), ranges_at(t).alias("gaps")))
    each = each.join(F.broadcast(last_tick.select("last")), F.lit(True)).select(*WIN, F.least(F.col("last"), tick(F.col("died")) - 1).alias("_end"), states.alias("_s"))
    # A state holds until the tick before the next; so many states as ticks at which a number came.
    until = lambda k: F.least(F.coalesce(F.get("_s", k + 1)["t"] - 1, F.col("_end")), F.col("_end"))
    was = lambda k: F.when(k == 0, True).otherwise(F.size(F.get("_s", k - 1)["gaps"]) > 0)
    spans = F.transform("_s", lambda s, k: F.struct(s["t"].alias("t"), s["gaps"].alias("gaps"), until(k).alias("until"), was(k).alias("was")))
    rows = each.select(*WIN, F.explode(spans).alias("_x")).select(*WIN, "_x.*").filter(F.col("t") <= F.col("until"))
    return rows.filter((F.size("gaps") > 0) | F.col("was")).select(*WIN, "gaps", F.col("t").alias("since"), F.when(F.size("gaps") > 0, F.col("until")).otherwise(F.col("t")).alias("until"))


def memory_estimate(marked: DataFrame) -> DataFrame:
    """(topic, part, windows, bytes): 16 bytes a window and 16 a received number."""
    return marked.groupBy(*KEY).agg(F.count_distinct("win").alias("windows"), F.count(F.lit(1)).alias("n")).select(*KEY, "windows", (16 * F.col("windows") + 16 * F.col("n")).alias("bytes"))


def introspection(marked: DataFrame, gaps: DataFrame) -> DataFrame:
    """(topic, part, windows, bytes, missing) of every detector."""
    return memory_estimate(marked).join(missing(gaps), KEY, "left").withColumn("missing", F.coalesce("missing", F.lit(0)))


def latest_windows(gap_topic: DataFrame) -> DataFrame:
    """The last record of each (topic, part, window_min) by read_seq, as a compacted topic would keep."""
    rest = [c for c in gap_topic.columns if c not in (*KEY, "window_min")]
    best = gap_topic.groupBy(*KEY, "window_min").agg(F.max_by(F.struct(*rest), "read_seq").alias("_r"))
    return best.select(*KEY, "window_min", *[F.col(f"_r.{c}").alias(c) for c in rest])


def bundle(windows: DataFrame, limit: str = "all") -> DataFrame:
    """(topic, part, window_min, window_max, gaps) of windows (topic, part, window_min, window_max, gaps relative): window_min is 0, gaps are absolute and ascending; limit 'first' keeps the least."""
    rows = windows.withColumn("gaps", absolute(F.col("gaps"), F.col("window_min")))
    out = rows.groupBy(*KEY).agg(F.max_by("window_max", "window_min").alias("window_max"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("window_min", "gaps"))), lambda w: w["gaps"])).alias("gaps"))
    gaps = F.slice(F.array_sort("gaps"), 1, 1) if limit == "first" else F.col("gaps")
    return out.select(*KEY, F.lit(0).cast("long").alias("window_min"), "window_max", gaps.alias("gaps"))


def report(windows: DataFrame, preview: int = 5) -> DataFrame:
    """Detail lines of windows with something missing, and a total line per topic (part null), in report order."""
    size = F.aggregate("gaps", F.lit(0).cast("long"), lambda acc, g: acc + F.element_at(g, -1) - g[0] + 1)
    rows = windows.withColumn("missing", size)
    from ..functions.wire import format_range

    first = F.transform(F.slice("gaps", 1, preview), lambda g: format_range(g[0] + F.col("window_min"), F.element_at(g, -1) + F.col("window_min")))
    text = F.concat(F.array_join(first, ", "), F.when(F.size("gaps") > preview, ", ...").otherwise(""))
    detail = rows.filter("missing > 0").select(*KEY, "window_min", "window_max", "missing", text.alias("first"))
    total = rows.groupBy("topic").agg(F.sum("missing").alias("missing")).select("topic", F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("window_min"), F.lit(None).cast("long").alias("window_max"), "missing", F.lit(None).cast("string").alias("first"))
    return detail.unionByName(total).orderBy("topic", F.col("part").asc_nulls_last(), "window_min")
