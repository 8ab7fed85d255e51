"""Which records a bundle asks for: range semi-joins of events with gaps.

all: offset in any gap; first: at or above the first gap; manual: a range of one
partition, end -1 open; time-range: a topic, and one partition or -1 for all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import filters
from .dedup import KEY


def gap_rows(bundle: DataFrame) -> DataFrame:
    """(topic, part, gap_from, gap_to) of a bundle's gaps ([from] or [from, to]); null gaps are none."""
    g = bundle.select(*KEY, F.explode("gaps").alias("g"))
    return g.select(*KEY, F.col("g")[0].alias("gap_from"), F.element_at("g", -1).alias("gap_to"))


def window_gaps(windows: DataFrame) -> DataFrame:
    """(topic, part, gap_from, gap_to) straight from windows (topic, part, window_min, gaps relative): no row holds all gaps of a partition, as a bundle's does."""
    g = windows.select(*KEY, "window_min", F.explode("gaps").alias("g"))
    return g.select(*KEY, (F.col("window_min") + F.col("g")[0]).alias("gap_from"), (F.col("window_min") + F.element_at("g", -1)).alias("gap_to"))


def in_gaps(events: DataFrame, gaps: DataFrame, bucket: int = 4096) -> DataFrame:
    """Events in any gap, each once.

    Both sides meet on (topic, part, offset bucket), gaps repeated for the buckets that they touch: a hash join whose
    candidates are a bucket's gaps, where a join on the partition alone would try every gap for every event.
    """
    # Gaps of one key are disjoint or get merged by left_semi; long gaps repeat once per bucket, no more than their rows.
    cells = gaps.withColumn("_b", F.explode(F.sequence(F.floor(F.col("gap_from") / bucket), F.floor(F.col("gap_to") / bucket))))
    cells = cells.select(*[F.col(c).alias(f"_{c}") for c in KEY], "_b", "gap_from", "gap_to")
    rows = events.withColumn("_eb", F.floor(F.col("off") / bucket))
    match = (rows["topic"] == cells["_topic"]) & (rows["part"] == cells["_part"]) & (rows["_eb"] == cells["_b"]) & rows["off"].between(cells["gap_from"], cells["gap_to"])
    return rows.join(cells, match, "left_semi").drop("_eb")


def from_first(events: DataFrame, gaps: DataFrame) -> DataFrame:
    """Events at or above the first gap of their partition."""
    first = gaps.groupBy(*KEY).agg(F.min("gap_from").alias("_first"))
    return events.join(first, KEY).filter("off >= _first").select(*events.columns)


def manual(events: DataFrame, topic: str, part: int, start: int, end: int = -1) -> DataFrame:
    own = events.filter((F.col("topic") == topic) & (F.col("part") == part) & (F.col("off") >= start))
    return own if end == -1 else own.filter(F.col("off") <= end)


def time_range(events: DataFrame, topic: str, start, end, part: int = -1) -> DataFrame:
    own = events.filter(F.col("topic") == topic)
    return filters.between(own if part == -1 else own.filter(F.col("part") == part), start, end)


def select(events: DataFrame, bundle: DataFrame, kind: str) -> DataFrame:
    """Events that a bundle of the kind asks for; other kinds take everything of the bundle's partitions."""
    if kind == "all":
        return in_gaps(events, gap_rows(bundle))
    if kind == "first":
        return from_first(events, gap_rows(bundle))
    return events.join(bundle.select(*KEY).distinct(), KEY, "left_semi")


def not_found(events: DataFrame, gaps: DataFrame) -> DataFrame:
    """(topic, part, off) asked for and not in the source."""
    from .gaps import expand

    return expand(gaps.select(*KEY, "gap_from", "gap_to")).distinct().join(events.select(*KEY, "off"), [*KEY, "off"], "left_anti")


def next_offsets(events: DataFrame) -> DataFrame:
    """(topic, part, next_off): the offset that the next record gets."""
    return events.groupBy(*KEY).agg((F.max("off") + 1).alias("next_off"))


def read_from(events: DataFrame, start: int = 0, part: int = -1) -> DataFrame:
    """Records from an offset on, of one partition or (-1) all; both filters reach the scan."""
    rows = events.filter(F.col("off") >= start)
    return rows if part == -1 else rows.filter(F.col("part") == part)


def lookup(events: DataFrame, topic: str, part: int, off: int) -> DataFrame:
    return events.filter((F.col("topic") == topic) & (F.col("part") == part) & (F.col("off") == off))
