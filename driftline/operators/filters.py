"""Row filters and payload filters of the sending and the resending side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.config import DeliverFilter, Rule, java_regex, needed


def since(df: DataFrame, start, ts: str = "ts") -> DataFrame:
    """Rows not before start; reaches the scan as a pushed filter."""
    return df.filter(F.col(ts) >= F.lit(start).cast("timestamp"))


def between(df: DataFrame, start, end=None, ts: str = "ts") -> DataFrame:
    """Rows of a closed time range; without an end, up to now."""
    return df.filter(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp") if end is not None else F.current_timestamp()))


def found(text: Column, pattern: str) -> Column:
    """Whether the text has a match of the RE2 pattern. The pattern is only looked for where what it needs is there."""
    part, hit = needed(pattern), text.rlike(java_regex(pattern))
    return F.contains(text, F.lit(part)) & hit if part else hit


def allowed(value: Column, rules: list[Rule], default_allow: bool) -> Column:
    """Whether the first rule that matches allows the text; without rules everything is allowed, and null (an error) too."""
    if not rules:
        return F.lit(True)
    text = value.cast("string")
    out = reduce(lambda acc, r: (F.when if acc is None else acc.when)(found(text, r.pattern), F.lit(r.allow)), rules, None)
    return F.coalesce(out.otherwise(F.lit(default_allow)), F.lit(True))


def content_filter(df: DataFrame, rules: list[Rule], default_allow: bool = True, value: str = "value") -> DataFrame:
    """Denied payloads become empty; no row is dropped. Column filtered tells which."""
    ok = allowed(F.col(value), rules, default_allow)
    empty = F.lit("").cast(df.schema[value].dataType)
    return df.withColumn("filtered", ~ok).withColumn(value, F.when(F.col("filtered"), empty).otherwise(F.col(value)))


def deliver(df: DataFrame, config: str | DeliverFilter, off: str = "off") -> DataFrame:
    """Rows whose offset this pipe delivers; rows without a numeric offset pass."""
    f = config if isinstance(config, DeliverFilter) else DeliverFilter(config)
    n = F.col(off) - 1
    m = F.pmod(n, F.lit(f.k)) if f.floor_mod else n % f.k
    return df.filter(F.col(off).isNull() | (m + 1).isin(f.groups[0]))


def partition_range(df: DataFrame, start: int, stop: int, part: str = "part") -> DataFrame:
    """Partitions start to start + stop - 1, without -1; stop 0 takes all."""
    p = F.col(part)
    return df if stop == 0 else df.filter((p != -1) & (p >= start) & (p < start + stop))


def suppress_empty(df: DataFrame, value: str = "value") -> DataFrame:
    """Rows with payload; applied behind the detector, so that empty ones still fill gaps."""
    return df.filter(F.octet_length(value) > 0)


def split_standard(df: DataFrame, id_struct: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with a standard id (with topic, part, off), and the others, of which empty ones are dropped. Null ids are dropped."""
    rows = df.filter("id IS NOT NULL").withColumn("_id", id_struct)
    standard = rows.filter("_id IS NOT NULL").withColumns({c: F.col(f"_id.{c}") for c in ("topic", "part", "off")}).drop("_id")
    return standard, suppress_empty(rows.filter("_id IS NULL").drop("_id"))
