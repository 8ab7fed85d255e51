"""Sending and receiving: records to frames and back, as one plan each."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import compress, wire
from ..functions.config import DeliverFilter, Rule
from . import filters


@dataclass
class SendConfig:
    mtu: int = 1400
    start: str | None = None
    rules: list[Rule] = field(default_factory=list)
    default_allow: bool = True
    deliver: DeliverFilter | None = None
    topics: dict[str, str] = field(default_factory=dict)
    partition_start: int = 0
    gzip_over: int = 0
    key: bytes | None = None
    compat_part_count: bool = False


def prepare(events: DataFrame, cfg: SendConfig) -> DataFrame:
    """(id, type, value) of events (topic, part, off, ts, value), in the fixed order: time, content, delivery, renaming, gzip, encryption."""
    df = filters.since(events, cfg.start) if cfg.start else events
    df = filters.content_filter(df, cfg.rules, cfg.default_allow)
    df = filters.deliver(df, cfg.deliver) if cfg.deliver else df
    id = wire.make_id(wire.translate(F.col("topic"), cfg.topics), wire.shift_partition(F.col("part"), cfg.partition_start), F.col("off"))
    value, zipped = compress.compress_if_longer(F.col("value").cast("binary"), cfg.gzip_over)
    df = df.select(id.alias("id"), F.lit(wire.MESSAGE if cfg.key else wire.CLEARTEXT).alias("type"), value.alias("value"), zipped.alias("zipped"))
    df = df.withColumn("type", F.when(F.col("zipped"), wire.merge_flag(F.col("type"), wire.GZIP)).otherwise(F.col("type"))).drop("zipped")
    return df.withColumn("value", wire.encrypt(F.col("value"), F.lit(cfg.key), F.col("id"))) if cfg.key else df


def encode(events: DataFrame, cfg: SendConfig) -> DataFrame:
    """(id, type, part_no, n_parts, frame)."""
    return wire.fragment(prepare(events, cfg), cfg.mtu, cfg.compat_part_count)


@dataclass
class Received:
    """Three views of one plan: records (id, topic, part, value), errors (id, error) and control messages (id, type, value)."""

    records: DataFrame
    errors: DataFrame
    control: DataFrame


def open_messages(messages: DataFrame, key: bytes | None = None, limit: int = -1, topics: dict[str, str] | None = None, fallback: str = "unknown") -> Received:
    """Decrypt, decompress and route whole messages (id, type, value); a key column, if there is one, goes before the key."""
    own = F.col("key") if "key" in messages.columns else F.lit(key).cast("binary")
    df = messages.withColumn("route", wire.route(F.col("type")))
    clear = F.when(F.col("route") == "decrypt", wire.decrypt(F.col("value"), own)).otherwise(F.col("value"))
    df = df.withColumn("plain", clear)
    zipped = F.col("route").isin("clear", "decrypt") & wire.is_type(F.col("type"), wire.GZIP) & F.col("plain").isNotNull()
    df = df.withColumn("unzipped", F.when(zipped, compress.gunzip(F.when(zipped, F.col("plain")), limit))).withColumn("zipped", zipped)
    error = F.when((F.col("route") == "decrypt") & F.col("plain").isNull(), "cannot decrypt").when(F.col("zipped"), F.col("unzipped.error")).when(F.col("route") == "errors", F.col("value").cast("string"))
    df = df.withColumn("error", error).withColumn("value", F.when(F.col("zipped"), F.col("unzipped.value")).otherwise(F.col("plain")))
    topic, part = wire.fallback(F.col("id"), fallback)
    good = df.filter("route IN ('clear', 'decrypt') AND error IS NULL")
    records = good.select("id", wire.translate(topic, topics or {}).alias("topic"), part.alias("part"), "value")
    return Received(records, df.filter("error IS NOT NULL").select("id", "error"), df.filter("route IN ('keys', 'internal')").select("id", "type", "value"))


def decode(frames: DataFrame, key: bytes | None = None, max_parts: int = 4096, **options) -> Received:
    """Frames (frame, arrival) to records; bad frames join the errors, incomplete messages vanish."""
    parsed = wire.parse(frames, max_parts)
    whole = wire.reassemble(parsed).filter("complete").select("id", "type", "value")
    out = open_messages(whole, key, **options)
    bad = parsed.filter("error IS NOT NULL").select(F.lit(None).cast("string").alias("id"), "error")
    return Received(out.records, out.errors.unionByName(bad), out.control)


def keys_in_force(frames: DataFrame, ring: DataFrame, block: int = 1 << 20) -> DataFrame:
    """frames (arrival, ...) with the key of the latest epoch (epoch, key) at or before their arrival, null before the first.

    Rows and epochs are united and the last key carried on within blocks of arrivals. What a block begins with is carried
    over the blocks, one row for each, so no window spans the log; frames without an arrival have no key.
    """
    rows = frames.withColumns({"_at": F.col("arrival"), "_new": F.lit(None).cast("binary"), "_k": F.lit(1)})
    marks = ring.filter("epoch IS NOT NULL").select(F.col("epoch").alias("_at"), F.col("key").alias("_new"), F.lit(0).alias("_k"))
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_block", F.floor(F.col("_at") / block))
    inside = F.last("_new", True).over(Window.partitionBy("_block").orderBy("_at", "_k").rowsBetween(Window.unboundedPreceding, 0))
    # max_by passes over rows without a key.
    ends = both.filter("_block IS NOT NULL").groupBy("_block").agg(F.max_by("_new", F.when(F.col("_new").isNotNull(), F.col("_at"))).alias("_end"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    start = ends.select("_block", F.last("_end", True).over(before).alias("_start"))
    held = both.withColumn("_in", inside).filter("_k = 1")
    out = held.join(start, "_block", "left").withColumn("key", F.when(F.col("_at").isNotNull(), F.coalesce("_in", "_start")))
    return out.select(*frames.columns, "key")
