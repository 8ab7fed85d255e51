"""Sinks: Kafka rows, console, counting null sink, bundle files, status topics, statistics files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.wire import make_id


def kafka_rows(records: DataFrame) -> DataFrame:
    """(topic, partition, key, value) with an explicit partition and the id as key, as Spark's Kafka sink takes them."""
    return records.select("topic", F.col("part").alias("partition"), F.col("id").cast("binary").alias("key"), "value")


def write_kafka(records: DataFrame, brokers: str, tls: dict[str, str] | None = None) -> None:
    kafka_rows(records).write.format("kafka").options(**writer_options(brokers, tls)).save()


def writer_options(brokers: str, tls: dict[str, str] | None = None) -> dict[str, str]:
    return {"kafka.bootstrap.servers": brokers, "kafka.acks": "1"} | (tls or {})


def stream_kafka(records: DataFrame, brokers: str, checkpoint: str, tls: dict[str, str] | None = None, query: str = "to_kafka"):
    """A writer (not started) of a stream of records; the checkpoint keeps how far it has come."""
    return kafka_rows(records).writeStream.queryName(query).format("kafka").options(**writer_options(brokers, tls)).option("checkpointLocation", checkpoint)


def clean_rows(clean: DataFrame) -> DataFrame:
    """(id, value, ts) of delivered rows."""
    return clean.select(make_id(F.col("topic"), F.col("part"), F.col("off")).alias("id"), F.col("payload").alias("value"), "ts")


def gap_rows(windows: DataFrame) -> DataFrame:
    """(key, value) of the gap topic, from (topic, part, window_min, window_max, gaps relative)."""
    from ..functions.gap_bitmap import gap_payload

    return windows.select(F.concat_ws(":", "topic", "part", "window_min").alias("key"), gap_payload(F.col("window_min"), F.col("window_max"), F.col("gaps")).alias("value"))


def status_rows(errors: DataFrame, topic: str, now=None) -> DataFrame:
    """Rows for the internal topic: 'timestamp id text', key the id or a new UUID; an empty topic disables it."""
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    text = F.concat_ws(" ", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX"), F.coalesce("id", F.lit("")), F.col("error"))
    out = errors.select(F.lit(topic).alias("topic"), F.coalesce("id", F.expr("uuid()")).cast("binary").alias("key"), text.cast("binary").alias("value"))
    return out if topic else out.limit(0)


def console(records: DataFrame, rows: int = 20) -> None:
    records.select(F.col("value").cast("string")).show(rows, truncate=False)


def count_only(records: DataFrame) -> int:
    """Runs the plan into nothing and returns how many rows passed."""
    seen = Observation(f"passed-{uuid.uuid4().hex}")
    records.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return seen.get["n"]


def bundle_json(bundle: DataFrame, kind: str = "all") -> DataFrame:
    """One row (json): the bundle document, empty gaps as []; results in order of topic and partition."""
    row = F.struct("topic", F.col("part").alias("partition"), "window_min", "window_max", "gaps")
    return bundle.agg(F.to_json(F.struct(F.lit(kind).alias("type"), F.array_sort(F.collect_list(row)).alias("results"))).alias("json"))


def write_bundle(bundle: DataFrame, path: str, kind: str = "all") -> None:
    """A bundle has a row per partition: small enough for one file, written by the driver."""
    text = bundle_json(bundle, kind).first()["json"]
    with open(path, "w", encoding="utf-8") as f:
        json.dump(json.loads(text), f, indent=1)


def write_stats(ledger: DataFrame, path: str) -> None:
    ledger.write.mode("overwrite").option("header", True).csv(path)


def send(frames: DataFrame, deliver, retries: int = 30, wait: float = 0.1, query: str = "send", size: int = 1000):
    """Streaming sender: deliver(rows) for up to size rows of a micro-batch's partition, tried again on OSError; a batch that fails is sent again, ids make that harmless."""

    def part(rows):
        import time
        from itertools import islice

        while some := [*islice(rows, size)]:
            for attempt in range(retries):
                try:
                    deliver(some)
                    break
                except OSError:
                    if attempt == retries - 1:
                        raise
                    time.sleep(wait)

    return frames.writeStream.queryName(query).foreachBatch(lambda batch, _: batch.foreachPartition(part))
