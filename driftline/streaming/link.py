"""Both ends of the link as streaming queries: records to frames, and frames to records with keys that change on the way.

A key travels as a message of its own: an envelope that only the receiver's private
keys open. The receiver keeps every key it has opened as a row (epoch, key) of a ring,
written per micro-batch, so a batch that runs again writes the same rows and a restart finds all keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import key_exchange, wire
from ..operators import transport
from . import stateful

RING = "epoch long, key binary"


def key_message(key: bytes, public: tuple[int, int], id: str) -> tuple[str, int, bytes]:
    """(id, type, value) that tells the receiver a new key."""
    return id, wire.KEY_EXCHANGE, key_exchange.seal(key, *public)


def send_stream(events: DataFrame, cfg: transport.SendConfig, deliver: Callable[[DataFrame, int], None], public: tuple[int, int] | None = None, query: str = "upstream"):
    """A writer (not started) that gives deliver the frames (id, type, part_no, n_parts, frame) of each micro-batch of events.

    With a key and the receiver's public key (n, e) the first batch of a run begins with the envelope of the key; deliver
    gets it as a batch of its own, before the records. Frames of a batch that runs again are the same bytes.
    """
    told: list[bytes] = []

    def batch(rows: DataFrame, number: int) -> None:
        if cfg.key and public and cfg.key not in told:
            keys = rows.sparkSession.createDataFrame([key_message(cfg.key, public, f"key_0_{number}")], "id string, type int, value binary")
            deliver(wire.fragment(keys, cfg.mtu, cfg.compat_part_count), number)
            told.append(cfg.key)
        deliver(transport.encode(rows, cfg), number)

    return events.writeStream.queryName(query).foreachBatch(batch)


def read_ring(spark: SparkSession, path: str) -> DataFrame:
    """(epoch, key) of all keys that have been received; none before the first."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], RING)
    return spark.read.schema(RING).option("recursiveFileLookup", True).parquet(path)


def _unsealed(private: list[tuple[int, int]]):
    """mapInPandas: (epoch, key) of the envelopes (arrival, value) that one of the private keys opens."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keys = [key_exchange.unseal(bytes(v), private) for v in f["value"]]
            yield pd.DataFrame({"epoch": f["arrival"], "key": keys}).dropna()

    return run


def opened(messages: DataFrame, number: int, ring: str, private: list[tuple[int, int]], first_key: bytes | None = None, **options) -> transport.Received:
    """One micro-batch of whole messages (id, type, value, arrival) to records; its envelopes join the ring first.

    A message is opened with the key of the latest envelope at or before its arrival, before the first with first_key.
    Envelopes are opened where they lie: a flood of false ones stays off the driver and out of the ring. Envelopes without value or arrival tell no key.
    """
    sealed = messages.filter(F.col("type") == wire.KEY_EXCHANGE).filter("value IS NOT NULL AND arrival IS NOT NULL")
    if not sealed.isEmpty():
        sealed.select("arrival", "value").mapInPandas(_unsealed(private), RING).write.mode("overwrite").parquet(f"{ring}/batch={number}")
    rows = transport.keys_in_force(messages, read_ring(messages.sparkSession, ring)).withColumn("key", F.coalesce("key", F.lit(first_key).cast("binary")))
    return transport.open_messages(rows, **options)


def receive_stream(frames: DataFrame, ring: str, private: list[tuple[int, int]], sink: Callable[[transport.Received, int], None], first_key: bytes | None = None, ttl_seconds: int = 30, query: str = "downstream", **options):
    """A writer (not started) of a streaming frame log (frame, arrival): reassembly in keyed state, then each micro-batch's
    messages opened with the keys in force; sink gets records, errors and control messages with the batch's number."""
    whole = stateful.reassemble_stream(frames, ttl_seconds)

    def batch(messages: DataFrame, number: int) -> None:
        messages = messages.persist()
        try:
            sink(opened(messages, number, ring, private, first_key, **options), number)
        finally:
            messages.unpersist()

    return whole.writeStream.queryName(query).foreachBatch(batch)
