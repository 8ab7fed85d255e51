"""Sources: Kafka (where its connector is on the class path), files, generators and byte streams."""

from __future__ import annotations

import json
from datetime import datetime
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import slices
from ..functions.config import split_topics
from ..functions.wire import OVERHEAD, make_id

BUNDLE = "type string, results array<struct<topic:string,partition:int,window_min:bigint,window_max:bigint,gaps:array<array<bigint>>>>"


def tls_options(ca: str, cert: str | None = None, key: str | None = None, key_password: str | None = None) -> dict[str, str]:
    """Options of an encrypted connection with PEM files; cert and key (one without the other is an error) show who we are.

    Kafka's PEM store takes certificate and private key from their text, an encrypted key with its password.
    """
    if (cert is None) != (key is None):
        raise ValueError("a certificate needs its key, and a key its certificate")
    out = {"kafka.security.protocol": "SSL", "kafka.ssl.truststore.type": "PEM", "kafka.ssl.truststore.location": ca}
    if cert:
        text = Path(key).read_text()
        if "ENCRYPTED" in text and not key_password:
            raise ValueError(f"{key} is encrypted and needs a password")
        out |= {"kafka.ssl.keystore.type": "PEM", "kafka.ssl.keystore.certificate.chain": Path(cert).read_text(), "kafka.ssl.keystore.key": text}
        if key_password:
            out["kafka.ssl.key.password"] = key_password
    return out


def kafka_options(brokers: str, topics: str, starting="earliest", ending: str | None = None, partition: int = -1, per_trigger: int | None = None, start_offset: int | None = None, group: str | None = None, since: str | None = None, tls: dict[str, str] | None = None) -> dict[str, str]:
    """Options of Spark's Kafka source: several topics, one partition, an offset or RFC 3339 time to start at, a rate limit, a group id, TLS.

    Spark keeps the offsets of a query in its checkpoint; the group id is for the broker's access rules and monitoring.
    """
    names = split_topics(topics)
    out = {"kafka.bootstrap.servers": brokers}
    if partition >= 0:
        out["assign"] = json.dumps({n: [partition] for n in names})
        if start_offset is not None:
            starting = json.dumps({n: {str(partition): start_offset} for n in names})
    else:
        out["subscribe"] = ",".join(names)
    if since is not None:
        at = datetime.fromisoformat(since)
        if at.tzinfo is None:
            raise ValueError(f"{since} has no offset from UTC")
        out["startingTimestamp"] = str(round(at.timestamp() * 1000))
        out["startingOffsetsByTimestampStrategy"] = "latest"  # nothing that late: wait for what comes
    else:
        out["startingOffsets"] = starting
    if group:
        out["kafka.group.id"] = group
    out |= tls or {}
    if ending is not None:
        out["endingOffsets"] = ending
    if per_trigger:
        out["maxOffsetsPerTrigger"] = str(per_trigger)
    return out


def as_events(raw: DataFrame) -> DataFrame:
    """(topic, part, off, ts, value, id) of Kafka source rows."""
    rows = raw.select("topic", F.col("partition").alias("part"), F.col("offset").alias("off"), F.col("timestamp").alias("ts"), "value")
    return rows.withColumn("id", make_id(F.col("topic"), F.col("part"), F.col("off")))


def kafka(spark: SparkSession, streaming: bool = True, **options) -> DataFrame:
    """Group consumer (streaming) or read to the end (batch); needs the public spark-sql-kafka connector."""
    reader = spark.readStream if streaming else spark.read
    opts = kafka_options(**options)
    if not streaming:
        opts.setdefault("endingOffsets", "latest")
    return as_events(reader.format("kafka").options(**opts).load())


def tail(spark: SparkSession, brokers: str, topics: str) -> DataFrame:
    return kafka(spark, brokers=brokers, topics=topics, starting="latest")


def fan_in(frames: list[DataFrame]) -> DataFrame:
    """Bag union of inputs; none is an error."""
    if not frames:
        raise ValueError("no inputs")
    return reduce(DataFrame.unionByName, frames)


def counter(spark: SparkSession, n: int) -> DataFrame:
    """(id, value) of n generated messages."""
    return spark.range(n).select(F.concat(F.lit("random_"), F.col("id")).alias("id"), F.concat(F.lit("Random message "), F.col("id")).cast("binary").alias("value"))


def counter_stream(spark: SparkSession, per_second: int) -> DataFrame:
    rows = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return rows.select(F.concat(F.lit("random_"), F.col("value")).alias("id"), F.concat(F.lit("Random message "), F.col("value")).cast("binary").alias("value"))


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """(type, topic, part, window_min, window_max, gaps) of a JSON bundle; null gaps are empty."""
    rows = spark.read.schema(BUNDLE).option("multiLine", True).json(path).select("type", F.explode("results").alias("r"))
    return rows.select("type", F.col("r.topic").alias("topic"), F.col("r.partition").alias("part"), F.col("r.window_min").alias("window_min"), F.col("r.window_max").alias("window_max"), F.coalesce(F.col("r.gaps"), F.array().cast("array<array<bigint>>")).alias("gaps"))


def read_properties(path: str) -> dict[str, str]:
    lines = (line.strip() for line in Path(path).read_text().splitlines())
    return {k.strip(): v.strip() for k, _, v in (line.partition("=") for line in lines if line and not line.startswith("#"))}


def split_stream(data: bytes, max_id: int = 1024):
    """Frames of a self-delimiting byte stream; ends at a frame that is cut off, fails on an impossible id length."""
    at = 0
    while at + 7 <= len(data):
        size = int.from_bytes(data[at + 5 : at + 7], "big")
        if size > max_id:
            raise ValueError("bad id length")
        head = at + 7 + size + 4
        if head + 2 > len(data):
            return
        end = at + OVERHEAD + size + int.from_bytes(data[head : head + 2], "big")
        if end > len(data):
            return
        yield data[at:end]
        at = end


def stream_frames(df: DataFrame, column: str = "stream") -> DataFrame:
    """df's rows times the frames of a binary column, with seq: for streams that are small enough for a row; byte_streams.split_chunks takes those that aren't."""
    rest = [c for c in df.columns if c != column]
    schema = T.StructType([*[f for f in df.schema if f.name != column], T.StructField("frame", T.BinaryType()), T.StructField("seq", T.IntegerType())])

    def run(batches):
        for batch in batches:
            for at, n in slices(batch.column(column)):
                some = batch.slice(at, n)
                found = [(i, frame, k) for i, data in enumerate(some.column(column).to_pylist()) for k, frame in enumerate(split_stream(data or b""))]
                own = some.select(rest).take(pa.array([f[0] for f in found], pa.int64())).columns if rest else []
                yield pa.RecordBatch.from_arrays([*own, pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.int32())], [*rest, "frame", "seq"])

    return df.mapInArrow(run, schema)


def register_udp(spark: SparkSession) -> str:
    """Registers the streaming source 'udp_frames' (options host, port, seconds) and returns its name."""
    from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self, options):
            self.address = options.get("host", "127.0.0.1"), int(options.get("port", "1234"))
            self.seconds = float(options.get("seconds", "0.2"))
            self.socket = None

        def initialOffset(self):
            return {"n": 0}

        def read(self, start):
            import socket
            import time

            if self.socket is None:
                self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
                self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEPORT, 1)
                self.socket.bind(self.address)
            rows, end = [], time.time() + self.seconds
            while (left := end - time.time()) > 0:
                self.socket.settimeout(left)
                try:
                    rows.append((self.socket.recv(65536), start["n"] + len(rows)))
                except TimeoutError:
                    break
            return iter(rows), {"n": start["n"] + len(rows)}

        def readBetweenOffsets(self, start, end):
            return iter(())  # datagrams can't be read again: what is lost is found as a gap

    class UdpFrames(DataSource):
        @classmethod
        def name(cls):
            return "udp_frames"

        def schema(self):
            return T.StructType([T.StructField("frame", T.BinaryType()), T.StructField("arrival", T.LongType())])

        def simpleStreamReader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(UdpFrames)
    return "udp_frames"
