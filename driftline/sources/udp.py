"""Datagrams on several workers, spooled to files that a stream reads.

Receivers are tasks of a Spark job that lasts as long as they listen: each has a socket of its own on the same port, and the kernel
deals datagrams to them. What a receiver has read goes to the spool folder as Parquet files, each complete when it appears. A stream
over the spool is an ordinary file stream: a batch that runs again reads the same files, so what has been received is never
lost or doubled downstream. A receiver that dies loses what it has read since its last file; the gap detectors find that.
"""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

FRAMES = "frame binary, arrival long, receiver int"
#: A receiver's number is the low bits of its arrivals, so that all arrivals differ.
_LOW = 10


def _listen(host: str, port: int, spool: str, roll_seconds: float, roll_rows: int, buffer: int, lasting: float):
    def run(batches):
        import socket

        from pyarrow import fs

        (k,) = [i for b in batches for i in b.column("id").to_pylist()]
        store, root = fs.FileSystem.from_uri(spool) if "://" in spool or spool.startswith("file:") else (fs.LocalFileSystem(), spool)
        rows, count, last, begun = [], 0, 0, time.monotonic()

        def roll():
            nonlocal rows, count
            if rows:
                name = f"{time.time_ns():020d}-{k}-{uuid.uuid4().hex}.parquet"
                table = pa.table({"frame": pa.array([r[0] for r in rows], pa.binary()), "arrival": pa.array([r[1] for r in rows], pa.int64()), "receiver": pa.array([k] * len(rows), pa.int32())})
                pq.write_table(table, f"{root}/_{name}", filesystem=store)  # names that begin so are not read
                store.move(f"{root}/_{name}", f"{root}/{name}")
                count, rows = count + len(rows), []

        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            s.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEPORT, 1)
            s.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, buffer)
            s.bind((host, port))
            store.create_dir(f"{root}/_ready", recursive=True)
            with store.open_output_stream(f"{root}/_ready/{k}") as f:
                f.write(b"")
            end = time.monotonic() + roll_seconds
            while True:
                s.settimeout(max(0.001, end - time.monotonic()))
                try:
                    frame = s.recv(65_536)
                    last = max(last + 1, time.time_ns() >> _LOW)
                    rows.append((frame, last << _LOW | k))
                except TimeoutError:
                    pass
                if time.monotonic() >= end or len(rows) >= roll_rows:
                    roll()
                    end = time.monotonic() + roll_seconds
                    if store.get_file_info(f"{root}/_stop").type != fs.FileType.NotFound or lasting and time.monotonic() - begun > lasting:
                        break
        roll()
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([count], pa.int64())], ["receiver", "datagrams"])

    return run


@dataclass
class Receivers:
    spool: str
    thread: threading.Thread
    counts: dict[int, int] = field(default_factory=dict)
    failed: list[Exception] = field(default_factory=list)

    def stop(self, timeout: float = 60) -> dict[int, int]:
        """Has the receivers write what they hold and end; datagrams of each receiver."""
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.spool) if "://" in self.spool or self.spool.startswith("file:") else (fs.LocalFileSystem(), self.spool)
        with store.open_output_stream(f"{root}/_stop") as f:
            f.write(b"")
        self.thread.join(timeout)
        if self.failed:
            raise self.failed[0]
        return self.counts


def receive(spark: SparkSession, port: int, spool: str, host: str = "0.0.0.0", receivers: int = 4, roll_seconds: float = 1.0, roll_rows: int = 10_000, buffer: int = 1 << 24, lasting: float = 0) -> Receivers:
    """Starts receivers as the tasks of a barrier job, so all of them run or none; each takes a core until it ends.

    spool is a new folder that all executors share (a path or a URI that pyarrow knows). lasting ends the receivers by themselves after so many seconds.
    """
    if not 1 <= receivers < 1 << _LOW:
        raise ValueError(f"between 1 and {(1 << _LOW) - 1} receivers")
    out = Receivers(spool.rstrip("/"), None)

    def job():
        try:
            rows = spark.range(0, receivers, 1, receivers).mapInArrow(_listen(host, port, out.spool, roll_seconds, roll_rows, buffer, lasting), "receiver long, datagrams long", barrier=True)
            out.counts.update({r.receiver: r.datagrams for r in rows.collect()})
        except Exception as e:
            out.failed.append(e)

    out.thread = threading.Thread(target=job, daemon=True)
    out.thread.start()
    return out


def frames(spark: SparkSession, spool: str, files_per_batch: int | None = None) -> DataFrame:
    """The stream (frame, arrival, receiver) of a spool."""
    reader = spark.readStream.schema(FRAMES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(spool)
