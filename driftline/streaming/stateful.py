"""Streaming twins of the order-dependent operators, on Spark's keyed state."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.wire import parse
from ..operators.dedup import FOLD, KEY, Detector, standard


def dedup_stream(log: DataFrame, width: int = 100, max_windows: int = 5, emit_seconds: int | None = None) -> DataFrame:
    """Rows and gap records (as FOLD) of a streaming log (topic, part, off, arrival).

    kind 'row': an arrival with its status; 'gap': a gap of an evicted window, or with emit_seconds of a periodic report,
    where a window whose gaps have closed is reported once without bounds. A micro-batch's rows of a key are sorted by arrival.
    Rows without topic, part, offset or arrival come back with null status. map_state.dedup_stream writes only the windows that a batch touches.
    """
    names = [c.split()[0] for c in FOLD.split(", ")]

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        detector = Detector(width, max_windows, state.get[0] if state.exists else None)
        out = []
        if state.hasTimedOut:
            for lo, gaps in detector.emissions():
                out += [(*key, None, None, "gap", None, lo, a, b) for a, b in gaps or [(None, None)]]
        else:
            rows = pd.concat(list(frames)).sort_values("arrival")
            for off, arrival in rows[["off", "arrival"]].itertuples(index=False):
                status, purged = detector.check(int(off))
                out.append((*key, off, arrival, "row", status, off - off % width, None, None))
                if purged:
                    out += [(*key, off, arrival, "gap", None, purged[0], a, b) for a, b in purged[1]]
        state.update((detector.state(),))
        if emit_seconds:
            state.setTimeoutDuration(emit_seconds * 1000)
        kinds = {c: "Int64" for c in ("off", "arrival", "status", "window_min", "gap_from", "gap_to")}
        yield pd.DataFrame(out, columns=names).astype(kinds)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if emit_seconds else GroupStateTimeout.NoTimeout
    rows, odd = standard(log)
    return rows.groupBy(*KEY).applyInPandasWithState(run, FOLD, "detector string", "append", timeout).unionByName(odd)


class Assembler:
    """Fragments of one id: the last payload of each part, the first part count, until parts 1 to n are there or it is too old."""

    def __init__(self, state: str | None = None):
        got = json.loads(state) if state else {"n": None, "parts": {}, "since": None}
        self.n, self.parts, self.since = got["n"], {int(k): bytes.fromhex(v) for k, v in got["parts"].items()}, got["since"]

    def state(self) -> str:
        return json.dumps({"n": self.n, "parts": {k: v.hex() for k, v in self.parts.items()}, "since": self.since})

    def add(self, part: int, n: int, payload: bytes, now: float, ttl: float) -> bytes | None:
        if self.since is not None and now - self.since > ttl:
            self.n, self.parts, self.since = None, {}, None
        if self.n is None:
            self.n, self.since = n, now
        self.parts[part] = payload
        if len(self.parts) >= self.n and all(k in self.parts for k in range(1, self.n + 1)):
            whole = b"".join(self.parts[k] for k in range(1, self.n + 1))
            self.n, self.parts, self.since = None, {}, None
            return whole
        return None


def reassemble_stream(frames: DataFrame, ttl_seconds: int = 30, max_parts: int = 4096) -> DataFrame:
    """(id, type, value, arrival) of whole messages of a streaming frame log (frame, arrival); incomplete ones go after their time.

    State is keyed by id, so the cap on entries is the time to live; a fragment beyond max_parts is dropped by the parser.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            held, now = Assembler(state.get[0] if state.exists else None), time.time()
            rows = pd.concat(list(batches)).sort_values("arrival")
            for type, part, n, payload, arrival in rows[["type", "part_no", "n_parts", "payload", "arrival"]].itertuples(index=False):
                whole = held.add(int(part), int(n), bytes(payload), now, ttl_seconds)
                if whole is not None:
                    out.append((key[0], int(type), whole, arrival))
            if held.parts:
                state.update((held.state(),))
                state.setTimeoutDuration(ttl_seconds * 1000)
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["id", "type", "value", "arrival"])

    good = parse(frames, max_parts).filter("error IS NULL").select("id", "type", "part_no", "n_parts", "payload", "arrival")
    return good.groupBy("id").applyInPandasWithState(run, "id string, type int, value binary, arrival long", "parts string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def delayed_stream(events: DataFrame, threads: dict[str, int], poll_seconds: int = 1) -> DataFrame:
    """Streaming events (id, ts, value) once per sending thread, held in state until their delay has passed."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        if not state.hasTimedOut:
            for pdf in batches:
                held += [[i, t.timestamp() + d, v.hex()] for i, t, v, d in pdf[["id", "ts", "value", "delay"]].itertuples(index=False)]
        now = time.time()
        due = sorted((h for h in held if h[1] <= now), key=lambda h: h[1])
        held = [h for h in held if h[1] > now]
        if held:
            state.update((json.dumps(held),))
            state.setTimeoutDuration(max(1, int(1000 * min(poll_seconds, min(h[1] for h in held) - now))))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], h[0], bytes.fromhex(h[2])) for h in due], columns=["thread", "id", "value"])

    rows = F.array(*[F.struct(F.lit(n).alias("thread"), F.lit(abs(s)).alias("delay")) for n, s in threads.items()])
    each = events.withColumn("_t", F.explode(rows)).select("id", "ts", "value", "_t.*").withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(64)))
    return each.groupBy("thread", "slot").applyInPandasWithState(run, "thread string, id string, value binary", "held string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def live_report(gap_topic: DataFrame, show, path: str | None = None, query: str = "gaps"):
    """Redraws the report of a streaming gap topic (topic, part, window_min, read_seq, ...) on change, once per micro-batch.

    show(windows) gets the latest record of every window that has been seen so far, not of the batch alone. They are kept in a table at
    path (a folder that all executors share; give it to go on after a restart), to which each batch adds its own once, however often it runs.
    """
    from ..tables import shared_folder
    from .compacted import LatestTable

    spark = gap_topic.sparkSession
    seen = LatestTable(spark, path or f"{shared_folder(spark)}/live-{uuid.uuid4().hex}", [*KEY, "window_min"], "read_seq")

    def redraw(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            seen.upsert(batch, number)
            show(seen.read())

    return gap_topic.writeStream.queryName(query).foreachBatch(redraw)


def rate_stats(events: DataFrame, seconds: int, late: str = "1 minute", sent=None) -> DataFrame:
    """Interval counters of a streaming log, final when the watermark has passed the interval; sent is what a row adds to the sent ones.

    stats.with_totals gives the running totals of what has been written of them.
    """
    count = {"received": F.count(F.lit(1)), "sent": F.sum(F.lit(1) if sent is None else sent).cast("long")}
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", f"{int(seconds)} seconds"), "topic").agg(*[c.alias(n) for n, c in count.items()])
    return rows.select(F.col("window.start").alias("time_start"), "topic", "received", "sent", F.floor(F.col("received") / seconds).alias("eps"))


def supervise(start, attempts: int, base_ms: int, most_ms: int, jitter: int = 0, sleep=time.sleep) -> int:
    """Starts a streaming query again after failures, with growing pauses; returns the number of starts."""
    from ..functions.config import backoff_ms, jitter_ms

    for attempt in range(1, attempts + 1):
        try:
            start().awaitTermination()
            return attempt
        except Exception:
            if attempt == attempts:
                raise
            sleep(jitter_ms(backoff_ms(attempt, base_ms, most_ms), jitter) / 1000)
    return attempts
