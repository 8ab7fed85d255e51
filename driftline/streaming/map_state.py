"""Detectors and reassembly on map state: a micro-batch reads and writes the windows and parts that it touches, not a key's whole state.

State lies in RocksDB (rocksdb() sets it for queries that start afterwards). windows_in() reads
the windows of a query, running or stopped, from its checkpoint. Control rows reset a detector: 'purge' forgets all its
windows, 'purge_full' those without anything missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.wire import parse
from ..operators.dedup import FOLD, KEY, WINDOW

COLUMNS = [c.split()[0] for c in FOLD.split(", ")]
INTS = {c: "Int64" for c in ("off", "arrival", "status", "window_min", "gap_from", "gap_to")}


def rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def missing_ranges(bits: int, lo: int) -> list[list[int]]:
    """Missing [from, to] below the greatest received number of a window."""
    out, at, top = [], 0, bits.bit_length()
    while at < top:
        if bits >> at & 1:
            at += 1
            continue
        rest = bits >> at
        run = (rest & -rest).bit_length() - 1
        out.append([lo + at, lo + at + run - 1])
        at += run
    return out


class WindowProcessor(StatefulProcessor):
    """One detector a key: map 'windows' by window, list of windows by number of creation in map 'queue', and 'head' with the greatest offset and the queue's ends."""

    def __init__(self, width: int, max_windows: int, emit_seconds: int | None):
        self.width, self.most, self.emit = width, max_windows, emit_seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "last long, first long, next long, n long, due long")
        self.windows = handle.getMapState("windows", "win long", "created long, bits string, top int, n int, sent boolean")
        self.queue = handle.getMapState("queue", "created long", "win long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, first, after, n, due = self.head.get() if self.head.exists() else (None, 0, 0, 0, None)
        held: dict[int, list | None] = {}  # windows that this batch has touched: [created, bits, sent], or None if there is none

        def window(lo):
            if lo not in held:
                got = self.windows.getValue((lo,))
                held[lo] = [got[0], int(got[1], 16), got[4]] if got else None
            return held[lo]

        def oldest():
            nonlocal first
            while first < after:
                at = self.queue.getValue((first,))
                if at and (w := window(at[0])) and w[0] == first:
                    return at[0]
                first += 1  # purged before its turn
            return None

        def drop(lo):
            nonlocal n
            self.queue.removeKey((held[lo][0],))
            held[lo], n = None, n - 1

        out = []
        for off, arrival, control in pd.concat(list(rows)).sort_values("arrival")[["off", "arrival", "control"]].itertuples(index=False):
            if isinstance(control, str):
                everyone = {lo for (lo,) in self.windows.keys()} | set(held)
                for lo in [lo for lo in sorted(everyone) if window(lo)]:
                    if control == "purge" or control == "purge_full" and held[lo][1].bit_count() == self.width:
                        drop(lo)
                continue
            off, arrival = int(off), int(arrival)
            last, lo = off if last is None else max(last, off), off - off % self.width
            purged = None
            if window(lo) is None:
                old = oldest()
                if old is not None and off < old:
                    out.append((*key, off, arrival, "row", -2, lo, None, None))
                    continue
                if n >= self.most:
                    purged = old, missing_ranges(held[old][1], old)
                    drop(old)
                held[lo] = [after, 0, None]
                self.queue.updateValue((after,), (lo,))
                after, n = after + 1, n + 1
            w, bit = held[lo], 1 << off - lo
            status = 1 if w[1] & bit else 0 if off == last else -1
            w[1] |= bit
            out.append((*key, off, arrival, "row", status, lo, None, None))
            if purged:
                out += [(*key, off, arrival, "gap", None, purged[0], a, b) for a, b in purged[1]]
        for lo, w in held.items():
            if w:
                self._put(lo, *w)
            elif self.windows.containsKey((lo,)):
                self.windows.removeKey((lo,))
        if self.emit and due is None:
            due = timerValues.getCurrentProcessingTimeInMs() + self.emit * 1000
            self.handle.registerTimer(due)
        self.head.update((last, first, after, n, due))
        yield pd.DataFrame(out, columns=COLUMNS).astype(INTS)

    def _put(self, lo: int, created: int, bits: int, sent) -> None:
        value = (created, f"{bits:x}", bits.bit_length(), bits.bit_count(), sent)
        if self.windows.getValue((lo,)) != value:
            self.windows.updateValue((lo,), value)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The periodic report: windows with gaps always, others once after they had some, and once at first."""
        out = []
        for (lo,), (created, bits, _, _, sent) in sorted(self.windows.iterator(), key=lambda w: w[1][0]):
            ranges = missing_ranges(int(bits, 16), lo)
            if ranges or sent is None or sent:
                out += [(*key, None, None, "gap", None, lo, a, b) for a, b in ranges or [(None, None)]]
            self._put(lo, created, int(bits, 16), bool(ranges))
        due = timerValues.getCurrentProcessingTimeInMs() + self.emit * 1000
        self.handle.registerTimer(due)
        last, first, after, n, _ = self.head.get()
        self.head.update((last, first, after, n, due))
        yield pd.DataFrame(out, columns=COLUMNS).astype(INTS)

    def close(self) -> None:
        pass


def dedup_stream(log: DataFrame, width: int = WINDOW, max_windows: int = 5, emit_seconds: int | None = None) -> DataFrame:
    """Rows and gap records (as dedup.FOLD) of a streaming log (topic, part, off, arrival), with an optional column control.

    Rows without topic, part, offset or arrival come back with null status; a control row needs topic, part and arrival.
    """
    control = F.col("control").cast("string") if "control" in log.columns else F.lit(None).cast("string")
    rows = log.select(F.col("topic").cast("string"), F.col("part").cast("int"), F.col("off").cast("long"), F.col("arrival").cast("long"), control.alias("control"))
    keyed = F.col("topic").isNotNull() & F.col("part").isNotNull() & F.col("arrival").isNotNull() & (F.col("off").isNotNull() | F.col("control").isNotNull())
    none = [F.lit(None).cast(t).alias(c) for c, t in (("status", "int"), ("window_min", "long"), ("gap_from", "long"), ("gap_to", "long"))]
    odd = rows.filter(~keyed).select(*KEY, "off", "arrival", F.lit("row").alias("kind"), *none)
    run = WindowProcessor(width, max_windows, emit_seconds)
    out = rows.filter(keyed).groupBy(*KEY).transformWithStateInPandas(run, FOLD, "append", "ProcessingTime" if emit_seconds else "None")
    return out.unionByName(odd)


def windows_in(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """(topic, part, win, received, missing, gaps) of the detectors of a query with this checkpoint, as of its last batch."""
    rows = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", "windows").load(checkpoint)
    at = rows.select("key.topic", "key.part", F.col("user_map_key.win").alias("win"), "user_map_value.*")

    @F.pandas_udf("array<array<long>>")
    def ranges(bits: pd.Series, win: pd.Series) -> pd.Series:
        return pd.Series([missing_ranges(int(b, 16), int(w)) for b, w in zip(bits, win)], dtype=object)

    return at.select("topic", "part", "win", F.col("n").cast("long").alias("received"), (F.col("top") - F.col("n")).cast("long").alias("missing"), ranges("bits", "win").alias("gaps"))


def introspection(windows: DataFrame) -> DataFrame:
    """(topic, part, windows, bytes, missing) of every detector, of what windows_in() has read."""
    return windows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("windows"), F.sum(16 + 16 * F.col("received")).alias("bytes"), F.sum("missing").alias("missing"))


MESSAGE = "id string, type int, value binary, arrival long"


class PartProcessor(StatefulProcessor):
    """Fragments of one id: map 'parts' by number, 'entry' with the count, when the entry began and how many of parts 1 to n there are."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "n int, since long, have int")
        self.parts = handle.getMapState("parts", "part_no int", "payload binary")

    def _forget(self) -> None:
        self.entry.clear()
        self.parts.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        n, since, have = self.entry.get() if self.entry.exists() else (None, None, 0)
        for type, part, count, payload, arrival in pd.concat(list(rows)).sort_values("arrival")[["type", "part_no", "n_parts", "payload", "arrival"]].itertuples(index=False):
            if since is not None and now - since > self.ttl:
                self._forget()
                n, since, have = None, None, 0
            if n is None:
                n, since = int(count), now
                self.handle.registerTimer(now + self.ttl)
            if 1 <= part <= n:
                have += not self.parts.containsKey((int(part),))
                self.parts.updateValue((int(part),), (bytes(payload),))
            if have == n:
                whole = b"".join(bytes(p) for _, (p,) in sorted((k, p) for k, p in self.parts.iterator()))
                out.append((key[0], int(type), whole, int(arrival)))
                self._forget()
                n, since, have = None, None, 0
        if n is not None:
            self.entry.update((n, since, have))
        yield pd.DataFrame(out, columns=["id", "type", "value", "arrival"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A timer of an entry that has been completed since finds another one, whose own timer will come.
        if self.entry.exists() and self.entry.get()[1] + self.ttl <= timerValues.getCurrentProcessingTimeInMs():
            self._forget()
        yield pd.DataFrame([], columns=["id", "type", "value", "arrival"])

    def close(self) -> None:
        pass


def reassemble_stream(frames: DataFrame, ttl_seconds: int = 30, max_parts: int = 4096) -> DataFrame:
    """(id, type, value, arrival) of whole messages of a streaming frame log (frame, arrival): a batch writes the parts that it brings; an entry goes when its time has passed."""
    good = parse(frames, max_parts).filter("error IS NULL AND id IS NOT NULL").select("id", F.col("type").cast("int"), "part_no", "n_parts", "payload", "arrival")
    return good.groupBy("id").transformWithStateInPandas(PartProcessor(ttl_seconds), MESSAGE, "append", "ProcessingTime")
