"""Duplicate removal by sequence number, with exact detector semantics.

Status of each row: 1 duplicate, 0 new greatest, -1 fills a gap, -2 below the
first window (always delivered, never deduplicated). statuses() is relational
and valid while no window is evicted. replay() is exact with evictions too: it replays the few arrivals that can
open a window, and joins all rows with the windows' lives. fold() runs the detector itself, one key a task.

Rows without topic, part, offset or arrival belong to no detector: replay() and fold() give them back with
null status and window.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import forget, kept, same

KEY = ["topic", "part"]
WINDOW, MAX_WINDOWS = 100, 1_000_000


def first_window(log: DataFrame, width: int = WINDOW) -> DataFrame:
    """(topic, part, first_win): the window of each key's first arrival."""
    win = F.col("off") - F.col("off") % width
    return log.groupBy(*KEY).agg(F.min_by(win, "arrival").alias("first_win"))


def running_max(log: DataFrame, block: int, width: int = WINDOW) -> DataFrame:
    """log with hi, the greatest offset so far of its key, and first_win, the window of the key's first arrival.

    Two levels keep a hot key from being one task: one aggregate gives each block of arrivals its maximum and its first window, windows over these (one
    row a block) what came before it, and a window inside each block the rest.
    """
    rows = log.withColumn("_block", F.floor(F.col("arrival") / block))
    order = Window.partitionBy(*KEY).orderBy("_block")
    tops = rows.groupBy(*KEY, "_block").agg(F.max("off").alias("_top"), F.min_by(F.col("off") - F.col("off") % width, "arrival").alias("_win"))
    tops = tops.select(*KEY, "_block", F.max("_top").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_win").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("first_win"))
    inside = F.max("off").over(Window.partitionBy(*KEY, "_block").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_hi", inside).join(tops, [*KEY, "_block"]).withColumn("hi", F.greatest("_hi", "_before")).drop("_block", "_hi", "_before")


def statuses(log: DataFrame, width: int = WINDOW, block: int = 1 << 22) -> DataFrame:
    """log (topic, part, off, arrival, ...) with win and status."""
    seen = F.row_number().over(Window.partitionBy(*KEY, "off").orderBy("arrival"))
    rows = running_max(log, block, width).withColumns({"win": F.col("off") - F.col("off") % width, "_seen": seen})
    status = F.when(F.col("off") < F.col("first_win"), -2).when(F.col("_seen") > 1, 1).when(F.col("off") == F.col("hi"), 0).otherwise(-1)
    return rows.withColumn("status", status).drop("hi", "first_win", "_seen")


def clean(log: DataFrame, width: int = WINDOW, value: str = "payload") -> DataFrame:
    """What is delivered: all but duplicates and empty payloads."""
    return statuses(log, width).filter("status <> 1").filter(F.octet_length(value) > 0)


def needs_fold(log: DataFrame, width: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """(topic, part, windows, evicts): whether a key has more windows than the detector keeps."""
    rows = log.join(first_window(log, width), KEY).withColumn("win", F.col("off") - F.col("off") % width).filter("win >= first_win")
    return rows.groupBy(*KEY).agg(F.count_distinct("win").alias("windows")).withColumn("evicts", F.col("windows") > max_windows)


class Detector:
    """The sequential detector of one key; its state is a JSON text."""

    def __init__(self, width: int, max_windows: int, state: str | None = None, min_received: int = 0):
        self.width, self.max_windows = width, max_windows
        got = json.loads(state) if state else {"last": None, "least": min_received, "windows": [], "sent": {}}
        self.last, self.least, self.sent = got["last"], got["least"], got["sent"]
        self.windows: dict[int, int] = {lo: int(bits, 16) for lo, bits in got["windows"]}  # in order of creation

    def state(self) -> str:
        return json.dumps({"last": self.last, "least": self.least, "windows": [[lo, f"{bits:x}"] for lo, bits in self.windows.items()], "sent": self.sent})

    def check(self, n: int) -> tuple[int, tuple[int, list[list[int]]] | None]:
        """Status, and the window that was evicted with its gaps, if any were left in it."""
        self.last = n if self.last is None else max(self.last, n)
        self.least = min(self.least, n)
        lo, purged = n - n % self.width, None
        if lo not in self.windows:
            if self.windows and n < next(iter(self.windows)):
                return -2, None
            if len(self.windows) >= self.max_windows:
                old = next(iter(self.windows))
                gaps = self.gaps(old)
                del self.windows[old]
                purged = (old, gaps) if gaps else None
            self.windows[lo] = 0
        bit = 1 << n - lo
        if self.windows[lo] & bit:
            return 1, purged
        self.windows[lo] |= bit
        return (0 if n == self.last else -1), purged

    def gaps(self, lo: int) -> list[list[int]]:
        """Missing ranges of a window as absolute [from, to]; what follows the last received is not missing yet."""
        bits, out, start = self.windows[lo], [], None
        for k in range(bits.bit_length()):
            if not bits >> k & 1:
                start = k if start is None else start
            elif start is not None:
                a, b = max(lo + start, self.least), lo + k - 1
                if a <= b:
                    out.append([a, b])
                start = None
        return out

    def emissions(self) -> list[tuple[int, list[list[int]]]]:
        """Periodic report: windows with gaps always, others once after they had some, and once at first."""
        out = []
        for lo in self.windows:
            gaps, key = self.gaps(lo), str(lo)
            if gaps or self.sent.get(key, True):
                out.append((lo, gaps))
            self.sent[key] = bool(gaps)
        self.sent = {k: v for k, v in self.sent.items() if int(k) in self.windows}
        return out

    def missing(self) -> int:
        return sum(b - a + 1 for lo in self.windows for a, b in self.gaps(lo))

    def memory(self) -> int:
        """Estimate: 16 bytes a window and 16 a received number."""
        return sum(16 + 16 * bits.bit_count() for bits in self.windows.values())

    def purge_full(self) -> int:
        """Drops windows without anything missing, a real reset; returns how many."""
        full = [lo for lo, bits in self.windows.items() if bits.bit_count() == self.width]
        for lo in full:
            del self.windows[lo]
        return len(full)


FOLD = "topic string, part int, off long, arrival long, kind string, status int, window_min long, gap_from long, gap_to long"


def fold(log: DataFrame, width: int = WINDOW, max_windows: int = 3) -> DataFrame:
    """Exact replay: a row of kind 'row' with its status for each arrival, and rows of kind 'gap' for evicted windows' gaps.

    Rows are dealt by key, sorted by arrival and streamed; a task holds the detector of one key at a time, never a group's rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, detector = None, None
        for pdf in batches:
            out = []
            for topic, part, off, arrival in pdf.itertuples(index=False):
                if (topic, part) != key:
                    key, detector = (topic, part), Detector(width, max_windows)
                status, purged = detector.check(int(off))
                out.append((topic, part, off, arrival, "row", status, off - off % width, None, None))
                if purged:
                    out += [(topic, part, off, arrival, "gap", None, purged[0], a, b) for a, b in purged[1]]
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in FOLD.split(", ")])
            yield frame.astype({c: "Int64" for c in ("status", "window_min", "gap_from", "gap_to")})

    rows, odd = standard(log)
    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "arrival").mapInPandas(run, FOLD).unionByName(odd)


def standard(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topic, part, off, arrival) of the rows that have them all, and the others as FOLD."""
    rows = log.select(*KEY, "off", "arrival")
    whole = F.col("topic").isNotNull() & F.col("part").isNotNull() & F.col("off").isNotNull() & F.col("arrival").isNotNull()
    none = {c: F.lit(None).cast(t) for c, t in (("status", "int"), ("window_min", "long"), ("gap_from", "long"), ("gap_to", "long"))}
    odd = rows.filter(~whole).select(*[F.col(c).cast(t) for c, t in (("topic", "string"), ("part", "int"), ("off", "long"), ("arrival", "long"))], F.lit("row").alias("kind"), *[c.alias(n) for n, c in none.items()])
    return rows.filter(whole), odd


LIVES = "topic string, part int, win long, born long, died long, died_off long, block long"
#: Rounds in which only doubtful windows are looked at more closely; then a key in doubt is replayed row by row.
CLOSER = 3


def _replay(max_windows: int):
    """mapInPandas over touches (topic, part, win, block, first, last, off) by key and first: windows' lives, and rows with a block for touches in doubt.

    A touch stands for all arrivals of a window in a block. It is in doubt if its window went, or could have been opened, between its
    first and its last arrival.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, born, touch, apart, out = None, {}, {}, {}, []
        for pdf in batches:
            for topic, part, win, block, first, last, off in pdf.itertuples(index=False):
                if (topic, part) != key:
                    out += [(*key, w, b, None, None, None) for w, b in born.items()] if key else []
                    key, born, touch, apart = (topic, part), {}, {}, {}
                if win not in born:
                    oldest = next(iter(born), win)
                    if win < oldest:
                        apart[win] = max(apart.get(win, (last, block)), (last, block))
                        continue
                    if len(born) >= max_windows:
                        out.append((*key, oldest, born.pop(oldest), first, off, None))
                        apart[oldest] = touch.pop(oldest)
                        oldest = next(iter(born), win)
                    born[win] = first
                    apart.pop(win, None)
                    for w, (until, b) in list(apart.items()):
                        if until <= first:
                            del apart[w]
                        elif w >= oldest:
                            out.append((*key, w, None, None, None, b))
                            del apart[w]
                touch[win] = max(touch.get(win, (last, block)), (last, block))
            yield _lives(out)
            out = []
        yield _lives([(*key, w, b, None, None, None) for w, b in born.items()] if key else [])

    return run


def _lives(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in LIVES.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in names[1:]})


def lives(log: DataFrame, width: int = WINDOW, max_windows: int = 3, block: int = 1 << 12) -> DataFrame:
    """(topic, part, win, born, died, died_off): when each window was opened, and by which arrival evicted (null: never).

    Only the first arrival of a window in a block of arrivals is replayed; where a window's part in a block is in doubt, its
    own arrivals are replayed too, until nothing is. So a task reads a key's windows, not its rows.
    """
    rows = standard(log)[0].withColumns({"win": F.col("off") - F.col("off") % width, "block": F.floor(F.col("arrival") / block)})
    group = [*KEY, "win", "block"]
    touches = kept(rows.groupBy(*group).agg(F.min("arrival").alias("first"), F.max("arrival").alias("last"), F.min_by("off", "arrival").alias("off")))
    closer = None
    for near in range(CLOSER + 2):
        each = touches
        if closer is not None:
            single = rows.join(closer, group, "left_semi").select(*group, F.col("arrival").alias("first"), F.col("arrival").alias("last"), "off")
            each = touches.join(closer, group, "left_anti").unionByName(single)
        sorted_ = each.select(*group, "first", "last", "off").repartition(*KEY).sortWithinPartitions(*KEY, "first")
        got = kept(sorted_.mapInPandas(_replay(max_windows), LIVES))
        doubt = got.filter("block IS NOT NULL").select(*group).distinct()
        if doubt.isEmpty():
            return got.filter("block IS NULL").drop("block")
        if near >= CLOSER - 1:
            doubt = touches.join(doubt.select(*KEY).distinct(), KEY, "left_semi").select(*group)
        seen, closer = closer, kept(doubt if closer is None else closer.unionByName(doubt).distinct())
        forget(got, *([seen] if seen is not None else []))
    raise AssertionError("single arrivals are never in doubt")


def lived(log: DataFrame, width: int = WINDOW, max_windows: int = 3, block: int = 1 << 12) -> DataFrame:
    """(topic, part, off, arrival, hi, win, born, died, died_off, seen) of the standard rows: the life of its window that a row fell into, if any, and its rank among the arrivals of its number there."""
    at = kept(lives(log, width, max_windows, block)).select(*[F.col(c).alias(f"_{c}") for c in (*KEY, "win")], "born", "died", "died_off")
    rows = running_max(standard(log)[0], 1 << 22).withColumn("win", F.col("off") - F.col("off") % width)
    inside = (F.col("arrival") >= F.col("born")) & (F.col("died").isNull() | (F.col("arrival") < F.col("died")))
    found = rows.join(at, same(rows, at, {c: f"_{c}" for c in (*KEY, "win")}) & inside, "left").drop("_topic", "_part", "_win")
    return found.drop("first_win").withColumn("seen", F.row_number().over(Window.partitionBy(*KEY, "win", "off", "born").orderBy("arrival")))


def replay(log: DataFrame, width: int = WINDOW, max_windows: int = 3, block: int = 1 << 12) -> DataFrame:
    """What fold() gives, relationally: each row joined with the life of its window, the gaps of evicted windows from the numbers that they saw."""
    rows = kept(lived(log, width, max_windows, block))
    status = F.when(F.col("born").isNull(), -2).when(F.col("seen") > 1, 1).when(F.col("off") == F.col("hi"), 0).otherwise(-1).cast("int")
    none = [F.lit(None).cast("long").alias(c) for c in ("gap_from", "gap_to")]
    plain = rows.select(*KEY, "off", "arrival", F.lit("row").alias("kind"), status.alias("status"), F.col("win").alias("window_min"), *none)
    before = F.lag("off").over(Window.partitionBy(*KEY, "win", "born").orderBy("off"))
    holes = rows.filter("seen = 1 AND died IS NOT NULL").withColumns({"gap_from": F.coalesce(before + 1, F.col("win")), "gap_to": F.col("off") - 1}).filter("gap_from <= gap_to")
    gone = holes.select(*KEY, F.col("died_off").alias("off"), F.col("died").alias("arrival"), F.lit("gap").alias("kind"), F.lit(None).cast("int").alias("status"), F.col("win").alias("window_min"), "gap_from", "gap_to")
    return plain.unionByName(gone).unionByName(standard(log)[1])
