"""Exact repeated strings by prefix-free parsing.

Rolling-hash triggers cut every text into phrases: the trigger of a SIZE-byte
string is the least hash among its W-byte windows (leftmost of equals), and the
consecutive strings with one trigger make a phrase, from the first string's
start to the last one's end. Equal strings have equal triggers at equal
offsets, so all places of a string lie in phrases with the same trigger window.

The dictionary holds distinct phrases (128 bits of hash: that of the trigger and that of the
phrase); the parse is their occurrences. All strings of a phrase that occurred
earlier are repeats; that settles the inside of copies, first in a task, then
over all tasks, so a phrase that is everywhere sends one row a task. Phrases
that differ but share a trigger and a context that some string could lie in are
compared on their bytes, by the dictionary's suffix array: prefix doubling ranks all
suffixes of a task's phrases by their first SIZE bytes, and the parse's occurrences give the order among equal
ones, by document and place; of equal neighbours all but the first repeat. No string reaches beyond its phrase,
so the order of what follows in the parse, which full suffix arrays would need, decides nothing here.
Triggers with more than BLOCK such phrases are dealt to several
parts, whose firsts are settled by their least place. Together the
triggers' suffix arrays are the corpus order as far as SIZE bytes; a suffix
array of the whole corpus is never in one place.

Bytes of a repeat are removed. Null and short texts lose nothing; rows with null
doc_id take no part; rows that share a doc_id are one document whose places
coincide: what repeats in one is cut from each, and equal places aren't earlier.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops
from .common import cut, plain

SIZE, W = 100, 32
SPAN = SIZE - W + 1
#: Phrases that a task holds to merge equal ones; phrases of a trigger's part; bytes of a numpy pass; shares of a hot trigger's rows.
HELD, BLOCK, PASS, SALTS = 600_000, 1024, 1 << 19, 32

#: h, u: hashes of the trigger and of the phrase; ctx: 12 bits each of the text left and right of the trigger.
_PHRASE = "h long, u long, ctx int, doc long, lo long, size int, off int"
_LAST = np.uint64(2**64 - 1)
_CODE = textops._CODE


def _least(hashes: np.ndarray, n: int) -> np.ndarray:
    """Index of the least of each n consecutive hashes, the leftmost of equals, by doubling."""
    at, width = np.arange(len(hashes)), 1

    def better(a, b):
        return np.where(hashes[b] < hashes[a], b, a)

    while 2 * width <= n:
        at = better(at[:-width], at[width:])
        width *= 2
    if width < n:
        at = better(at[: -(n - width)], at[n - width :])
    return at


def phrases(text: np.ndarray) -> tuple[np.ndarray, ...]:
    """h, u, context, start, size, trigger offset of the phrases of one text of SIZE bytes at least, pass by pass.

    A pass begins anew at a fixed place; a phrase that it cuts in two is two shorter phrases, which changes no result.
    """
    parts = []
    for lo in range(0, len(text) - SIZE + 1, PASS):
        raw = text[lo : lo + PASS + SIZE - 1]
        if len(raw) < SIZE:
            break
        up, down = textops._powers(max(len(raw) + 1, 1 << 12))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_CODE[raw] * up[: len(raw)], out=total[1:])

        def hashed(a, b):
            return textops.mix((total[b] - total[a]) * down[a])

        n = len(raw) - W + 1
        window = textops.mix((total[W:] - total[:-W]) * down[:n])
        least = _least(window, SPAN)
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        size = np.r_[first[1:], len(least)] - first
        trigger = least[first]
        off = trigger - first
        u = hashed(first, first + size + SIZE - 1) + (size.astype(np.uint64) << np.uint64(8)) + off.astype(np.uint64)
        # Any string with this trigger reaches this far to the left or to the right of it.
        near = (SIZE - W) // 2
        left = np.where((trigger >= near) & (off >= near), hashed(np.maximum(trigger - near, 0), trigger), _LAST)
        end = np.minimum(trigger + W + near, len(raw))
        right = np.where(first + size - 1 + SIZE >= trigger + W + near, hashed(trigger, end), _LAST)
        context = ((left >> np.uint64(52)) << np.uint64(12) | right >> np.uint64(52)).astype(np.int32)
        parts.append((window[trigger], textops.mix(u), context, first + lo, size, off))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _batch(names, kinds, cols):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


_NAMES = ["h", "u", "ctx", "doc", "lo", "size", "off"]
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def _rows(h, u, ctx, doc, lo, size, off):
    return _batch(_NAMES, _KINDS, [h.view(np.int64), u.view(np.int64), ctx, doc, lo, size.astype(np.int32), off.astype(np.int32)])


def _parsed(batches):
    """The task's first occurrence of each phrase; its others as repeats (off = -1), neighbours merged."""
    held, n = [], 0

    def flush():
        h, u, ctx, doc, lo, size, off = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((lo, doc, u, h))
        h, u, ctx, doc, lo, size, off = (x[order] for x in (h, u, ctx, doc, lo, size, off))
        first = np.r_[True, (h[1:] != h[:-1]) | (u[1:] != u[:-1])]
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        later = (doc != doc[lead]) | (lo != lo[lead])
        keep = ~later
        yield _rows(h[keep], u[keep], ctx[keep], doc[keep], lo[keep], size[keep], off[keep])
        if later.any():
            d, a, s = doc[later], lo[later], size[later]
            order = np.lexsort((a, d))
            d, a, s = d[order], a[order], s[order]
            new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (a[1:] != a[:-1] + s[:-1])])
            total = np.add.reduceat(s, new)
            d, a = d[new], a[new]
            # Repeats only pass through the next exchange.
            yield _rows(textops.mix(d.astype(np.uint64)), textops.mix(a.astype(np.uint64)), np.zeros(len(d), np.int32), d, a, total, np.full(len(d), -1))

    for batch in textops.slices(batches):
        raw, at = textops.utf8(batch.column("text"))
        for doc, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
            if b - a >= SIZE:
                got = phrases(raw[a:b])
                held.append((*got[:3], np.full(len(got[0]), doc, np.int64), *got[3:]))
                n += len(got[0])
        if n >= HELD:
            yield from flush()
            held, n = [], 0
    if held:
        yield from flush()


def _linked(batches):
    """Of phrases sorted by (h, u, doc, lo): later occurrences become repeats (off -1); firsts that may share a string with another phrase stay (off >= 0)."""
    tail = None  # rows of the last trigger, which the next batch may go on with
    last = None  # key and place of the last first occurrence that has been given out

    def settle(cols):
        nonlocal last
        h, u, _, doc, lo, size, off = cols
        first = np.r_[True, (h[1:] != h[:-1]) | (u[1:] != u[:-1])]
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        d0, l0 = doc[lead].copy(), lo[lead].copy()
        if last and (last[0], last[1]) == (h[0], u[0]):
            d0[lead == 0], l0[lead == 0] = last[2], last[3]
            first[0] = False
        later = (doc != d0) | (lo != l0)
        last = (h[-1], u[-1], d0[-1], l0[-1])
        return first, later

    def out(cols, whole):
        """whole: the last trigger has ended, and none began before these rows."""
        first, later = settle(cols)
        h, u = cols[0], cols[1]
        yield _rows(h[later], u[later], *[c[later] for c in cols[2:6]], np.full(int(later.sum()), -1))
        firsts = np.flatnonzero(first & ~later)
        if whole:
            maybe = np.zeros(len(firsts), bool)
            for shift in (12, 0):
                context = (cols[2][firsts] >> shift) & 4095
                order = np.lexsort((context, h[firsts]))
                same = (h[firsts][order][1:] == h[firsts][order][:-1]) & (context[order][1:] == context[order][:-1])
                maybe[order[1:][same]] = maybe[order[:-1][same]] = True
            firsts = firsts[maybe]
        yield _rows(h[firsts], u[firsts], *[c[firsts] for c in cols[2:]])

    broken = False  # whether rows of the tail's trigger have been given out already
    for batch in batches:
        passing = pa.compute.less(batch.column("off"), 0)
        yield batch.filter(passing)
        batch = batch.filter(pa.compute.invert(passing))
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in _NAMES]
        if tail is not None:
            cols = [np.concatenate(p) for p in zip(tail, cols)]
        at = int(np.searchsorted(cols[0], cols[0][-1]))  # h is sorted as signed
        if at:
            end = int(np.searchsorted(cols[0], cols[0][0], "right")) if broken else 0
            if broken:
                yield from out([c[:end] for c in cols], False)
            if end < at:
                yield from out([c[end:at] for c in cols], True)
            broken = False
        tail = [c[at:] for c in cols]
        if len(tail[0]) > 8 * BLOCK:
            yield from out(tail, False)
            tail, broken = None, True
    if tail is not None and len(tail[0]):
        yield from out(tail, not broken)


_SUFFIX = "kind int, doc long, lo long, hi long, g1 long, g2 long"
_SNAMES = ["kind", "doc", "lo", "hi", "g1", "g2"]
_SKINDS = [pa.int32()] + [pa.int64()] * 5


def _dense(x: np.ndarray) -> np.ndarray:
    """Rank of each value, equal ones alike."""
    order = np.argsort(x, kind="stable")
    out = np.empty(len(x), np.int64)
    out[order] = np.cumsum(np.r_[0, x[order][1:] != x[order][:-1]])
    return out


def suffix_ranks(raw: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Place in byte order of the size bytes (8 at least) from each position on, by prefix doubling; equal strings alike."""
    if len(raw) < size:
        return np.zeros(0, np.int64)
    rank, width = _dense(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view(">u8").ravel().astype(np.uint64)), 8
    while width < size:
        step = min(width, size - width)  # the last step overlaps
        rank = _dense(rank[:-step] * (rank.max() + 1) + rank[step:])
        width += step
    return rank


def sorted_suffixes(units: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """doc, place, position in the joined bytes, unit and whether it is the first of its string, of every suffix of SIZE bytes of phrases (doc, lo, size, bytes), in the order of the suffix array."""
    raw = np.frombuffer(b"".join(u[3] for u in units), np.uint8)
    size = np.array([u[2] for u in units])
    base = np.r_[0, np.cumsum([len(u[3]) for u in units])][:-1]
    unit = np.repeat(np.arange(len(units)), size)
    inside = np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size)
    at = base[unit] + inside
    doc, place = np.array([u[0] for u in units], np.int64)[unit], np.array([u[1] for u in units], np.int64)[unit] + inside
    rank = suffix_ranks(raw)[at]
    order = np.lexsort((place, doc, rank))
    rank, doc, place, at, unit = (x[order] for x in (rank, doc, place, at, unit))
    return doc, place, at, unit, np.r_[True, rank[1:] != rank[:-1]]


def _resolved(batches):
    """kind 0: strings that repeat, as ranges of starts; kind 1: firsts of triggers that have several parts."""

    def done(units, several):
        doc, place, at, unit, first = sorted_suffixes(units)
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        again = np.flatnonzero((doc != doc[lead]) | (place != place[lead]))
        again = again[np.lexsort((place[again], doc[again]))]
        d, a = doc[again], place[again]
        new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (a[1:] > a[:-1] + 1)][: len(d)])
        last = np.r_[new[1:], len(d)] - 1 if len(d) else new
        rows = [*zip([0] * len(new), d[new].tolist(), a[new].tolist(), (a[last] + 1).tolist(), d[new].tolist(), a[new].tolist())]
        raw = b"".join(u[3] for u in units)
        for k in np.flatnonzero(first & np.array(several)[unit]).tolist():
            g = hashlib.blake2b(raw[at[k] : at[k] + SIZE], digest_size=16).digest()
            rows.append((1, int(doc[k]), int(place[k]), int(place[k]) + 1, int.from_bytes(g[:8], "little", signed=True), int.from_bytes(g[8:], "little", signed=True)))
        return _batch(_SNAMES, _SKINDS, list(zip(*rows)) if rows else [[]] * 6)

    key, units, several, size = None, [], [], 0
    for batch in batches:
        for h, part, parts, doc, lo, n, text in zip(*[batch.column(c).to_pylist() for c in ("h", "part", "parts", "doc", "lo", "size", "text")]):
            # Equal strings have one trigger, so a table of suffixes may hold several triggers, but ends between two.
            if (h, part) != key and size >= PASS:
                yield done(units, several)
                units, several, size = [], [], 0
            key = h, part
            if text is not None and len(text) == n + SIZE - 1:
                units.append((doc, lo, n, text))
                several.append(parts > 1)
                size += len(text)
    if units:
        yield done(units, several)


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, lo, hi): ranges of byte places at which SIZE-byte strings start that have started earlier."""
    docs = plain(docs, "doc_id", "text").filter("doc_id IS NOT NULL")
    parsed = docs.mapInArrow(_parsed, _PHRASE).repartition("h").sortWithinPartitions("h", "u", "doc", "lo")
    linked = cut(parsed.mapInArrow(_linked, _PHRASE))
    whole = linked.filter("off < 0").select("doc", "lo", (F.col("lo") + F.col("size")).alias("hi"))
    asked = linked.filter("off >= 0").select("h", "doc", "lo", "size")
    hot = asked.groupBy("h").count().filter(F.col("count") > BLOCK).select("h", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    # A hot trigger's rows meet its count in several places.
    hot = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("doc", "lo"), F.lit(SALTS)).cast("int")).join(hot, ["h", "salt"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("lo", "doc"), F.col("parts")).cast("int"))
    text = F.col("text").cast("binary").substr(F.col("lo").cast("int") + 1, F.col("size") + SIZE - 1)
    units = asked.join(docs, asked["doc"] == docs["doc_id"]).select("h", "part", "parts", "doc", "lo", "size", text.alias("text"))
    settled = units.repartition("h", "part").sortWithinPartitions("h", "part", "doc", "lo").mapInArrow(_resolved, _SUFFIX)
    # Firsts of several parts of a trigger: one row per part and string, the least of which is the first. Ranges have keys of their own.
    least = F.min(F.struct("doc", "lo")).over(Window.partitionBy("kind", "g1", "g2"))
    late = settled.withColumn("least", least).filter("kind = 0 OR struct(doc, lo) > least").select("doc", "lo", "hi")
    return whole.unionByName(late)


def merged(ranges: list[dict]) -> list[tuple[int, int]]:
    """Byte runs covered by the strings of the ranges of starts."""
    out: list[list[int]] = []
    for r in sorted((r["lo"], r["hi"] + SIZE - 1) for r in ranges):
        if out and r[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r[1])
        else:
            out.append(list(r))
    return [tuple(r) for r in out]


def _cut(batches):
    for batch in batches:
        rows = []
        raw, at = textops.utf8(batch.column("text"))
        for a, b, ranges in zip(at[:-1].tolist(), at[1:].tolist(), batch.column("ranges").to_pylist()):
            own, kept, done = raw[a:b], [], 0
            runs = [(lo, min(hi, b - a)) for lo, hi in merged(ranges or []) if lo < b - a]
            for lo, hi in runs:
                kept.append(own[done:lo].tobytes())
                done = hi
            kept = b"".join([*kept, own[done:].tobytes()])
            rows.append((b - a, b - a - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
        cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def deduplicate(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): every document without its repeats; kept is its remaining bytes."""
    docs = plain(docs, "doc_id", "text")
    named = docs.filter("doc_id IS NOT NULL")
    ranges = repeats(docs).groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    rows = named.join(ranges, named["doc_id"] == ranges["doc"], "left").select("doc_id", "text", "ranges")
    rows = rows.unionByName(docs.filter("doc_id IS NULL").withColumn("ranges", F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>")))
    return rows.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
