"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

Seeds are all K-word shingles. Each place of a seed is joined with the seed's first
place in the whole table (star), so matches grow with the seeds, never with the
square of a seed's places, and the result doesn't depend on how the table is split. Of a seed that is
frequent in one flush of a task only the first document's places are sent to the
seed's bucket; the others wait as one row and meet the first place in a join of few rows, whose hot
keys Spark splits.

The matches of a document with an earlier one are merged along diagonals
into segments; a Fenwick tree over source places finds each segment's best
predecessor under a linear gap cost. Chains, lone seeds too, their parts between
gaps of more than SPLIT words and their exact runs of LEAST words are extended by
an alignment over MARGIN words at both ends, across changed words, and compared
(longest common subsequence, bit-parallel, on 32-bit word fingerprints); those
of LEAST words and IDENTITY or more are passages; they begin and end with equal
words. Short chains are first held against a bound that every passage meets: their
surroundings must have ENOUGH word pairs in common. Where all seeds of a stretch are shared,
but not with one place of one earlier document, every LEAST words of it are joined with their
first place in the same way: an exact run is found whatever documents its seeds are first in. Changed passages of that
kind are found by switches: where a document goes over from matches with one source to matches with another, the two sources, their distance and a
seed of the second one make a seed themselves, which is joined with the first document that goes over in the same way.
Texts without a common K-word shingle have no common passage here.

Places are word numbers. Only repeats between different documents count; the
document with the smaller doc_id keeps its text. Null and short texts have no
passages; rows with null doc_id take no part and stay as they are; rows that
share a doc_id are versions of one document: a passage found in one is cut from
each at the same words. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import plain, release, written

K, LEAST, IDENTITY, GAP, SPLIT = 5, 40, 0.8, 0.1, 12
#: Seeds that a task holds; places of a seed in a flush that make it hot; words on both ends of a chain that it may be extended over.
HELD, HOT, MARGIN = 600_000, 64, 64
#: Bytes of a bucket of seeds that tasks work on at a time; the fewest bits of a bucket's number. Of a hash the bucket and BYTES more bytes count.
PASS, BITS, BYTES = 4 << 20, 9, 5
#: Matches that a task gathers before it deals them to buckets of documents.
MANY = 1 << 20
#: Adjacent equal words of any passage: IDENTITY of its words are equal, and each of the others, on either side, parts two of them at most.
ENOUGH = int(LEAST * (IDENTITY - 2 * (1 - IDENTITY)) - 1)

#: Segments before one that a switch may come from; words of a segment, from its start, and every how many of the source's words make switches.
BACK, HEAD, EVERY = 2, 24, 4

_KEY, _CUTS = "_driftline_key", "_driftline_cuts"
_ROWS, _CHAIN = "kind int, key long, data binary", "doc long, y0 int, y1 int, src long, x0 int, x1 int"
#: Kinds of rows: seeds of a bucket, places that wait for the first one of a hot seed, that first one, matches of a bucket of documents.
SEEDS, WAITING, FIRST, MATCHES = range(4)
_SHARED = np.uint32(1 << 31)


def shingles(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and word number of every K-word shingle of the batch."""
    raw, at = textops.utf8(column)
    start, end, row = textops.words(raw, at)
    return _within(textops.word_hashes(raw, start, end), row, K)


def _within(hashes, row, k):
    """Hash, row and place of every run of k hashes that is inside a row; row: offsets of the rows."""
    gram = textops.grams(hashes, k)
    of = np.repeat(np.arange(len(row) - 1), np.diff(row))[: len(gram)]
    ok = np.flatnonzero(np.arange(len(gram)) + k <= row[of + 1])
    return gram[ok], of[ok], ok - row[of[ok]]


def _planes(columns) -> bytes:
    """The columns' bytes, place by place of significance, which compresses well."""
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T).tobytes() for c in columns)


def _columns(data: bytes, kinds) -> list[np.ndarray]:
    kinds, out, at = [np.dtype(k) for k in kinds], [], 0
    n = len(data) // sum(k.itemsize for k in kinds)
    for k in kinds:
        flat = np.frombuffer(data, np.uint8, n * k.itemsize, at).reshape(k.itemsize, n)
        out.append(np.ascontiguousarray(flat.T).view(k).ravel())
        at += n * k.itemsize
    return out


_PLACE = ("<i8", "<u4")


def _steps(doc):
    """Documents as steps from one to the next, which are small within a blob."""
    return np.diff(doc, prepend=np.int64(0))


def _rows(kind, keys, data):
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(data), pa.int32()), pa.array(keys, pa.int64()), pa.array(data, pa.binary())], ["kind", "key", "data"])


def _blobs(kind, keys, edge, blob):
    """Rows of a kind, about PASS bytes of them at a time. blob: the bytes of the places from one edge to the next."""
    some, data, size = [], [], 0
    for key, a, b in zip(keys, edge[:-1].tolist(), edge[1:].tolist()):
        some.append(key)
        data.append(blob(a, b))
        size += len(data[-1])
        if size >= PASS:
            yield _rows(kind, some, data)
            some, data, size = [], [], 0
    if data:
        yield _rows(kind, some, data)


def _cut_at(values) -> np.ndarray:
    return np.r_[0, np.flatnonzero(np.diff(values)) + 1, len(values)] if len(values) else np.zeros(1, np.int64)


def _seed_rows(parts, bits: int):
    """From (h, doc, pos) parts: SEEDS blobs by bucket, and WAITING rows of what is hot in a flush, by hash."""
    held, n = [], 0
    low = np.uint64(64 - bits - 8 * BYTES)

    def flush():
        h, doc, pos = (np.concatenate(x) for x in zip(*held))
        held.clear()
        if not len(h):
            return
        h = h >> low
        pos = pos.astype(np.uint32)
        ranked = np.sort(h)
        edge = _cut_at(ranked)
        hot = ranked[edge[:-1][np.diff(edge) > HOT]]
        if len(hot):
            which = np.searchsorted(hot, h)
            some = np.flatnonzero(hot[np.minimum(which, len(hot) - 1)] == h)
            some = some[np.lexsort((pos[some], doc[some], h[some]))]
            edge, wait, keys = _cut_at(h[some]), [], []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                own = some[a:b]
                later = own[doc[own] != doc[own[0]]]
                if len(later):
                    pos[own[0]] |= _SHARED
                    wait.append(later)
                    keys.append(int(h[own[0]]))
            if wait:
                late, edge = np.concatenate(wait), np.r_[0, np.cumsum([len(w) for w in wait])]
                yield from _blobs(WAITING, keys, edge, lambda a, b: _planes((_steps(doc[late[a:b]]), pos[late[a:b]])))
                stay = np.ones(len(h), bool)
                stay[late] = False
                h, doc, pos = h[stay], doc[stay], pos[stay]
        bucket = (h >> np.uint64(8 * BYTES)).astype(np.uint32)
        order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
        bucket, doc, pos = bucket[order], doc[order], pos[order]
        tail = h[order].view(np.uint8).reshape(-1, 8)[:, :BYTES]
        edge = _cut_at(bucket)
        yield from _blobs(SEEDS, bucket[edge[:-1]].tolist(), edge, lambda a, b: np.ascontiguousarray(tail[a:b].T).tobytes() + _planes((_steps(doc[a:b]), pos[a:b])))

    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= HELD:
            yield from flush()
            n = 0
    if held:
        yield from flush()


def _seeds(bits: int):
    def run(batches):
        def parts():
            for batch in textops.slices(batches):
                h, row, pos = shingles(batch.column("text"))
                yield h, batch.column("doc_id").to_numpy()[row], pos

        yield from _seed_rows(parts(), bits)

    return run


def _match_rows(matches, bits: int):
    """MATCHES blobs of (doc, y, src, x) parts by bucket of the documents. Takes the parts out of the list."""
    cols = [*map(list, zip(*matches))]
    matches.clear()
    for k, parts in enumerate(cols):
        cols[k] = np.concatenate(parts)
        parts.clear()
    bucket = (textops.mix(cols[0].astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.uint32)
    order = np.lexsort((cols[0], bucket))
    bucket = bucket[order]
    for k in range(len(cols)):
        cols[k] = cols[k][order]
    del order
    doc, y, src, x = cols
    edge = _cut_at(bucket)
    yield from _blobs(MATCHES, bucket[edge[:-1]].tolist(), edge, lambda a, b: _planes((_steps(doc[a:b]), y[a:b], _steps(src[a:b]), x[a:b])))


def _stars(bits: int):
    """Matches of the seeds of each bucket with the first place of their hash, and of a shared hash's first document with itself; FIRST rows of hot ones; WAITING rows pass."""

    def run(batches):
        held, size, last = [], 0, None
        width, matches, many = 12 + BYTES, [], 0

        def dealt():
            nonlocal many
            if matches:
                yield from _match_rows(matches, bits)
            many = 0

        def flush():
            nonlocal many
            h, doc, pos = [], [], []
            for bucket, data in held:
                n = len(data) // width
                wide = np.zeros((n, 8), np.uint8)
                wide[:, :BYTES] = np.frombuffer(data, np.uint8, BYTES * n).reshape(BYTES, n).T
                h.append(wide.view(np.uint64).ravel() | np.uint64(bucket) << np.uint64(8 * BYTES))
                steps, place = _columns(data[BYTES * n :], _PLACE)
                doc.append(np.cumsum(steps))
                pos.append(place)
            h, doc, at = (np.concatenate(c) for c in (h, doc, pos))
            pos, hot = at & ~_SHARED, at >= _SHARED
            order = np.argsort(h)
            h, doc, pos, hot = h[order], doc[order], pos[order], hot[order]
            edge = _cut_at(h)
            start, group = edge[:-1], np.repeat(np.arange(len(edge) - 1), np.diff(edge))
            first = np.minimum.reduceat(doc, start)
            other = doc != first[group]
            at = np.minimum.reduceat(np.where(other, _SHARED, pos), start)
            heat = np.logical_or.reduceat(hot, start)
            if heat.any():
                some = np.flatnonzero(heat)
                yield _rows(FIRST, h[start[some]].astype(np.int64), [_planes((first[k : k + 1], at[k : k + 1])) for k in some.tolist()])
            shared = np.flatnonzero((np.logical_or.reduceat(other, start) | heat)[group])
            if len(shared):
                of = group[shared]
                matches.append((doc[shared], pos[shared], first[of], np.where(other[shared], at[of], pos[shared])))
                many += len(shared)
            if many >= MANY:
                yield from dealt()

        for batch in batches:
            for kind, bucket, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "key", "data"))):
                if kind != SEEDS:
                    yield _rows(kind, [bucket], [data])
                    continue
                if size >= PASS and bucket != last:
                    yield from flush()
                    held, size = [], 0
                held.append((bucket, data))
                size, last = size + len(data), bucket
        if held:
            yield from flush()
        yield from dealt()

    return run


def _waited(bits: int):
    """Matches of waiting places with the first one of their hash; the first document's own places match themselves."""

    def run(batches):
        parts, many = [], 0
        for batch in batches:
            for data, first in zip(batch.column("data").to_pylist(), batch.column("first").to_pylist()):
                steps, pos = _columns(data, _PLACE)
                (src,), (spos,) = _columns(first, _PLACE)
                doc = np.cumsum(steps)
                own = doc == src
                parts.append((doc, pos, np.full(len(doc), src), np.where(own, pos, spos).astype(np.uint32)))
                many += len(doc)
                if many >= MANY:
                    yield from _match_rows(parts, bits)
                    many = 0
        if parts:
            yield from _match_rows(parts, bits)

    return run


def _met_over_all(rows: DataFrame, bits: int) -> DataFrame:
    """MATCHES rows (key, data) of SEEDS and WAITING rows, sorted by key."""
    met = written(rows.repartition("kind", "key").sortWithinPartitions("kind", "key").mapInArrow(_stars(bits), _ROWS))
    first = met.filter(F.col("kind") == FIRST).select("key", F.col("data").alias("first"))
    late = met.filter(F.col("kind") == WAITING).join(first, "key").select("data", "first").mapInArrow(_waited(bits), _ROWS)
    every = met.filter(F.col("kind") == MATCHES).unionByName(late).select("key", "data")
    return every.repartition("key").sortWithinPartitions("key")


def _matches(batches):
    """(doc, src, y, x), sorted, of the whole documents of each bucket of matches."""
    held, last = [], None

    def flush():
        parts = [_columns(d, ("<i8", "<u4", "<i8", "<u4")) for d in held]
        doc, src = (np.concatenate([np.cumsum(p[k]) for p in parts]) for k in (0, 2))
        y, x = (np.concatenate([p[k] for p in parts]).astype(np.int32) for k in (1, 3))
        order = np.lexsort((y, src, doc))
        return doc[order], src[order], y[order], x[order]

    for batch in batches:
        for key, data in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist()):
            if key != last and held:
                yield flush()
                held = []
            held.append(data)
            last = key
    if held:
        yield flush()


class _Fenwick:
    """Greatest (value, item) over prefixes."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, value: float, item: int) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i][0]:
                self.best[i] = (value, item)
            i += i & -i

    def top(self, i: int) -> tuple[float, int]:
        """Over the places 0 to i - 1."""
        out = (-1e18, -1)
        while i > 0:
            if self.best[i][0] > out[0]:
                out = self.best[i]
            i -= i & -i
        return out


def chains(y: np.ndarray, x: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(y0, y1, x0, x1), ends exclusive, of the chains of matches sorted by y, x, that could make a passage."""
    order = np.lexsort((y, y - x))
    y, x = y[order], x[order]
    new = np.r_[True, (np.diff(y - x) != 0) | (np.diff(y) > 1)]
    lo = np.flatnonzero(new)
    hi = np.r_[lo[1:], len(y)] - 1
    y0, y1, x0, x1 = y[lo], y[hi] + K, x[lo], x[hi] + K
    if len(lo) == 1:
        return [(int(y0[0]), int(y1[0]), int(x0[0]), int(x1[0]))]
    by_start, by_end = np.lexsort((x0, y0)).tolist(), np.argsort(y1, kind="stable").tolist()
    ranks = np.unique(x1)
    at_end, before = np.searchsorted(ranks, x1).tolist(), np.searchsorted(ranks, x0, "right").tolist()
    a0, a1, b0, b1 = y0.tolist(), y1.tolist(), x0.tolist(), x1.tolist()
    tree, score, prev, waiting = _Fenwick(len(ranks)), [0.0] * len(lo), [-1] * len(lo), 0
    for s in by_start:
        while waiting < len(by_end) and a1[by_end[waiting]] <= a0[s]:
            e = by_end[waiting]
            tree.put(at_end[e], score[e] + GAP * (a1[e] + b1[e]), e)
            waiting += 1
        value, e = tree.top(before[s])
        gain = value - GAP * (a0[s] + b0[s])
        score[s] = a1[s] - a0[s]
        if e >= 0 and gain > 0:
            score[s] += gain
            prev[s] = e
    out, used = [], [False] * len(lo)
    for s in sorted(range(len(lo)), key=lambda s: -score[s]):
        if used[s]:
            continue
        links = [s]
        while prev[links[-1]] >= 0 and not used[prev[links[-1]]]:
            links.append(prev[links[-1]])
        links.reverse()
        for e in links:
            used[e] = True
        long = max(a1[links[-1]] - a0[links[0]], b1[links[-1]] - b0[links[0]])
        if sum(a1[e] - a0[e] for e in links) >= IDENTITY * long:
            out.append((a0[links[0]], a1[links[-1]], b0[links[0]], b1[links[-1]]))  # a passage, if long enough, by its seeds alone
            continue
        wide = [i + 1 for i, (e, f) in enumerate(zip(links, links[1:])) if max(a0[f] - a1[e], b0[f] - b1[e]) > SPLIT]
        spans = [(0, len(links))] + ([*zip([0, *wide], [*wide, len(links)])] if wide else [])
        # An exact run that is long enough stands by itself, whatever it is chained with.
        spans += [(i, i + 1) for i, e in enumerate(links) if len(links) > 1 and a1[e] - a0[e] >= LEAST]
        for i, j in {*spans}:
            head, tail = links[i], links[j - 1]
            out.append((a0[head], a1[tail], b0[head], b1[tail]))
    return out


def _chained(batches):
    for found in _matches(batches):
        yield _chain_rows(_pairs(found) + [(d, y0, y1, None, None, None) for d, y0, y1 in unsettled(*found)])
        turns = switches(*found)
        if len(turns[0]):
            yield _switch_rows(*turns)


def _chain_rows(rows):
    kinds = [pa.int64(), pa.int32(), pa.int32()] * 2
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc", "y0", "y1", "src", "x0", "x1"])


def _pairs(cols):
    doc, src, y, x = cols
    edge = np.r_[0, np.flatnonzero((np.diff(doc) != 0) | (np.diff(src) != 0)) + 1, len(doc)]
    lone = edge[:-1][np.diff(edge) == 1]
    lone = lone[doc[lone] != src[lone]]
    rows = [*zip(doc[lone].tolist(), y[lone].tolist(), (y[lone] + K).tolist(), src[lone].tolist(), x[lone].tolist(), (x[lone] + K).tolist())]
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if b > a + 1 and doc[a] != src[a]:
            rows += [(int(doc[a]), y0, y1, int(src[a]), x0, x1) for y0, y1, x0, x1 in thinned(chains(y[a:b], x[a:b]))]
    return rows


def switches(doc, src, y, x):
    """(hash, doc, place) of the places at which a document goes over from one source to another.

    Matches of other documents, by place, fall into segments of one source and diagonal. A segment's seeds near its start, at every EVERY-th word of the
    source, are hashed with the source and the diagonal of each of the BACK segments before it that end at most LEAST words earlier.
    """
    order = np.lexsort((y, doc))
    doc, src, y, x = (c[order] for c in (doc, src, y, x))
    ok = (doc != src) & np.r_[True, (doc[1:] != doc[:-1]) | (y[1:] != y[:-1])] if len(doc) else np.zeros(0, bool)
    doc, src, y, x = doc[ok], src[ok], y[ok].astype(np.int64), x[ok].astype(np.int64)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(doc) < 2:
        return none
    diag = y - x
    new = np.r_[True, (doc[1:] != doc[:-1]) | (src[1:] != src[:-1]) | (diag[1:] != diag[:-1]) | (np.diff(y) > LEAST)]
    seg, at = np.cumsum(new) - 1, np.flatnonzero(new)
    end = y[np.r_[at[1:], len(y)] - 1] + K
    pick = np.flatnonzero((x % EVERY == 0) & (y - y[at][seg] < HEAD))
    own = textops.mix(src[pick].astype(np.uint64)) + x[pick].astype(np.uint64)
    out = []
    for back in range(1, BACK + 1):
        before = seg[pick] - back
        some = np.flatnonzero(before >= 0)
        p, q = at[before[some]], pick[some]
        turn = (src[p] != src[q]) | (np.abs(diag[p] - diag[q]) > SPLIT)
        some = some[(doc[p] == doc[q]) & turn & (y[at[seg[q]]] - end[before[some]] <= LEAST)]
        p, q = at[before[some]], pick[some]
        h = textops.mix(textops.mix(src[p].astype(np.uint64)) ^ textops.mix((diag[q] - diag[p]).astype(np.uint64) ^ textops.mix(own[some])))
        out.append((h, doc[q], y[q]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _switch_rows(h, doc, y):
    """Switches among the rows of chains: the hash as source, no end."""
    none = pa.nulls(len(h), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(y.astype(np.int32)), none, pa.array(h.view(np.int64)), none, none], ["doc", "y0", "y1", "src", "x0", "x1"])


def _switch_seeds(bits: int):
    def run(batches):
        yield from _seed_rows(((b.column("src").to_numpy().view(np.uint64), b.column("doc").to_numpy(), b.column("y0").to_numpy().astype(np.int64)) for b in batches if b.num_rows), bits)

    return run


def _anchored(batches):
    """Matches of switches as chains."""
    for found in _matches(batches):
        yield _chain_rows(_pairs(found))


def thinned(found: list[tuple[int, int, int, int]], short: int = LEAST) -> list[tuple[int, int, int, int]]:
    """The chains without most of those under `short` words that begin at one source place and follow each other at less than K words.

    Such a text repeats itself within K words; the words of one chain and its surroundings hold the next ones too. The last one stays.
    """
    out, last, kept, wait = [], {}, {}, {}
    for c in sorted(found):
        x = c[2]
        if c[1] - c[0] < short:
            near, last[x] = c[0] - last.get(x, -K) < K, c[0]
            if near and c[0] - kept[x] < MARGIN // 2:
                wait[x] = c
                continue
            kept[x] = c[0]
            if x in wait:
                out.append(wait.pop(x))
        out.append(c)
    return out + [*wait.values()]


def unsettled(doc, src, y, x) -> list[tuple[int, int, int]]:
    """(doc, y0, y1): words of which all seeds are shared, but in no LEAST words all with one place of one earlier document."""
    order = np.lexsort((y, doc))
    doc, src, y, x = doc[order], src[order], y[order], x[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (y[1:] != y[:-1])]
    doc, src, y, x = doc[new], src[new], y[new], x[new]
    n, size = len(doc), LEAST - K + 1
    jump = (doc[1:] != doc[:-1]) | (np.diff(y) != 1)
    turn = jump | (src[1:] != src[:-1]) | (np.diff(y - x) != 0)

    def whole(edge):
        """Whether a run of the seeds of LEAST words begins here."""
        last = np.r_[np.flatnonzero(edge), n - 1]
        return last[np.searchsorted(last, np.arange(n))] - np.arange(n) >= size - 1

    at = np.flatnonzero(whole(jump) & ~(whole(turn) & (src != doc)))
    if not len(at):
        return []
    edge = np.flatnonzero((np.diff(at) != 1) | jump[at[:-1]]) if len(at) > 1 else np.zeros(0, np.int64)
    lo, hi = at[np.r_[0, edge + 1]], at[np.r_[edge, len(at) - 1]]
    return [*zip(doc[lo].tolist(), y[lo].tolist(), (y[hi] + LEAST).tolist())]


def _windows(bits: int):
    """Every LEAST words of the stretches (doc, y0, marks) as seeds, like the shingles."""

    def run(batches):
        def parts():
            for batch in batches:
                if not batch.num_rows:
                    continue
                marks = [np.frombuffer(m, "<u4") for m in batch.column("one").to_pylist()]
                row = np.r_[0, np.cumsum([len(m) for m in marks])]
                h, of, at = _within(textops.mix(np.concatenate(marks).astype(np.uint64) + np.uint64(1)), row, LEAST)
                yield h, batch.column("doc").to_numpy()[of], batch.column("y0").to_numpy()[of].astype(np.int64) + at

        yield from _seed_rows(parts(), bits)

    return run


def _runs(batches):
    """Matches of LEAST words as chains of exact runs."""
    for doc, src, pos, spos in _matches(batches):
        own = np.flatnonzero(doc != src)
        own = own[np.lexsort((pos[own], pos[own] - spos[own], src[own], doc[own]))]
        doc, pos, src, spos = doc[own], pos[own], src[own], spos[own]
        if len(doc):
            new = np.flatnonzero((np.diff(doc) != 0) | (np.diff(src) != 0) | (np.diff(pos - spos) != 0) | (np.diff(pos) > 1)) + 1
            lo, hi = np.r_[0, new], np.r_[new, len(doc)] - 1
            doc, src, lo, hi, x = doc[lo], src[lo], pos[lo], pos[hi] + LEAST, spos[lo]
            edge = np.r_[0, np.flatnonzero((np.diff(doc) != 0) | (np.diff(src) != 0)) + 1, len(doc)]
            rows = []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                found = zip(lo[a:b].tolist(), hi[a:b].tolist(), x[a:b].tolist(), (x[a:b] + hi[a:b] - lo[a:b]).tolist())
                rows += [(int(doc[a]), y0, y1, int(src[a]), x0, x1) for y0, y1, x0, x1 in thinned([*found], LEAST + K)]
            yield _chain_rows(rows)


def _plausible(batches):
    """Those chains whose surroundings, as 8-bit word fingerprints one and two, have ENOUGH word pairs in common."""
    names = ["doc", "y0", "y1", "src", "x0", "x1"]
    for batch in batches:
        for a in range(0, batch.num_rows, 2048):
            some = batch.slice(a, 2048)
            pairs = []
            for c in ("one", "two"):
                raw, at = textops.utf8(some.column(c))
                wide = raw.astype(np.uint32)
                pair = (wide[:-1] * np.uint32(0x9E37) + wide[1:] * np.uint32(0x85EB)) >> np.uint32(4) & np.uint32(4095)
                row = np.repeat(np.arange(len(at) - 1), np.diff(at))
                ok = np.flatnonzero(row[1:] == row[:-1])
                pairs.append((row[ok], pair[ok]))
            known = np.zeros((some.num_rows, 4096), bool)
            known[pairs[0]] = True
            hits = np.bincount(pairs[1][0], weights=known[pairs[1]], minlength=some.num_rows)
            yield some.filter(pa.array(hits >= ENOUGH)).select(names)


def _prints(bits: int):
    """Fingerprints of 8 or 32 bits of every text's words."""

    def run(batches):
        for batch in textops.slices(batches):
            raw, at = textops.utf8(batch.column("text"))
            start, end, row = textops.words(raw, at)
            marks = (textops.word_hashes(raw, start, end) >> np.uint64(64 - bits)).astype(f"<u{bits // 8}")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([marks[a:b].tobytes() for a, b in zip(row[:-1], row[1:])], pa.binary())], ["id", "marks"])

    return run


def common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each place of b."""
    where: dict[int, int] = {}
    for i, v in enumerate(b):
        where[v] = where.get(v, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for v in a:
        match = row & where.get(v, 0)
        if match:
            row = (row + match | row - match) & full
    return len(b) - row.bit_count()


def matched(a: np.ndarray, b: np.ndarray) -> int:
    """common() without the equal words that both begin or end with."""
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    if not len(apart):
        return n
    head = int(apart[0])
    apart = np.flatnonzero(a[len(a) - n + head :] != b[len(b) - n + head :])
    if not len(apart):
        return n
    tail = n - head - 1 - int(apart[-1])
    return head + tail + common(a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist())


def extended(pairs: list[tuple[np.ndarray, np.ndarray]], cost: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each side that the best alignment from the start takes: an equal word gains 1, a changed, missing or added one loses the cost.

    A place of both sides is a row, a pair a column. Scores are held with the cost of the second side's words added. Pairs that the first side's
    remaining words can't bring up to their best any more are left out.
    """
    own, other = (np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1))
    took, live = np.zeros((2, len(pairs)), np.int64), np.flatnonzero((own > 0) & (other > 0))
    if not len(live):
        return took[0], took[1]
    own, width = own[live], int(other[live].max())
    one, two = np.zeros((int(own.max()), len(live)), np.uint32), np.zeros((width, len(live)), np.uint32)
    for c, k in enumerate(live.tolist()):
        a, b = pairs[k]
        one[: len(a), c], two[: len(b), c] = a, b
    there = np.arange(width)[:, None] < other[live]
    step = (np.arange(width + 1, dtype=np.int16) * np.int16(cost))[:, None]
    score, best = np.zeros((width + 1, len(live)), np.int16), np.zeros(len(live), np.int16)
    for i in range(len(one)):
        same = one[i] == two
        same &= there
        same &= own > i
        diagonal = same * np.int16(1 + cost)
        diagonal += score[:-1]
        score -= np.int16(cost)
        np.maximum(score[1:], diagonal, out=score[1:])
        np.maximum.accumulate(score, axis=0, out=score)
        plain_ = score - step
        top = plain_.max(axis=0)
        more = np.flatnonzero(top >= best)  # a changed word before the last equal one is taken along
        if len(more):
            best[more] = top[more]
            took[0, live[more]], took[1, live[more]] = i + 1, (plain_[:, more] == top[more]).argmax(axis=0)
        if i % 8 == 7:
            stay = np.flatnonzero(top + (own - i - 1) >= best)
            if not len(stay):
                break
            if 4 * len(stay) < 3 * len(live):
                live, own, best = live[stay], own[stay], best[stay]
                one, two, there, score = (np.ascontiguousarray(x[:, stay]) for x in (one, two, there, score))
    return took[0], took[1]


def longest(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], core: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words before and behind of the longest passages that changed words alone make, -1 where none is long enough.

    pairs: the words before both cores, from the core on, and those behind; core: (equal words, length) of each. An equal word counts 1 - IDENTITY and
    a changed one -IDENTITY, in whole numbers; the sum of both ends and the core must not fall below 0, and both ends are equal words.
    """
    share = Fraction(IDENTITY).limit_denominator(100)
    gain, n, m = share.denominator, len(pairs), MARGIN
    ends = []
    for side in (0, 2):
        same = np.zeros((n, m), bool)
        for k, p in enumerate(pairs):
            size = min(len(p[side]), len(p[side + 1]))
            same[k, :size] = p[side][:size] == p[side + 1][:size]
        sums = np.where(same, gain - share.numerator, -share.numerator).cumsum(axis=1)
        ends.append(np.c_[np.zeros(n, np.int32), np.where(same, sums, -(1 << 28))].astype(np.int32))
    base = (gain * core[:, 0] - share.numerator * core[:, 1]).clip(-(1 << 28), 1 << 28).astype(np.int32)
    before, behind = np.full(n, -1), np.full(n, -1)
    able = np.flatnonzero(ends[0].max(axis=1) + ends[1].max(axis=1) + base >= 0)
    places = np.arange(m + 1, dtype=np.int16)
    for at in range(0, len(able), 128):
        some = able[at : at + 128]
        total = ends[0][some][:, :, None] + ends[1][some][:, None, :] + base[some][:, None, None]
        size = np.where(total >= 0, places[:, None] + places[None, :], np.int16(-1)).reshape(len(some), -1)
        best = size.argmax(axis=1)
        ok = size[np.arange(len(some)), best] + core[some, 1] >= LEAST
        before[some[ok]], behind[some[ok]] = best[ok] // (m + 1), best[ok] % (m + 1)
    return before, behind


def align(rows: list[tuple]) -> list[tuple]:
    """(row, before, behind, source before, source behind, identity) of the rows (one, two, left, right) that are passages. left, right: margin words of one and two."""
    out, left = [], list(range(len(rows)))
    # The widest extension first; at cost 4 it has no less than identity 0.8 itself.
    for cost in (1, 2, 4):
        failed = []
        for at in range(0, len(left), 512):
            some = [(k, *rows[k]) for k in left[at : at + 512]]
            before = extended([(a[: lo[0]][::-1], b[: lo[1]][::-1]) for _, a, b, lo, _ in some], cost)
            behind = extended([(a[len(a) - hi[0] :], b[len(b) - hi[1] :]) for _, a, b, _, hi in some], cost)
            for (k, a, b, lo, hi), p, q, r, t in zip(some, *(x.tolist() for x in (*before, *behind))):
                a, b = a[lo[0] - p : len(a) - hi[0] + r], b[lo[1] - q : len(b) - hi[1] + t]
                if len(a) < LEAST:
                    continue
                same = len(a) == len(b) and (a == b).all()
                identity = 1.0 if same else matched(a, b) / max(len(a), len(b)) if min(len(a), len(b)) >= IDENTITY * max(len(a), len(b)) else 0.0
                if identity >= IDENTITY:
                    out.append((k, p, r, q, t, identity))
                else:
                    failed.append(k)
        left = failed
    # An extension of the best sum may be too short, or too wide at every cost, where a longer or shorter one is a passage.
    found = {k for k, *_ in out}
    rest = [k for k in range(len(rows)) if k not in found]
    for at in range(0, len(rest), 512):
        some = rest[at : at + 512]
        pairs, core = [], []
        for k in some:
            a, b, lo, hi = rows[k]
            mid = a[lo[0] : len(a) - hi[0]], b[lo[1] : len(b) - hi[1]]
            pairs.append((a[: lo[0]][::-1], b[: lo[1]][::-1], a[len(a) - hi[0] :], b[len(b) - hi[1] :]))
            core.append((matched(*mid), max(map(len, mid))))
        for k, p, r in zip(some, *(x.tolist() for x in longest(pairs, np.array(core, np.int64).reshape(-1, 2)))):
            a, b, lo, hi = rows[k]
            a, b = a[lo[0] - p : len(a) - hi[0] + r], b[lo[1] - p : len(b) - hi[1] + r]
            if p >= 0 and len(a) >= LEAST:
                identity = matched(a, b) / max(len(a), len(b))
                if identity >= IDENTITY:
                    out.append((k, p, r, p, r, identity))
    return out


def _aligned(batches):
    names = ["doc_id", "start_word", "end_word", "src_doc_id", "src_start_word", "src_end_word", "identity"]
    kinds = [pa.int64(), pa.int32(), pa.int32()] * 2 + [pa.float64()]
    for batch in (whole.slice(a, 1024) for whole in batches for a in range(0, whole.num_rows, 1024)):
        rows, given = [], []
        for r in batch.to_pylist():
            one, two = np.frombuffer(r["one"], "<u4"), np.frombuffer(r["two"], "<u4")
            left = min(MARGIN, r["y0"]), min(MARGIN, r["x0"])
            right = len(one) - left[0] - (r["y1"] - r["y0"]), len(two) - left[1] - (r["x1"] - r["x0"])
            if min(right) >= 0:  # else a version of the document that has no such place
                rows.append(r)
                given.append((one, two, left, right))
        found = []
        for k, p, r, q, t, identity in align(given):
            c = rows[k]
            found.append((c["doc"], c["y0"] - p, c["y1"] + r, c["src"], c["x0"] - q, c["x1"] + t, round(identity, 4)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names)


def _bucket_bits(docs: DataFrame) -> int:
    """Bits of a bucket's number, so that a bucket of seeds takes about half of PASS."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(min(24, max(BITS, math.ceil(math.log2(max(1, size * 3 / (PASS / 2)))))))


def _both_sides(found: DataFrame, marks: DataFrame, width: int) -> DataFrame:
    """found with the fingerprints (width bytes each) of both sides, MARGIN words more at each end."""

    def part(lo: str, hi: str):
        first = F.greatest(F.col(lo) - MARGIN, F.lit(0))
        return F.col("marks").substr(width * first + 1, width * (F.col(hi) + MARGIN - first))

    one = found.join(marks, found["doc"] == marks["id"]).select("doc", "y0", "y1", "src", "x0", "x1", part("y0", "y1").alias("one"))
    return one.join(marks, F.col("src") == marks["id"]).select("doc", "y0", "y1", "src", "x0", "x1", "one", part("x0", "x1").alias("two"))


def _found(docs: DataFrame) -> DataFrame:
    """Chains, and stretches without a source (src null) that are still to be settled."""
    bits = _bucket_bits(docs)
    return written(_met_over_all(docs.mapInArrow(_seeds(bits), _ROWS), bits).mapInArrow(_chained, _CHAIN))


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, src_doc_id, src_start_word, src_end_word, identity) of each repeated passage."""
    docs = plain(docs, "doc_id", "text").filter("doc_id IS NOT NULL")
    found = _found(docs)
    release(docs.sparkSession, [])  # what the seeds took
    chains_ = found.filter("src IS NOT NULL AND y1 IS NOT NULL")
    turns = found.filter("src IS NOT NULL AND y1 IS NULL").select("src", "doc", "y0")
    if not turns.isEmpty():
        chains_ = chains_.unionByName(written(_met_over_all(turns.mapInArrow(_switch_seeds(BITS), _ROWS), BITS).mapInArrow(_anchored, _CHAIN)))
    short = F.col("y1") - F.col("y0") < LEAST
    likely = written(_both_sides(chains_.filter(short), docs.mapInArrow(_prints(8), "id long, marks binary"), 1).mapInArrow(_plausible, _CHAIN))
    release(docs.sparkSession, [])
    marks = docs.mapInArrow(_prints(32), "id long, marks binary")
    every = chains_.filter(~short).unionByName(likely)
    # Where seeds have different firsts, the first document that has LEAST words as a whole.
    words = F.col("marks").substr(4 * F.col("y0") + 1, 4 * (F.col("y1") - F.col("y0")))
    open_ = found.filter("src IS NULL").select("doc", "y0", "y1")
    if not open_.isEmpty():
        seeds = open_.join(marks, open_["doc"] == marks["id"]).select("doc", "y0", words.alias("one")).mapInArrow(_windows(BITS), _ROWS)
        every = every.unionByName(_met_over_all(seeds, BITS).mapInArrow(_runs, _CHAIN))
    return _both_sides(every, marks, 4).mapInArrow(_aligned, "doc_id long, start_word int, end_word int, src_doc_id long, src_start_word int, src_end_word int, identity double").distinct()


def remove_passages(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut from all but the earliest document, and n_chars to match where there is such a column."""
    cuts = written(passages(docs.select("doc_id", "text")).select("doc_id", "start_word", "end_word")).groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("cuts"))
    # One column of a name of ours: other columns may have any.
    rows = docs.join(cuts.select(F.col("doc_id").alias(_KEY), F.col("cuts").alias(_CUTS)), docs["doc_id"] == F.col(_KEY), "left").drop(_KEY)
    names = docs.columns
    place = names.index("text")
    counted = names.index("n_chars") if "n_chars" in names else None
    # Any name may come, so columns go to the workers by number.
    rows = rows.toDF(*["text" if i == place else f"_{i}" for i in range(len(names))], _CUTS)

    def run(batches):
        for batch in textops.slices(batches):
            texts = batch.column("text")
            touched = np.flatnonzero(batch.column(_CUTS).is_valid().to_numpy(zero_copy_only=False))
            if len(touched):
                some = texts.take(pa.array(touched))
                raw, at = textops.utf8(some)
                start, _, row = textops.words(raw, at)
                new, texts = {}, texts.to_pylist()
                for i, (k, cuts) in enumerate(zip(touched.tolist(), batch.column(_CUTS).take(pa.array(touched)).to_pylist())):
                    own, out, done = start[row[i] : row[i + 1]], [], int(at[i])
                    for a, b in sorted((c["start_word"], c["end_word"]) for c in cuts):
                        if a >= len(own):
                            continue
                        lo, hi = int(own[a]), int(own[b]) if b < len(own) else int(at[i + 1])
                        if lo > done:
                            out.append(raw[done:lo].tobytes())
                        done = max(done, hi)
                    out.append(raw[done : at[i + 1]].tobytes())
                    texts[k] = new[k] = b"".join(out).decode()
                texts = pa.array(texts, batch.column("text").type)
            cols = batch.columns[: len(names)]
            cols[place] = texts
            if counted is not None and len(touched):
                sizes = cols[counted].to_pylist()
                for k, text in new.items():
                    sizes[k] = len(text)
                cols[counted] = pa.array(sizes, cols[counted].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(run, docs.schema)
