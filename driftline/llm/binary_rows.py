"""Token-id matrices by best-fit-decreasing packing with segment-tree capacity search.

Pieces go in order of falling length into the open row with the least room that
still holds them. The segment tree stands over room sizes: a node counts the
open rows with room in its range, and the search walks to the least room of at
least the piece's length in O(log size).

Each output row is one matrix of up to ROWS packed id rows: ids as a
row-major little-endian uint32 matrix filled up with the end id, cumulative
segment lengths of each row (starting at 0 and ending at its fill), positions
that start anew with each segment, and the segments' doc_id, piece and start,
from which every document can be put together again without loss.

Tasks pack what they read, CHUNK pieces at a time, and settle the rows that have at most
SLACK tokens of room left. The pieces of all others are packed once more, over the whole table, in
groups of REST pieces, so how full the rows are hardly depends on how the table is split.

Null and empty texts are the end token alone; null doc_ids and repeated rows
are packed like others; an empty table has no matrices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import plain, written
from .tokens import encoder, pieces

SIZE, END, ROWS, CHUNK, REST, SLACK = 2048, 2, 32, 8_000, 4_000, 16


class Rooms:
    """Open rows by room left, under a segment tree over the sizes 0 to size."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.tree = [0] * (2 * self.width)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, row: int) -> None:
        self.open[room].append(row)
        i = self.width + room
        while i:
            self.tree[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of at least need, and that room; it is taken out."""
        i, tree = self.width + need, self.tree
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):  # up to a right sibling with rows
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.width:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        room = i - self.width
        while i:
            tree[i] -= 1
            i >>= 1
        return self.open[room].pop(), room


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Indexes of the pieces of each row."""
    rooms, rows = Rooms(size), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        got = rooms.take(lengths[i])
        if got is None:
            got = len(rows), size
            rows.append([])
        rows[got[0]].append(i)
        if got[1] > lengths[i]:
            rooms.add(got[1] - lengths[i], got[0])
    return rows


SCHEMA = "matrix_id long, n_rows int, row_size int, n_tokens long, ids binary, positions binary, cu_seqlens array<array<int>>, doc_ids array<array<long>>, pieces array<array<int>>, starts array<array<long>>"
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.int64()))]
#: What is stored between the packings, small rows: packed id rows, and pieces that wait, without cu.
_STORED = "n_tokens long, ids binary, cu array<int>, doc_ids array<long>, pieces array<int>, starts array<long>"
_ROW = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]


def _batches(rows, types, schema):
    for a in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[a : a + 256]], t) for k, t in enumerate(types)], [f.split()[0] for f in schema.split(", ")])


def _filled(stock, size: int, slack: int | None):
    """Packed rows of the pieces (doc_id, piece, start, ids) and, unless slack is None, the pieces of rows with more room than slack."""
    out = []
    for members in best_fit_decreasing([len(s[3]) for s in stock], size):
        cum = np.cumsum([0, *(len(stock[i][3]) for i in members)]).tolist()
        if slack is not None and size - cum[-1] > slack:
            out += [(len(stock[i][3]), stock[i][3].tobytes(), None, [stock[i][0]], [stock[i][1]], [stock[i][2]]) for i in members]
        else:
            out.append((cum[-1], b"".join(stock[i][3].tobytes() for i in members), cum, *([stock[i][k] for i in members] for k in range(3))))
        if len(out) >= 256:
            yield from _batches(out, _ROW, _STORED)
            out = []
    yield from _batches(out, _ROW, _STORED)


def _assembled(size: int, end: int):
    """Matrices of up to ROWS packed rows of a task."""

    def matrix(rows, number):
        ids, positions = np.full((len(rows), size), end, "<u4"), np.zeros((len(rows), size), "<u4")
        for r, row in enumerate(rows):
            ids[r, : row["n_tokens"]] = np.frombuffer(row["ids"], "<u4")
            for a, b in zip(row["cu"], row["cu"][1:]):
                positions[r, a:b] = np.arange(b - a)
        of = [[row[c] for row in rows] for c in ("cu", "doc_ids", "pieces", "starts")]
        return (number, len(rows), size, sum(row["n_tokens"] for row in rows), ids.tobytes(), positions.tobytes(), *of)

    def run(batches):
        base, number, rows = TaskContext.get().partitionId() << 38, 0, []
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                rows += batch.slice(a, ROWS).to_pylist()
                if len(rows) >= ROWS:
                    yield from _batches([matrix(rows[:ROWS], base | number)], _TYPES, SCHEMA)
                    rows, number = rows[ROWS:], number + 1
        if rows:
            yield from _batches([matrix(rows, base | number)], _TYPES, SCHEMA)

    return run


def matrices(docs: DataFrame, path: str, size: int = SIZE, end: int = END, chunk: int = CHUNK, rest: int = REST) -> DataFrame:
    """Packed id matrices of every whole text, as SCHEMA."""

    def first(batches):
        encode, stock = encoder(path), []
        for batch in textops.slices(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                got = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                for p, (start, n) in enumerate(pieces(len(got), size)):
                    stock.append((doc, p, start, got[start : start + n].copy()))
                    if len(stock) >= chunk:
                        yield from _filled(stock, size, SLACK)
                        stock = []
        if stock:
            yield from _filled(stock, size, SLACK)

    def second(batches):
        stock, last = [], None
        for row in (row for batch in batches for a in range(0, batch.num_rows, 256) for row in batch.slice(a, 256).to_pylist()):
            if row["group"] != last and stock:
                yield from _filled(stock, size, None)
                stock = []
            last = row["group"]
            stock.append((row["doc_ids"][0], row["pieces"][0], row["starts"][0], np.frombuffer(row["ids"], "<u4")))
        if stock:
            yield from _filled(stock, size, None)

    done = written(plain(docs, "doc_id", "text").mapInArrow(first, _STORED))
    left = done.filter("cu IS NULL")
    groups = max(1, -(-left.count() // rest))
    # A row's group goes by its place, so repeated rows aren't one group.
    dealt = left.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    dealt = dealt.repartition("group").sortWithinPartitions("group", F.desc("n_tokens"), "ids")
    return done.filter("cu IS NOT NULL").unionByName(dealt.mapInArrow(second, _STORED)).mapInArrow(_assembled(size, end), SCHEMA)


def segments(packed: DataFrame) -> DataFrame:
    """(doc_id, piece, start, ids, positions) of each segment, read back from the matrices."""

    def run(batches):
        for batch in batches:
            for b in batch.to_pylist():
                ids, positions = (np.frombuffer(b[c], "<u4").reshape(b["n_rows"], -1) for c in ("ids", "positions"))
                rows = [(d, p, s, ids[r, lo:hi].tolist(), positions[r, lo:hi].tolist()) for r in range(b["n_rows"]) for d, p, s, lo, hi in zip(b["doc_ids"][r], b["pieces"][r], b["starts"][r], b["cu_seqlens"][r], b["cu_seqlens"][r][1:])]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(types)], ["doc_id", "piece", "start", "ids", "positions"])

    return packed.mapInArrow(run, "doc_id long, piece int, start long, ids array<long>, positions array<long>")
