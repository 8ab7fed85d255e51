"""Best-fit packing by minimum bin slack, of token pieces into fixed-length sequences.

Each sequence starts with the longest piece left; a subset-sum dynamic program
over the lengths left, a bitset of reachable sums, then finds the fullest
combination that fits beside it, and those pieces are removed.

Tasks pack what they read, CHUNK pieces at a time, and settle only the sequences
that are full to the last token. All other pieces of the table go on to a second
packing in groups of REST pieces, so the number of sequences hardly depends on how the
table is split; only the last few sequences of a group may have slack. Sequence
numbers hold the task's partition, the chunk and a counter, or the group and a counter.

Null and empty texts have the end token alone. A row with null doc_id is packed
like any other; repeated rows are packed again; an empty table packs nothing.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import plain, written
from .tokens import encoder, pieces

SIZE, END, CHUNK, REST = 1024, 2, 60_000, 20_000


def fullest(stock: dict[int, int], room: int) -> list[int]:
    """Lengths from the stock {length: count} whose sum is the greatest that is at most room."""
    reach, mask, steps = 1, (1 << room + 1) - 1, []
    full = 1 << room
    for length in sorted((n for n in stock if 0 < n <= room), reverse=True):
        left, take = min(stock[length], room // length), 1
        while left > 0:  # counts by binary splitting
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left -= take
            take *= 2
        if reach & full:
            break
    total, out = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            out += [length] * take
            total -= length * take
    return out


def pack(lengths: list[int], size: int) -> list[list[int]]:
    """Indexes of the pieces in each sequence, by minimum bin slack."""
    by = defaultdict(list)
    for i, n in enumerate(lengths):
        by[n].append(i)
    stock = {n: len(v) for n, v in by.items()}
    out = []
    for longest in sorted(by, reverse=True):
        while stock.get(longest):
            stock[longest] -= 1
            chosen = [longest]
            for n in fullest(stock, size - longest) if longest < size else ():
                stock[n] -= 1
                chosen.append(n)
            out.append([by[n].pop() for n in chosen])
            for n in {*chosen}:
                if not stock[n]:
                    del stock[n]
    return out


_FIELDS = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def _numbered(rows, size, base, full):
    """Sets sequence and offset of rows [doc_id, piece, start, length, crc, sequence, offset, ...]; if full, only in sequences without slack."""
    for k, members in enumerate(pack([r[3] for r in rows], size)):
        if full and sum(rows[i][3] for i in members) < size:
            continue
        at = 0
        for i in members:
            rows[i][5:7] = base + k, at
            at += rows[i][3]
    return rows


def packed(docs: DataFrame, path: str, size: int = SIZE, end: int = END, chunk: int = CHUNK, rest: int = REST, ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, unless ids=False, the ids as little-endian unsigned 32-bit binary."""
    fields = _FIELDS + [("ids", pa.binary())] * ids
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * ids

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])

    def first(batches):
        encode, part = encoder(path), TaskContext.get().partitionId()
        rows, number = [], 0
        for batch in textops.slices(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                got = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                for p, (start, n) in enumerate(pieces(len(got), size)):
                    data = got[start : start + n].tobytes()
                    rows.append([doc, p, start, n, zlib.crc32(data), None, None, data])
                    if len(rows) >= chunk:
                        yield batch_of(_numbered(rows, size, part << 38 | number << 18, True))
                        rows, number = [], number + 1
        if rows:
            yield batch_of(_numbered(rows, size, part << 38 | number << 18, True))

    def second(batches):
        rows, last = [], None
        for batch in batches:
            cols = [batch.column(n).to_pylist() for n, _ in fields]
            for group, row in zip(batch.column("group").to_pylist(), zip(*cols)):
                if group != last and rows:
                    yield batch_of(_numbered(rows, size, 1 << 62 | last << 18, False))
                    rows = []
                rows.append([*row])
                last = group
        if rows:
            yield batch_of(_numbered(rows, size, 1 << 62 | last << 18, False))

    done = written(plain(docs, "doc_id", "text").mapInArrow(first, kinds))
    left = done.filter("sequence_id IS NULL")
    groups = max(1, -(-left.count() // rest))
    names = [n for n, _ in fields]
    dealt = left.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)))
    dealt = dealt.repartition("group").sortWithinPartitions("group", F.desc("length"), "doc_id", "piece", "ids_crc32")
    return done.filter("sequence_id IS NOT NULL").union(dealt.mapInArrow(second, kinds).select(*names))
