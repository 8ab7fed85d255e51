"""Frames of byte streams that come in chunks, without any stream in one row.

Where a frame begins depends on all frames before it. So the chunks are laid into blocks of equal size,
each with as many bytes of what follows as the longest frame can have, and every block says for each place
that a frame could begin at where the chain of frames from there leaves the block. These steps compose over blocks by doubling; what is
reachable from a stream's first byte gives each block its true first frame, and the blocks are cut in parallel.

Most places begin no chain: an impossible id length or the stream's end stops it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.wire import OVERHEAD
from ..tables import forget, kept, reachable

MAX_ID = 1024
#: No frame is longer: header, id, checksum, and a payload whose length has two bytes.
LONGEST = OVERHEAD + MAX_ID + 65_535


def to_chunks(frames: DataFrame, stream: str, order: list[str], size: int, block: int = 1 << 12) -> DataFrame:
    """(stream, start, data): the frames of each stream one after the other, by order, cut into chunks of size bytes.

    Places are running sums in two levels: within blocks of the first order column (a number), and over the blocks, one row each.
    """
    rows = frames.select(F.col(stream).alias("stream"), *order, "frame", F.octet_length("frame").cast("long").alias("_n")).withColumn("_b", F.floor(F.col(order[0]) / block))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("stream", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = rows.groupBy("stream", "_b").agg(F.sum("_n").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("stream").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_in", inside).join(tops.select("stream", "_b", before.alias("_before")), ["stream", "_b"]).select("stream", "frame", "_n", (F.col("_in") + F.col("_before")).alias("_at"))
    placed = placed.withColumn("_c", F.explode(F.sequence(F.floor(F.col("_at") / size), F.floor((F.col("_at") + F.col("_n") - 1) / size))))
    a, e = F.greatest("_at", F.col("_c") * size), F.least(F.col("_at") + F.col("_n"), (F.col("_c") + 1) * size)
    piece = F.substring("frame", (a - F.col("_at") + 1).cast("int"), (e - a).cast("int"))
    parts = placed.select("stream", "_c", F.struct(a.alias("a"), F.hex(piece).alias("h")).alias("_p")).groupBy("stream", "_c").agg(F.array_sort(F.collect_list("_p")).alias("_p"))
    return parts.select("stream", (F.col("_c") * size).alias("start"), F.unhex(F.array_join(F.transform("_p", lambda p: p["h"]), "")).alias("data"))


def blocks(chunks: DataFrame, size: int = 1 << 20) -> DataFrame:
    """(stream, block, pieces) of chunks (stream, start, data): a block's bytes and LONGEST more, as (at, piece) in order; at most so many bytes in a row."""
    n, start = F.octet_length("data"), F.col("start")
    low = F.floor(F.greatest(start - LONGEST - size + 1, F.lit(0)) / size)
    rows = chunks.filter(n > 0).select("stream", "start", "data", F.explode(F.sequence(low, F.floor((start + n - 1) / size))).alias("block"))
    a, e = F.greatest(start, F.col("block") * size), F.least(start + n, (F.col("block") + 1) * size + LONGEST)
    piece = F.substring("data", (a - start + 1).cast("int"), (e - a).cast("int"))
    at = F.struct((a - F.col("block") * size).alias("at"), piece.alias("piece"))
    return rows.filter(a < e).groupBy("stream", "block").agg(F.array_sort(F.collect_list(at)).alias("pieces"))


def _joined(pieces: list[dict]) -> bytes:
    """The bytes from a block's beginning to the first hole; what comes twice counts once."""
    out = bytearray()
    for p in pieces:
        if p["at"] > len(out):
            break
        out += p["piece"][len(out) - p["at"] :]
    return bytes(out)


def next_frames(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, ends): the places below size at which a whole frame may stand, by the lengths alone, and where it would end."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    at = np.arange(max(0, min(size, len(b) - OVERHEAD + 1)))
    ids = b[at + 5] * 256 + b[at + 6]
    at, ids = at[ids <= MAX_ID], ids[ids <= MAX_ID]
    head = at + 7 + ids + 4
    fits = head + 2 <= len(b)
    at, head = at[fits], head[fits]
    end = head + 2 + b[head] * 256 + b[head + 1]
    return at[end <= len(b)], end[end <= len(b)]


def _steps(size: int):
    """mapInArrow over blocks: (stream, at, to) for each place that the frame before a block may end at and whose chain leaves the block."""

    def run(batches):
        for batch in batches:
            for s, block, pieces in zip(batch.column("stream"), batch.column("block").to_pylist(), batch.column("pieces").to_pylist()):
                at, to = next_frames(_joined(pieces), size)
                while len(at):
                    # Doubling: those that end inside go on from where they end; what stands at no frame's place is dropped.
                    inside = to < size
                    k = np.searchsorted(at, to[inside])
                    ok = (k < len(at)) & (at[np.minimum(k, len(at) - 1)] == to[inside])
                    if not inside.any():
                        break
                    far = to.copy()
                    far[inside] = np.where(ok, to[np.minimum(k, len(at) - 1)], -1)
                    at, to = at[far >= 0], far[far >= 0]
                enters = at < LONGEST
                at, to = at[enters] + block * size, to[enters] + block * size
                yield pa.RecordBatch.from_arrays([pa.array([s.as_py()] * len(at), s.type), pa.array(at), pa.array(to)], ["stream", "at", "to"])

    return run


def _cut(size: int):
    """mapInArrow over blocks with entry, the place of the first frame: (stream, at, frame) of the frames that begin in the block."""

    def run(batches):
        for batch in batches:
            for s, block, pieces, entry in zip(batch.column("stream"), *[batch.column(c).to_pylist() for c in ("block", "pieces", "entry")]):
                data, at, out = _joined(pieces), entry, []
                places, ends = next_frames(data, size)
                ends = dict(zip(places.tolist(), ends.tolist()))
                while at in ends:
                    out.append((block * size + at, data[at : ends[at]]))
                    at = ends[at]
                yield pa.RecordBatch.from_arrays([pa.array([s.as_py()] * len(out), s.type), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["stream", "at", "frame"])

    return run


def split_chunks(chunks: DataFrame, size: int = 1 << 20) -> DataFrame:
    """(stream, at, frame): the frames of chunks (stream, start, data), in which start is the place of a chunk's first byte in its stream.

    Chunks may have any lengths, come in any order and come twice. A stream ends before a frame that is cut off, at a missing chunk
    and at an impossible id length; what comes after has no known beginning. Chunks without a stream, start or data are left out.
    """
    kind = dict(chunks.dtypes)["stream"]
    laid = kept(blocks(chunks.filter("stream IS NOT NULL AND start IS NOT NULL AND data IS NOT NULL"), size))
    steps = kept(laid.mapInArrow(_steps(size), f"stream {kind}, at long, to long"))
    # Only where a chain begins or another ends.
    begins = laid.filter("block = 0").select("stream", F.lit(0).cast("long").alias("at"))
    ends = steps.select("stream", F.col("to").alias("at")).unionByName(begins).distinct()
    entries = reachable(steps.join(ends, ["stream", "at"], "left_semi"), begins, ["stream"])
    forget(steps)
    where = entries.select("stream", F.floor(F.col("at") / size).alias("block"), F.pmod("at", F.lit(size)).alias("entry"))
    return laid.join(where, ["stream", "block"]).select("stream", "block", "pieces", "entry").mapInArrow(_cut(size), f"stream {kind}, at long, frame binary")
