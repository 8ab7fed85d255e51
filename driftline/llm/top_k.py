"""Exact top-k by inner product, by no-random-access aggregation over sorted lists.

Each component is a list of a block's candidates, sorted once; a query with a
positive component reads it from its greatest values down, one with a negative
component from its least values up, so the parts of the score fall as it reads.
The lists are read side by side, STEPS of their length at a time. From what was
read alone come bounds: a candidate's lower bound adds the list's last value for each list
that hasn't shown it yet, its upper bound adds the value last read there. The
search stops when at most FEW candidates have an upper bound that reaches the k-th
lower bound: no outsider, seen or not, can qualify. Those few get their final scores, by which
they are ranked, ties to the smaller id. A query that stops reads no further; in
vectors without structure hardly any stops before the end, which gives all scores.

Queries and candidates are dealt to chunks of bounded size; each pair of chunks is a
unit of work with a key of its own, and per query only k of a chunk's candidates go on.

Vectors that are null or hold null or non-finite components take no part;
vectors of different lengths aren't compared. Rows with a null vec_id take no
part. Repeated rows count as often as they occur; rows with the query's own id
are no candidates. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import plain

K, EVERY, SCALE = 20, 20, 64
#: Rows of a chunk of queries and of candidates; how far the steps read; candidates that are resolved.
QUERIES, CANDIDATES, STEPS, FEW = 1024, 8192, (0.25, 0.5, 1.0), 64
#: Queries that read at the same time.
_TURN = 256


def _blocks(rows: int):
    """mapInArrow: (chunk, dim, ids, vectors) of up to rows vectors of one length from sorted rows, vectors as floors of 64 x, in 16 bits where they fit."""

    def run(batches):
        held, key = [], None

        def emit():
            ids, vectors = zip(*held)
            z = np.array(vectors, np.int64).reshape(len(ids), -1)
            small = not z.size or (z.min() >= -(1 << 15) and z.max() < 1 << 15)
            data = z.astype("<i2" if small else "<i8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((key[0], pa.int32()), (key[1], pa.int32()), (np.array(ids, "<i8").tobytes(), pa.binary()), (data, pa.binary()))], ["chunk", "dim", "ids", "vectors"])

        for batch in batches:
            for chunk, i, v in zip(batch.column("chunk").to_pylist(), batch.column("vec_id").to_pylist(), batch.column("embedding").to_numpy(zero_copy_only=False)):
                if held and (key != (chunk, len(v)) or len(held) >= rows):
                    yield emit()
                    held = []
                key = chunk, len(v)
                held.append((i, np.floor(SCALE * np.asarray(v, np.float64)).astype(np.int64)))
        if held:
            yield emit()

    return run


def _exact(q: np.ndarray, c: np.ndarray):
    """The type in which every sum of products is exact; 64-bit integers for the largest."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    return next((kind for bound, kind in ((2**23, np.float32), (2**52, np.float64)) if top < bound), np.int64)


class Lists:
    """The sorted lists of a block of candidates, one for each component and direction."""

    def __init__(self, ids: np.ndarray, c: np.ndarray, kind):
        self.ids, self.c, self.n = ids, c.astype(kind), len(ids)
        order = np.argsort(c, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.c, order, axis=0)
        self.place = np.empty_like(order)  # in the list read upwards; downwards it is the mirrored place
        np.put_along_axis(self.place, order, np.arange(self.n)[:, None], axis=0)

    def step(self, a: int, b: int) -> np.ndarray:
        """The values that the places a to b - 1 of all lists show, downwards and upwards, 0 elsewhere."""
        down, up = self.n - 1 - self.place, self.place
        return np.concatenate([np.where((x >= a) & (x < b), self.c, 0) for x in (down, up)], axis=1)

    def seen(self, b: int) -> np.ndarray:
        down, up = self.n - 1 - self.place, self.place
        return np.concatenate([down < b, up < b], axis=1).astype(self.c.dtype)

    def at(self, b: int) -> np.ndarray:
        """The value that was read last in each list, after b places."""
        return np.concatenate([self.sorted[self.n - b], self.sorted[b - 1]])


def search(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int = K, steps=STEPS) -> tuple[list[tuple[int, int, int]], int]:
    """(query, candidate, score) of each query's k best candidates of the block, by no-random-access aggregation; number of list entries that were read."""
    if not len(cid) or not len(qid):
        return [], 0
    kind = _exact(q, c)
    lists, least = Lists(cid, c, kind), np.iinfo(np.int64).min // 4 if kind is np.int64 else -np.inf
    ends = sorted({max(1, int(np.ceil(x * len(cid)))) for x in steps} | {len(cid)})
    shown, last, out, reads = [], lists.at(len(cid)), [], 0

    def steps_read():
        """What each step shows; the lists are read as far as some query has come, once for all."""
        for k, (a, b) in enumerate(zip([0, *ends], ends)):
            if k == len(shown):
                shown.append((b, lists.step(a, b), lists.seen(b), lists.at(b)))
            yield shown[k]

    def ranked(i, some, scores):
        best = np.lexsort((cid[some], -scores))[:k]
        out.extend((int(qid[i]), int(cid[some[b]]), int(scores[b])) for b in best)

    for lo in range(0, len(qid), _TURN):
        turn = np.arange(lo, min(lo + _TURN, len(qid)))
        both = np.concatenate([np.maximum(q[turn], 0), np.minimum(q[turn], 0)], axis=1).astype(kind)
        part, before = np.zeros((len(turn), len(cid)), kind), 0
        for b, values, seen, now in steps_read():
            part += both @ values.T
            reads += len(turn) * q.shape[1] * (b - before)
            before = b
            if b == len(cid):
                break
            own = cid == qid[turn][:, None]
            floor = both * last
            lower = np.where(own, least, part + floor.sum(axis=1)[:, None] - floor @ seen.T)
            kth = np.partition(lower, len(cid) - k, axis=1)[:, len(cid) - k] if len(cid) >= k else np.full(len(turn), least, kind)
            roof = both * now
            maybe = np.flatnonzero(kth > roof.sum(axis=1))  # else a candidate that no list has shown may qualify
            if not len(maybe):
                continue
            upper = np.where(own[maybe], least, part[maybe] + roof[maybe].sum(axis=1)[:, None] - roof[maybe] @ seen.T)
            able = upper >= kth[maybe, None]
            stop = able.sum(axis=1) <= FEW
            for m, row in zip(maybe[stop], able[stop]):
                some = np.flatnonzero(row)
                ranked(turn[m], some, c[some] @ q[turn[m]])
            stay = np.ones(len(turn), bool)
            stay[maybe[stop]] = False
            turn, both, part = turn[stay], both[stay], part[stay]
            if not len(turn):
                break
        for i, row in zip(turn, part):
            some = np.flatnonzero(cid != qid[i])
            if len(some) > k:
                some = some[row[some] >= np.partition(row[some], len(some) - k)[len(some) - k]]
            ranked(i, some, row[some].astype(np.int64))
    return out, reads


def _searched(batches):
    def vectors(b, s):
        ids = np.frombuffer(b[f"{s}_ids"], "<i8")
        data = b[f"{s}_vectors"]
        wide = b["dim"] and len(data) // (len(ids) * b["dim"]) == 8
        return ids, np.frombuffer(data, "<i8" if wide else "<i2").astype(np.int64).reshape(len(ids), b["dim"])

    for batch in batches:
        rows = []
        for b in batch.to_pylist():
            rows += search(*vectors(b, "q"), *vectors(b, "c"))[0]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): queries are the rows whose vec_id is divisible by EVERY."""
    # x - x is null or NaN for a null, NaN or infinite x, so one aggregate tells them all.
    sound = F.expr("vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    rows = plain(vectors, "vec_id", "embedding").filter(sound)
    asked = rows.filter(F.col("vec_id") % EVERY == 0)
    n_all, n_asked = rows.count(), asked.count()

    def chunks(df, n, size, s):
        """(<s>, dim, <s>_ids, <s>_vectors): about n rows in chunks of size; a row's chunk goes by its place, so equal ids aren't one chunk."""
        many = max(1, -(-n // size))
        dealt = df.withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(many)).cast("int")).repartition("chunk")
        blocks = dealt.sortWithinPartitions("chunk", F.size("embedding")).mapInArrow(_blocks(size), "chunk int, dim int, ids binary, vectors binary")
        return blocks.select(F.col("chunk").alias(s), "dim", F.col("ids").alias(f"{s}_ids"), F.col("vectors").alias(f"{s}_vectors")), many

    q, n_q = chunks(asked, n_asked, QUERIES, "q")
    c, n_c = chunks(rows, n_all, CANDIDATES, "c")
    # A grid: each chunk of queries is sent to each chunk of candidates, under the key of the pair.
    q = q.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    c = c.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    found = q.join(c, ["q", "c", "dim"]).select("dim", "q_ids", "q_vectors", "c_ids", "c_vectors").mapInArrow(_searched, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
