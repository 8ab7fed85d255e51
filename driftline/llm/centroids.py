"""Centroid clustering by exact integers, with bounds in the manner of Elkan.

Each vector keeps an upper bound of its distance to its centroid and a lower bound to
each of the k centroids, in a table that each round reads and writes anew. When
centroids move, bounds move with them. A centroid's distance is computed only where neither
its lower bound nor half its distance from the vector's own centroid exceeds the
upper bound. Bounds are rounded away from the truth, and only what is strictly farther
is skipped, so ties are always compared: by exact squared distances, to the smaller number.

A round is a pass over the rows; sums of components meet as one row a task and
centroid. Nothing but k centroids reaches the driver, and nothing is dealt by cluster.

Vectors that are null, of another length than DIM, or with null or non-finite components are
left out. Seeds are the K vectors with the least hash of their vec_id (then the least
vector; a null vec_id is no seed); fewer vectors make fewer centroids. Repeated rows count and come
back as often as they occur. Components of 2^27 and more after scaling are refused with an
error. An empty table, or one without a seed, gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SCRATCH, plain, release, written
from .vectors import floors, pack, sound, squared, totals, unpack

SCALE, DIM, K, ROUNDS, SALT = 256, 64, 40, 5, "2:"
#: Covers the rounding of a root and of a sum of doubles.
_EDGE = 2.0**-50


def _up(x):
    return x * (1 + _EDGE)


def _down(x):
    return x * (1 - _EDGE)


def _root_up(d2) -> np.ndarray:
    return _up(np.sqrt(np.asarray(d2, np.float64)))


def _root_down(d2) -> np.ndarray:
    return _down(np.sqrt(np.asarray(d2, np.float64)))


def _float_down(x: np.ndarray) -> np.ndarray:
    """The greatest 32-bit floats that aren't above x."""
    f = x.astype(np.float32)
    return np.where(f.astype(np.float64) > x, np.nextafter(f, np.float32(-np.inf)), f)


class Move:
    """What a round needs to know of its centroids: how far each has come since the last round, and half their distances."""

    def __init__(self, centres: np.ndarray, before: np.ndarray | None = None):
        self.centres, self.k = centres, len(centres)
        self.moved = np.zeros(self.k) if before is None else _root_up(((centres - before) ** 2).sum(axis=1))
        self.half = _root_down(squared(centres, centres)) / 2


def assign(z: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, move: Move) -> int:
    """Brings own, upper and lower (in place) to this round's centroids; returns how many distances were computed."""
    upper[:] = _up(upper + move.moved[own])
    lower[:] = np.maximum(0, _down(lower - move.moved))

    def open_to(j, rows):
        return (lower[rows, j] <= upper[rows]) & (move.half[own[rows], j] <= upper[rows]) & (own[rows] != j)

    all_rows = np.arange(len(z))
    rows = np.flatnonzero(np.logical_or.reduce([open_to(j, all_rows) for j in range(move.k)])) if len(z) else all_rows
    # Those that a bound can't settle first learn the distance to their own centroid.
    d = z[rows] - move.centres[own[rows]]
    best = np.zeros(len(z), np.int64)
    best[rows] = np.einsum("ij,ij->i", d, d)
    upper[rows], lower[rows, own[rows]] = _root_up(best[rows]), _root_down(best[rows])
    done = len(rows)
    for j in range(move.k):
        at = rows[open_to(j, rows)]
        if not len(at):
            continue
        d = z[at] - move.centres[j]
        d2 = np.einsum("ij,ij->i", d, d)
        lower[at, j] = _root_down(d2)
        done += len(at)
        nearer = at[better := (d2 < best[at]) | (d2 == best[at]) & (j < own[at])]
        own[nearer], best[nearer] = j, d2[better]
        upper[nearer] = _root_up(d2[better])
    return done


STATE = "z binary, cluster int, upper double, lower binary"


def _first(scale: int, dim: int, k: int):
    """mapInArrow: vectors without any knowledge of distances."""

    def run(batches):
        for b in batches:
            n = b.num_rows
            cols = [b.column("vec_id"), pack(floors(b.column("embedding"), scale, dim)), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, np.inf)), pa.array([bytes(4 * k)] * n, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "z", "cluster", "upper", "lower"])

    return run


def _round(move: Move, dim: int):
    def run(batches):
        for b in batches:
            z, own, upper = unpack(b.column("z"), dim), b.column("cluster").to_numpy().copy(), b.column("upper").to_numpy().copy()
            lower = np.frombuffer(b"".join(b.column("lower").to_pylist()), "<f4").astype(np.float64).reshape(-1, move.k)
            assign(z, own, upper, lower, move)
            kept = _float_down(lower).astype("<f4")
            cols = [b.column("vec_id"), b.column("z"), pa.array(own), pa.array(upper), pa.array([row.tobytes() for row in kept], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "z", "cluster", "upper", "lower"])

    return run


def _summed(k: int, dim: int):
    """mapInArrow: (cluster, n, total) of each cluster that this task has vectors of."""

    def run(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            z = unpack(b.column("z"), dim)
            keys, w, s = totals(b.column("cluster").to_numpy(), z, np.ones(len(z), np.int64))
            n[keys] += w
            total[keys] += s
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    return run


def _distances(centres: np.ndarray):
    def run(batches):
        for b in batches:
            d = unpack(b.column("z"), centres.shape[1]) - centres[b.column("cluster").to_numpy()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("cluster"), pa.array(np.einsum("ij,ij->i", d, d))], ["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, salt: str = SALT) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each vector, and the final centroids."""
    spark = vectors.sparkSession
    rows = plain(vectors, "vec_id", "embedding").filter(sound() & (F.size("embedding") == dim))
    kind = dict(rows.dtypes)["vec_id"]
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    seeds = rows.filter("vec_id IS NOT NULL").select(order.alias("h"), "vec_id", "embedding").orderBy("h", "vec_id", "embedding").limit(k).collect()
    result = f"vec_id {kind}, cluster int, distance long"
    if not seeds:
        return spark.createDataFrame([], result), np.zeros((0, dim), np.int64)
    centres = floors(pa.array([r.embedding for r in seeds], pa.list_(pa.float64())), scale, dim)
    state, move, old = rows.mapInArrow(_first(scale, dim, len(centres)), f"vec_id {kind}, {STATE}"), Move(centres), []
    for r in range(rounds + 1):
        state = written(state.mapInArrow(_round(move, dim), f"vec_id {kind}, {STATE}"))
        if old:
            release(spark, old)  # the round before is read no more
        old = SCRATCH[-1:]
        if r == rounds:
            break
        sums = state.select("z", "cluster").mapInArrow(_summed(len(centres), dim), "cluster int, n long, total array<long>")
        sums = sums.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dim)])
        before, centres = centres, centres.copy()
        for s in sums.collect():  # at most k rows
            centres[s.cluster] = [s[f"t{i}"] // s.n for i in range(dim)]
        move = Move(centres, before)
    return state.select("vec_id", "z", "cluster").mapInArrow(_distances(centres), result), centres


def digests(vectors: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    found, centres = cluster(vectors)
    rows = written(found)
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most k rows
    of = [(j, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centres[j].tolist())).encode()).hexdigest()) for j, s in sums.items()]
    info = rows.sparkSession.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(info), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
