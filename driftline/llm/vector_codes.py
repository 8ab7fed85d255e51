"""Vector code compression: codebooks of the parts of integer vectors, from weighted distinct parts.

Components become floor(SCALE * x); a vector is cut into PARTS equal parts. Parts
that are equal at one position are one weighted row from then on, so copies cost
nothing in the rounds of Lloyd's algorithm, which run over these rows: each
task sums the rows of each entry of the codebooks, the driver gets one row an entry.
At last the distinct parts get their code and error, and are joined back to the vectors.

A part that many vectors share is no hot key of that join: parts with more than one in
HEAVY of all vectors, at most HEAVY at each position, are told by a broadcast of
bounded size, and the rest is joined by a shuffle in which those rows are dealt by row.

Vectors that are null or hold null or non-finite components are dropped. The codes are
those of vectors as long as that of the smallest vec_id whose length is a positive
multiple of PARTS; other lengths come back with null code and error. Codebooks begin
with the smallest distinct vec_ids (the least vector, where an id has several; null is none);
fewer vectors make fewer entries. Repeated rows count and come back as often
as they occur. Components of 2^27 and more after scaling are refused with an error.
Without any vector to code, code, error and codebooks_sha256 are null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain, written
from .vectors import floors, pack, sound, squared, totals, unpack

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
HEAVY = 512


def _cut(parts: int, dim: int, scale: int):
    """mapInArrow: a row (rid, pos, part) for each part, vec_id and label with the first of a vector only."""

    def run(batches):
        for b in batches:
            n = b.num_rows
            z = floors(b.column("embedding"), scale, dim).reshape(n * parts, dim // parts)
            one = pa.array([i if p == 0 else None for i in range(n) for p in range(parts)], pa.int64())
            pos, rid = np.tile(np.arange(parts, dtype=np.int32), n), np.repeat(b.column("rid").to_numpy(), parts)
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(pos), pack(z), b.column("vec_id").take(one), b.column("label").take(one)], ["rid", "pos", "part", "vec_id", "label"])

    return run


def _nearest(pos: np.ndarray, z: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each part in the codebook of its position, ties to the lower index."""
    entry, error = np.zeros(len(z), np.int32), np.zeros(len(z), np.int64)
    for p in np.unique(pos):
        at = np.flatnonzero(pos == p)
        d = squared(z[at], books[p])
        entry[at] = d.argmin(axis=1)
        error[at] = d[np.arange(len(at)), entry[at]]
    return entry, error


def _summed(books: np.ndarray):
    """mapInArrow over weighted parts: (pos, entry, n, total) of each entry that this task has parts of."""
    k, width = books.shape[1:]

    def run(batches):
        n, total = np.zeros(len(books) * k, np.int64), np.zeros((len(books) * k, width), np.int64)
        for b in batches:
            pos, z = b.column("pos").to_numpy(), unpack(b.column("part"), width)
            keys, w, s = totals(pos * k + _nearest(pos, z, books)[0], z, b.column("weight").to_numpy())
            n[keys] += w
            total[keys] += s
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array((used // k).astype(np.int32)), pa.array((used % k).astype(np.int32)), pa.array(n[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["pos", "entry", "n", "total"])

    return run


def _coded(books: np.ndarray):
    """mapInArrow over weighted parts: their entry and error."""

    def run(batches):
        for b in batches:
            entry, error = _nearest(b.column("pos").to_numpy(), unpack(b.column("part"), books.shape[2]), books)
            yield pa.RecordBatch.from_arrays([b.column("pos"), b.column("part"), b.column("weight"), pa.array(entry), pa.array(error)], ["pos", "part", "weight", "entry", "error"])

    return run


def codebooks(distinct: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """books after the rounds of Lloyd's algorithm over distinct (pos, part, weight)."""
    width = books.shape[2]
    for _ in range(rounds):
        sums = distinct.mapInArrow(_summed(books), "pos int, entry int, n long, total array<long>")
        sums = sums.groupBy("pos", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)])
        books = books.copy()
        for r in sums.collect():  # at most one row an entry
            books[r.pos, r.entry] = [r[f"t{i}"] // r.n for i in range(width)]
    return books


def _seeds(rows: DataFrame, dim: int, entries: int, parts: int, scale: int) -> np.ndarray:
    ids = [r.vec_id for r in rows.select("vec_id").filter("vec_id IS NOT NULL").distinct().orderBy("vec_id").limit(entries).collect()]
    found = rows.filter(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("embedding").alias("v")).collect()
    v = pa.array([r.v for r in sorted(found, key=lambda r: r.vec_id)], pa.list_(pa.float64()))
    return floors(v, scale, dim).reshape(len(v), parts, dim // parts).transpose(1, 0, 2)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code array<int>, error) of each vector, and the codebooks [part, entry, component]."""
    rows = plain(vectors, "vec_id", "embedding", "label").filter(sound())
    fits = (F.size("embedding") > 0) & (F.size("embedding") % parts == 0)
    first = rows.filter(fits & F.col("vec_id").isNotNull()).agg(F.min(F.struct("vec_id", F.size("embedding").alias("dim"))).alias("f")).first().f
    none = [F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error")]
    if first is None:
        return rows.select("vec_id", "label", *none), None
    dim = first.dim
    kept = rows.filter(F.size("embedding") == dim)
    kinds = dict(rows.dtypes)
    cut = kept.withColumn("rid", F.monotonically_increasing_id()).select("rid", "embedding", "vec_id", "label").mapInArrow(_cut(parts, dim, scale), f"rid long, pos int, part binary, vec_id {kinds['vec_id']}, label {kinds['label']}")
    distinct = written(cut.groupBy("pos", "part").agg(F.count(F.lit(1)).alias("weight")))
    books = codebooks(distinct, _seeds(kept, dim, entries, parts, scale), rounds)
    coded = distinct.mapInArrow(_coded(books), "pos int, part binary, weight long, entry int, error long")
    n = distinct.filter("pos = 0").agg(F.sum("weight")).first()[0]
    heavy = F.col("weight") * HEAVY > n
    # At most HEAVY parts a position: the broadcast doesn't grow with the data.
    often = F.broadcast(coded.filter(heavy).select("pos", "part", F.col("entry").alias("_e"), F.col("error").alias("_d")))
    place = F.xxhash64("pos", "part")
    rest = coded.filter(~heavy).select(place.alias("_at"), "pos", "part", "entry", "error")
    told = cut.join(often, ["pos", "part"], "left")
    told = told.select("rid", "pos", "vec_id", "label", "_e", "_d", F.when(F.col("_e").isNull(), F.col("part")).alias("part"), F.when(F.col("_e").isNull(), place).otherwise(F.xxhash64("rid", "pos")).alias("_at"))
    each = told.join(rest, ["_at", "pos", "part"], "left").select("rid", "pos", "vec_id", "label", F.coalesce("_e", "entry").alias("entry"), F.coalesce("_d", "error").alias("error"))
    back = each.groupBy("rid").agg(F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), F.sum("error").alias("error"), *[F.max(F.when(F.col("pos") == p, F.col("entry"))).alias(f"_c{p}") for p in range(parts)])
    out = back.select("vec_id", "label", F.array(*[f"_c{p}" for p in range(parts)]).alias("code"), "error")
    return out.unionByName(rows.filter(F.size("embedding") != dim).select("vec_id", "label", *none)), books


def digests(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), the code as two hex digits a part."""
    coded, books = compress(vectors)
    text = None if books is None else hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    digits = F.array_join(F.transform("code", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")), "")
    rows = written(coded.select("vec_id", "label", digits.alias("code"), "error"))
    # Written first, so that Spark knows how large the sums are.
    sums = written(rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(text).cast("string").alias("codebooks_sha256"))
