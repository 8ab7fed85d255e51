"""Vectors as exact integers: floors of a multiple of each component, packed to bytes for keys and tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

#: Components of a magnitude from here on are refused: squared distances might not fit 64 bits.
LIMIT = 1 << 27


def sound(column: str = "embedding"):
    """Whether a vector is there and holds neither null nor non-finite components."""
    # x - x is no number for an infinite or non-number x.
    return F.expr(f"{column} IS NOT NULL AND forall({column}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")


def floors(vectors: pa.Array, scale: int, dim: int) -> np.ndarray:
    """floor(scale * x) of the components of a list array whose lists all have dim entries."""
    z = np.floor(scale * np.asarray(vectors.flatten(), np.float64))
    if z.size and np.abs(z).max() >= LIMIT:
        raise OverflowError(f"components of {LIMIT} and more after scaling have no exact distances")
    return z.astype(np.int64).reshape(-1, dim)


def pack(z: np.ndarray) -> pa.Array:
    """Each row as bytes, with 16 bits a component where all of the row's fit and 64 otherwise: equal rows, equal bytes."""
    small = ((z >= -(1 << 15)) & (z < 1 << 15)).all(axis=1)
    if small.all():
        ends = np.arange(len(z) + 1, dtype=np.int32) * (2 * z.shape[1])
        return pa.Array.from_buffers(pa.binary(), len(z), [None, pa.py_buffer(ends), pa.py_buffer(z.astype("<i2").tobytes())])
    return pa.array([row.astype("<i2" if s else "<i8").tobytes() for row, s in zip(z, small)], pa.binary())


def unpack(packed: pa.Array, dim: int) -> np.ndarray:
    rows = packed.to_pylist()
    if all(len(r) == 2 * dim for r in rows):
        return np.frombuffer(b"".join(rows), "<i2").astype(np.int64).reshape(-1, dim)
    return np.array([np.frombuffer(r, "<i2" if len(r) == 2 * dim else "<i8") for r in rows], np.int64).reshape(-1, dim)


def squared(z: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centres."""
    out = np.zeros((len(z), len(centres)), np.int64)
    for j, c in enumerate(centres):
        d = z - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def totals(keys: np.ndarray, z: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, weight of each, weighted sums of the rows of each)."""
    if not len(keys):
        return keys, weight, z
    if float(np.abs(z).max()) * float(weight.sum()) >= 2.0**62:
        raise OverflowError("sums of components don't fit 64 bits")
    order = np.argsort(keys, kind="stable")
    found, at = np.unique(keys[order], return_index=True)
    return found, np.add.reduceat(weight[order], at), np.add.reduceat((z * weight[:, None])[order], at, axis=0)
