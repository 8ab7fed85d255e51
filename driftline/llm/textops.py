"""Numpy text primitives shared by the operators: words, hashes, shingles.

Everything works on UTF-8 bytes of a whole Arrow batch. Words are maximal runs
of bytes other than 0x20 and 0x09-0x0D; A-Z are lowered by table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled by one numpy pass; temporary arrays take about 40 times as much.
SEGMENT = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240607))
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_CODE = _CODE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_GRAM = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and odd multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, and row offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the word offsets of the rows."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    solid = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, at)


def prefix_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INV, np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = prefix_powers(n)
    return _POWERS[0], _POWERS[1]


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word's bytes, by differences of prefix sums, segment by segment."""
    out, code, i = np.empty(len(start), np.uint64), _LOWER_CODE if lower else _CODE, 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SEGMENT, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        up, down = _powers(max(hi - lo + 1, SEGMENT))
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(code[raw[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive word hashes (len - k + 1 of them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * _GRAM[j]
    return mix(out)


def shingle_sets(column, k: int = 5) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word shingles; with fewer words the whole sequence is the one shingle; none without words."""
    raw, at = utf8(column)
    start, end, row = words(raw, at)
    hashes = word_hashes(raw, start, end)
    every = grams(hashes, k)
    for a, b in zip(row[:-1].tolist(), row[1:].tolist()):
        if b - a >= k:
            yield np.unique(every[a : b - k + 1])
        elif b > a:
            yield mix(grams(hashes[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def slices(batches, limit: int = 2 << 20):
    """Record batches cut so that column 'text' of each holds about limit bytes at most (a longer row comes alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).cumsum()
        i = 0
        while i < batch.num_rows:
            before = size[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(size, before + limit, "right")))
            yield batch.slice(i, j - i)
            i = j
