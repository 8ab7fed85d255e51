"""Arrow batches in slices of bounded bytes, so that a worker holds one slice's Python objects at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a slice; a longer value is a slice of its own.
SLICE = 1 << 20


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """(start, length) of consecutive slices of a binary or string column that hold about limit bytes, 4,096 values at most."""
    size = np.r_[0, pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()]
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(size, size[i] + limit, "right")) - 1)
        j = min(j, i + 4096, len(column))
        yield i, j - i
        i = j
