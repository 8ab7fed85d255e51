"""gzip of payloads, as functions over slices of Arrow batches (Spark has no built-in)."""

from __future__ import annotations

import gzip as _gz
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import slices


def inflate(data: bytes | None, limit: int = -1) -> tuple[bytes | None, str | None]:
    """All members of a gzip stream; (None, error) for empty or bad data, or more than limit bytes (negative: no limit)."""
    if not data:
        return None, "empty input"
    out, size = [], 0
    try:
        while data:
            z = zlib.decompressobj(31)
            part = z.decompress(data, 0 if limit < 0 else limit - size + 1)
            size += len(part)
            if 0 <= limit < size:
                return None, "larger than the limit"
            if not z.eof:
                return None, "truncated"
            out.append(part)
            data = z.unused_data
    except zlib.error as e:
        return None, f"bad gzip data: {e}"
    return b"".join(out), None


@F.arrow_udf(T.BinaryType())
def gzip(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for value in values:
        for i, n in slices(value):
            yield pa.array([None if v is None else _gz.compress(v, mtime=0) for v in value.slice(i, n).to_pylist()], pa.binary())


def gunzip(value: Column, limit: int = -1) -> Column:
    """Struct (value, error)."""

    @F.arrow_udf("value binary, error string")
    def run(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for value in values:
            for i, n in slices(value):
                out = [inflate(v, limit) for v in value.slice(i, n).to_pylist()]
                yield pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["value", "error"])

    return run(value)


def compress_if_longer(value: Column, threshold: int) -> tuple[Column, Column]:
    """(value, flagged): gzip where threshold is positive and the value is longer."""
    if threshold <= 0:
        return value, F.lit(False)
    long = F.octet_length(value) > threshold
    return F.when(long, gzip(F.when(long, value))).otherwise(value), long
