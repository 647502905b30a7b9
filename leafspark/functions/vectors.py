"""Expressions on vectors held as arrays, in float64."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def usable(a: Column) -> Column:
    """Neither null nor empty, without nulls and not finite values, and not all zero."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce((F.size(a) > 0) & finite & F.exists(a, lambda x: x != 0), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Null for unequal lengths and unusable vectors."""
    return F.when(usable(a) & usable(b) & (F.size(a) == F.size(b)), dot(a, b) / (norm(a) * norm(b)))


def cosine_normalized(a: Column, b: Column) -> Column:
    """Dot product of vectors of length one; null for unequal lengths."""
    return F.when(F.size(a) == F.size(b), dot(a, b))


def normalize(a: Column) -> Column:
    """The vector at length one, as floats; null for an unusable vector."""
    n = norm(a)
    return F.when(usable(a), F.transform(a, lambda x: (x.cast("double") / n).cast("float")))


def to_bytes(a: Column) -> Column:
    """Little-endian float32 bytes; null for a null vector. The batch's values are the buffer, nothing is done by row."""

    @F.arrow_udf("binary")
    def pack(v: pa.Array) -> pa.Array:
        at = v.offsets.to_numpy()
        flat = np.ascontiguousarray(v.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], "<f4")
        return pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer((4 * (at - at[0])).astype(np.int32)), pa.py_buffer(flat)])

    return F.when(a.isNotNull(), pack(F.coalesce(a.cast("array<float>"), F.array().cast("array<float>"))))


def from_bytes(b: Column) -> Column:
    """The vector of such bytes; null for null and for a length that is no multiple of four."""

    @F.arrow_udf("array<float>")
    def unpack(v: pa.Array) -> pa.Array:
        _, at, data = v.buffers()
        at = np.frombuffer(at, np.int32)[v.offset : v.offset + len(v) + 1]
        flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]].tobytes() if data is not None else b""
        return pa.ListArray.from_arrays(pa.array((at - at[0]) // 4, pa.int32()), pa.array(np.frombuffer(flat, "<f4"), pa.float32()))

    whole = b.isNotNull() & (F.length(b) % 4 == 0)
    return F.when(whole, unpack(F.when(whole, b).otherwise(F.lit(b""))))
