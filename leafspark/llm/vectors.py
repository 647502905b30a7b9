"""Reading vector columns as matrices inside Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are usable, their unit vectors): usable vectors have the width, are finite and not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    if not n:
        return np.zeros(0, np.int64), np.zeros((0, width))
    offsets = column.offsets.to_numpy()
    good = (np.diff(offsets) == width) & ~column.is_null().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(good)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat[offsets[:-1][rows][:, None] + np.arange(width)] if len(rows) else np.zeros((0, width))
    with np.errstate(all="ignore"):
        finite = np.isfinite(x).all(axis=1)
        x = np.where(finite[:, None], x, 0.0)
        scale = np.abs(x).max(axis=1, initial=0.0)
        use = finite & (scale > 0)
        x = x[use] / scale[use][:, None]
    return rows[use], x / np.linalg.norm(x, axis=1, keepdims=True)


def binary_rows(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The float32 rows that a binary column holds."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), width)
