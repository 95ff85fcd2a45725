"""Embeddings as matrices of unit rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

EDGE = 2e-6  # more than 32-bit scores can be wrong by


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return flat.reshape(len(column), -1).astype(np.float32, copy=False)


def unit(x: np.ndarray) -> np.ndarray:
    """Unit rows; scaled before squaring, as components may be huge or tiny."""
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
