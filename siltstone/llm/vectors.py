"""Vectors of Arrow list columns as numpy matrices, and back as packed rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, width) doubles, short vectors ended by zeros, and which rows are vectors.

    No vector: null, or with null or non-finite components. An empty list is the zero vector.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    good = ~np.asarray(column.is_null())
    lengths = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    values = np.asarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    good[row[~np.isfinite(values)]] = False
    out = np.zeros((len(lengths), int(lengths.max(initial=1)) or 1))
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.where(np.isfinite(values), values, 0)
    return out, good


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.concatenate([x, np.zeros((len(x), width - x.shape[1]), x.dtype)], axis=1)
