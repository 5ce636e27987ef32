"""Vectors as fixed-width binary cells, read and written without a copy per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def to_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A (rows, dim) float32 view of a binary column that holds dim floats in every row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, dim), np.float32)
    if pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.float32).reshape(-1, dim)


def to_binary(matrix: np.ndarray) -> pa.Array:
    """The binary column of a float32 matrix."""
    matrix = np.ascontiguousarray(matrix, np.float32)
    rows, width = matrix.shape[0], matrix.shape[1] * 4
    offsets = np.arange(rows + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(matrix)])


def valid_unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors) of the usable rows of an array<float> column.

    Null, empty, all-zero, non-finite, null-holding and not dim long vectors are left out.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(lengths == dim)
    if not len(rows):
        return rows, np.empty((0, dim), np.float32)
    values = column.take(pa.array(rows)).flatten().cast(pa.float64())
    flat = values.to_numpy(zero_copy_only=False).reshape(-1, dim)
    norm = np.sqrt((flat * flat).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], (flat[good] / norm[good, None]).astype(np.float32)
