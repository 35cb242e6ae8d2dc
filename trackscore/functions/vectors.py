"""Vector column helpers.

Higher-order SQL functions run interpreted, so work that touches every element
of a wide vector goes through Arrow batches and one NumPy expression per batch
(about seven times faster than ``aggregate(zip_with(...))`` at 64 dimensions).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def to_matrix(vectors: pa.Array) -> np.ndarray:
    """(rows, D) float64 view of a list array; a NULL row becomes NaN."""
    if len(vectors) == 0:
        return np.empty((0, 0))
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if vectors.null_count == 0:
        return flat.reshape(len(vectors), -1)
    present = vectors.is_valid().to_numpy(zero_copy_only=False)
    rows = flat.reshape(int(present.sum()), -1) if present.any() else np.empty((0, 1))
    matrix = np.full((len(vectors), rows.shape[1]), np.nan)
    matrix[present] = rows
    return matrix


def to_tensor(windows: pa.Array) -> np.ndarray:
    """(rows, L, D) float64 copy of an array-of-vectors column without NULLs."""
    n = len(windows)
    if n == 0:
        return np.empty((0, 0, 0))
    vectors = windows.flatten()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, len(vectors) // n, -1)


def from_tensor(values: np.ndarray) -> pa.Array:
    n, length, width = values.shape
    if n == 0:
        return pa.array([], pa.list_(pa.list_(pa.from_numpy_dtype(values.dtype))))
    inner = pa.ListArray.from_arrays(
        pa.array(np.arange(n * length + 1, dtype=np.int32) * width), pa.array(values.ravel())
    )
    return pa.ListArray.from_arrays(
        pa.array(np.arange(n + 1, dtype=np.int32) * length), inner
    )


def row_function(of_matrix: Callable[[np.ndarray], np.ndarray], column: str | Column) -> Column:
    """Apply a (rows, D) -> (rows,) NumPy function to a vector column; NULL stays NULL."""

    @F.arrow_udf("double")
    def compute(vectors: pa.Array) -> pa.Array:
        if len(vectors) == 0:
            return pa.array([], pa.float64())
        result = of_matrix(to_matrix(vectors))
        return pa.array(result, pa.float64(), mask=vectors.is_null().to_numpy(zero_copy_only=False))

    return compute(column)


def matrix_function(
    of_matrix: Callable[[np.ndarray], np.ndarray], column: str | Column
) -> Column:
    """Apply a (rows, D) -> (rows, K) NumPy function; the result is ARRAY<DOUBLE>."""

    @F.arrow_udf("array<double>")
    def compute(vectors: pa.Array) -> pa.Array:
        if len(vectors) == 0:
            return pa.array([], pa.list_(pa.float64()))
        result = np.ascontiguousarray(of_matrix(to_matrix(vectors)), dtype=np.float64)
        width = result.shape[1]
        offsets = pa.array(np.arange(len(result) + 1, dtype=np.int32) * width)
        lists = pa.ListArray.from_arrays(offsets, pa.array(result.ravel()))
        if vectors.null_count:
            keep = vectors.is_valid()
            lists = pa.compute.if_else(keep, lists, pa.scalar(None, lists.type))
        return lists

    return compute(column)


def constant(values: Sequence[float]) -> Column:
    """A literal ARRAY<DOUBLE>: fitted state of D numbers, never data-sized."""
    return F.lit([float(v) for v in values]).cast("array<double>")


def squared_distance(column: str | Column, center: Sequence[float]) -> Column:
    point = np.asarray(center, dtype=np.float64)
    return row_function(lambda x: np.square(x - point).sum(axis=1), column)


def zeros(dim: int, kind: str = "float") -> Column:
    return F.array_repeat(F.lit(0.0).cast(kind), dim)
