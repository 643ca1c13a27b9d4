"""Vectors as integers, for the operators that need exact arithmetic."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(vector: str) -> Column:
    """True where a vector is there and all its components are numbers and finite."""
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))


def dimension(rows: DataFrame, vector: str) -> int:
    """The most components that a vector has; shorter ones count as followed by zeros."""
    return rows.agg(F.max(F.size(vector))).first()[0] or 0


def integers(column: pa.Array | pa.ChunkedArray, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, a row for each vector, zeros where a vector is shorter than dim.

    Of type int64 where values stay below 2^31 in size, else of Python's integers.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), dim), np.float64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    out = np.floor(out * scale)
    if not out.size or np.abs(out).max() < 1 << 31:
        return out.astype(np.int64)
    return np.array([[int(x) for x in row] for row in out], dtype=object)
