"""What the vector operators share: the rows that take part, and their components as whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of a unit that components are counted in.
UNIT = 1024


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is there and holds finite numbers only."""
    return rows.where(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def whole(column: pa.Array, dim: int, limit: int) -> np.ndarray:
    """floor(1024 * x) of vectors of `dim` components, row by row; what is beyond `limit` either way counts as `limit`."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), dim)
    return np.clip(np.floor(x * UNIT), -limit, limit).astype(np.int64)


def product_limit(dim: int) -> int:
    """The largest component for which an inner product of `dim` of them stays a 64-bit number."""
    return math.isqrt((1 << 62) // max(1, dim))
