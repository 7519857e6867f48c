"""Vectors in Arrow columns as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list column as rows of doubles; shorter ones are padded with zeros."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def finite(v: Column) -> Column:
    """Whether a vector is there and has finite components only; an empty one has."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(odd, F.lit(True))


def largest(v: Column) -> Column:
    """The largest magnitude among a vector's components; null for an empty one."""
    return F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
