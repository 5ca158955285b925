"""Vectors as rows of whole numbers in numpy, and which rows of a table have one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """True where the vector is there and each of its components is a finite number."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~broken, F.lit(False))


def whole(vectors: pa.Array, scale: int, dim: int) -> np.ndarray:
    """floor(scale * x) of each component, at most 2**62 either way, one row a vector; shorter vectors end in zeros."""
    lengths = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
    flat = np.clip(np.floor(scale * np.asarray(vectors.flatten(), np.float64)), -(2.0**62), 2.0**62)
    out = np.zeros((len(lengths), dim), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out
