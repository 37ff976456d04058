"""Vector columns: which are whole, and as matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_finite(vector: Column) -> Column:
    """True for vectors without a null, NaN or infinite entry; false for null vectors. An empty vector is finite."""
    entry = lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))  # noqa: E731  NaN is over infinity
    return F.coalesce(F.forall(vector, entry), F.lit(False))


def finite_vectors(rows: DataFrame, vector_col: str, **columns: Column) -> DataFrame:
    """`columns` and the array<double> `vector` of the rows whose vector is finite: whatever other columns are called, they can't clash."""
    vector = F.col(vector_col)
    return rows.where(is_finite(vector)).select(*[c.alias(name) for name, c in columns.items()], vector.cast("array<double>").alias("vector"))


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a list column without nulls as a matrix of `width` columns or, if some row is longer, of the longest one's length. Shorter rows are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(width, int(lengths.max(initial=0)))
    if len(values) == len(lengths) * width:
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), values.dtype)
    out[np.arange(width) < lengths[:, None]] = values
    return out
