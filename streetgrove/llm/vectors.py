"""Vectors of integers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components up to this number: squared distances of up to 64 of them fit a long.
LARGEST = 1 << 27


def sound(vector: Column) -> Column:
    """No null vector, no null, NaN or infinite component."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, computed in double; a component beyond ``LARGEST`` stops the job."""

    def one(x: Column) -> Column:
        scaled = F.floor(x.cast("double") * F.lit(float(scale)))
        message = F.lit("a component is too large: squared distances would not fit a long")
        return F.when(F.abs(x.cast("double")) > float(LARGEST) / scale, F.raise_error(message).cast("long")).otherwise(scaled)

    return F.transform(vector, one)


def matrix(column: pa.Array, width: int, kind: type = np.int64) -> np.ndarray:
    """Rows of a list column of equal length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def nested(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column, one list a row of ``values``."""
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(values.reshape(-1), kind))


def floor_mean(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """floor(sum / count) by row."""
    return sums // counts[:, None]


def grouped_sums(partial: DataFrame, keys: list[str], values: list[str]) -> list:
    """Sums of ``values`` by ``keys``, to the driver; the keys are entries of a codebook or centroids, whose number is a parameter."""
    return partial.groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values)).collect()
