"""Vectors as whole numbers, which the operators on integer distances and products share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole numbers beyond it (components beyond 65,536 at the scale of 256) count as it, so that no sum of squares or products leaves 64 bits.
LIMIT = 1 << 24
SCALE = 256


def whole(column: Column | str, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as an array of ints; null for vectors that are null or hold null or non-finite components."""
    values = (F.col(column) if isinstance(column, str) else column).cast("array<double>")
    usable = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    number = lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x * scale))).cast("int")
    return F.when(values.isNotNull() & usable, F.transform(values, number))


def kept(vectors: DataFrame, *columns: str | Column, scale: int = SCALE) -> DataFrame:
    """The columns named, and `whole` and its `size`, of the rows whose vector (`embedding`) is usable."""
    return vectors.select(*columns, whole("embedding", scale).alias("whole")).where(F.col("whole").isNotNull()).withColumn("size", F.size("whole"))


def matrix(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A row a list of width ints."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), width)
