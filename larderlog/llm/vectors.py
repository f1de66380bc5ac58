"""Vector columns as numpy matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_entries(column: str, factor: int, below: float = 2.0**62) -> Column:
    """Whether a vector is not empty and ``factor`` times each of its entries is a finite number below ``below``.

    NaN is larger than every number here, so one comparison also refuses NaN and the infinities.
    """
    def whole(x: Column) -> Column:
        return F.coalesce(F.abs(x.cast("double") * factor) < F.lit(below), F.lit(False))

    return F.coalesce(F.forall(column, whole) & (F.size(column) > 0), F.lit(False))


def of_one_length(rows: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The rows whose vector has the length that most vectors have (the larger of equals), and that length."""
    most = rows.groupBy(F.size(column).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    length = most["d"] if most else 0
    return rows.where(F.size(column) == length), length


def matrix(vectors: pa.Array, length: int) -> np.ndarray:
    """(rows, length) of doubles."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), length)
