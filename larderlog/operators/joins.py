"""Joins on keys that may be NULL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def same_key_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi join where NULL equals NULL; the key columns of the left side survive.

    Stays a hash or merge join: Spark turns ``<=>`` into equi-join keys.
    """
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    )
    out = left.join(renamed, condition, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_r_{k}" for k in keys])


def keep_known(df: DataFrame, column: str, known: DataFrame, known_column: str) -> DataFrame:
    """NULL out a reference to an unknown parent, keep the row."""
    ids = known.select(F.col(known_column).alias("_known")).distinct()
    return (
        df.join(ids, F.col(column) == F.col("_known"), "left")
        .withColumn(column, F.col("_known"))
        .drop("_known")
    )
