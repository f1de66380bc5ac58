"""Exact ranks per key for keys of any size.

A plain ``row_number()`` sends all rows of a key to one task, and a deep page all
rows before it.  Here rows are dealt to cells by sampled bounds of (key, order); the
rows per cell, added up along a key, give the rank at which each cell begins, and rows are
sorted and numbered inside the cells that a page meets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import settle
from .joins import same_key_join

ROWS_PER_CELL = 500_000


def ranked_between(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], low: int, high: int, cells: int | None = None, rank: str = "rank"
) -> DataFrame:
    """Rows whose number per key in ``order`` is above ``low`` and at most ``high``; NULL keys form one group.

    ``order`` must be total within a key.  The dealt rows are written once, so that
    counts and ranks see the same cells.  ``cells`` follows from the number of rows if it is not given;
    it does not change the result.
    """
    if cells is None:
        df = settle(df, "unranked")
        cells = max(1, -(-df.count() // ROWS_PER_CELL))
    dealt = df.repartitionByRange(cells, *[F.asc_nulls_first(k) for k in keys], *order)
    dealt = settle(dealt.withColumn("_cell", F.spark_partition_id()), "ranked")
    along = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(along), F.lit(0)))
    met = sizes.where((F.col("_before") < high) & (F.col("_before") + F.col("_n") > low)).drop("_n")
    near = same_key_join(dealt, met, [*keys, "_cell"])
    inside = F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy(*order))
    numbered = near.withColumn(rank, (F.col("_before") + inside).cast("int"))
    return numbered.where((F.col(rank) > low) & (F.col(rank) <= high)).select(*df.columns, rank)
