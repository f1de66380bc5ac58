"""Best, newest and n-th row per key.

``row_number() <= k`` filtered right above the window lets Spark keep at most
``k`` rows per key in every map task before the shuffle, so a hot key costs the
shuffle ``k`` rows per task and no more.

Where the rows are wanted per key and then by folder, or a window needs all rows
of a key, they are counted first in spots of their key's hash: only rows of
crowded spots, where a hot key may be, take the way that hot keys need.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_rows(
    df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column], k: int = 1,
    rank: str | None = None,
) -> DataFrame:
    """First ``k`` rows of every key group in ``order``; NULL keys form one group."""
    name = rank or "_rank"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def latest_rows(
    df: DataFrame, keys: Sequence[Column | str], at: str = "captured_at", tie: Sequence[str] = ("id",)
) -> DataFrame:
    """Newest row per key; ties go to the highest ``tie`` columns."""
    return top_rows(df, keys, [F.desc_nulls_last(at), *[F.desc_nulls_last(t) for t in tie]])


def best_per_bucket(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    bucket_name: str = "bucket",
) -> DataFrame:
    """One row per (key, time bucket): the first in ``order``."""
    return top_rows(df.withColumn(bucket_name, bucket), [*keys, bucket_name], order)


def current_with_previous(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    previous: dict[str, str],
) -> DataFrame:
    """Newest bucket per key with chosen values of the bucket captured before it.

    ``previous`` maps source column -> output column.  Input has one row per
    (key, bucket).  Only two rows per key and map task reach the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(bucket).desc())
    two = top_rows(df, keys, [F.col(bucket).desc()], k=2, rank="_recency")
    for source, name in previous.items():
        two = two.withColumn(name, F.lead(source).over(w))
    return two.where("_recency = 1").drop("_recency")


#: Spots that rows are counted in, and the rows of a spot above which it may hold a hot key.
SPOTS, CROWDED = 1 << 14, 1_000_000
#: Rows of a folder that go to one task and file.
ROWS_A_PART = 500_000


def _spot(keys: Sequence[Column | str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SPOTS)).cast("int")


def crowded(df: DataFrame, keys: Sequence[Column | str]) -> Column | None:
    """Whether a row's key shares its spot with more than CROWDED rows; None if no key does.  Counts the keys."""
    counts = df.groupBy(_spot(keys).alias("_spot")).agg(F.count(F.lit(1)).alias("_n"))
    busy = [r["_spot"] for r in counts.where(F.col("_n") > CROWDED).collect()]
    return _spot(keys).isin(busy) if busy else None


def dealt(
    df: DataFrame, folder: Sequence[str], keys: Sequence[Column | str], reduce: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The rows with ``_part``, shuffled once by ``folder`` and ``_part``: a folder's rows of one key meet in one task.

    What follows per (``folder``, ``_part``, key) needs no other shuffle, and neither
    does writing by folder: a folder is cut into parts of about ROWS_A_PART rows.
    ``reduce`` leaves a key what it needs, with the same columns and as often as it
    is applied; rows of crowded keys pass it first, so a hot key costs the
    shuffle what is left of it per map task.
    """
    spots = df.select(*folder, _spot(keys).alias("_spot"))
    counts = spots.groupingSets([[F.col(c) for c in folder], [F.col("_spot")]], *folder, "_spot").agg(
        F.count(F.lit(1)).alias("_n"), F.grouping("_spot").alias("_by_folder")
    )
    found = counts.agg(
        F.max(F.when(F.col("_by_folder") == 1, F.col("_n"))).alias("most"),
        F.collect_set(F.when((F.col("_by_folder") == 0) & (F.col("_n") > CROWDED), F.col("_spot"))).alias("busy"),
    ).first()
    if found["busy"]:
        busy = _spot(keys).isin(found["busy"])
        df = df.where(~busy).unionByName(reduce(df.where(busy)).select(*df.columns))
    parts = max(1, -(-(found["most"] or 0) // ROWS_A_PART))
    return df.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).repartition(*folder, "_part")


def distinct_values(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    cols = [*by, column]
    return df.select(*cols).distinct().orderBy(*cols)
