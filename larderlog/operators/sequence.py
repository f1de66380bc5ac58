"""Order-dependent operators for keys of any size.

A plain window sends all rows of a key to one task.  Here a key is cut into
segments of time, windowed inside (key, segment), and one summary row per segment
hands its last value on to the next segment of the key.  The result equals the
plain window; the wide rows are exchanged once, the summaries are narrow.
``previous_values`` cuts crowded keys only and leaves the others to the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import same_key_join
from .keyed import crowded


def _carried(rows: DataFrame, keys: Sequence[str], packed: Column, order: Column) -> DataFrame:
    """(keys, _seg, _carry): the last value before each segment of a key."""
    last = rows.groupBy(*keys, "_seg").agg(F.max_by(packed, order).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_seg")
    return last.withColumn("_carry", F.lag("_last").over(across)).drop("_last")


def previous_values(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    segment: Sequence[Column],
    name: str = "previous",
) -> DataFrame:
    """Add struct ``name`` with ``values`` of the preceding row; NULL for the first row.

    ``order`` must be a total order without NULLs, and the tuple ``segment`` must
    grow with it (a truncated time, say).  A previous row whose values are NULL
    still gives a non-NULL struct.

    Keys are counted first.  Rows of keys that are not crowded are exchanged once, by
    their key; segments and their summaries cost crowded keys alone.
    """
    busy = crowded(df, keys)
    if busy is not None:
        hot = _stitched(df.where(busy), keys, order, values, segment, name)
        return _in_one_window(df.where(~busy), keys, order, values, name).unionByName(hot)
    return _in_one_window(df, keys, order, values, name)


def _in_one_window(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], name: str) -> DataFrame:
    return df.withColumn(name, F.lag(F.struct(*values)).over(Window.partitionBy(*keys).orderBy(*order)))


def _stitched(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], segment: Sequence[Column], name: str
) -> DataFrame:
    packed = F.struct(*values)
    rows = df.withColumn("_seg", F.struct(*[s.alias(f"s{i}") for i, s in enumerate(segment)]))
    inside = Window.partitionBy(*keys, "_seg").orderBy(*order)
    carried = _carried(rows, keys, packed, F.struct(*order))
    stitched = same_key_join(rows.withColumn(name, F.lag(packed).over(inside)), carried, [*keys, "_seg"], "left")
    return stitched.withColumn(name, F.coalesce(F.col(name), F.col("_carry"))).drop("_seg", "_carry")


def strictly_earlier(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    tie: str,
    values: Sequence[str],
    name: str = "previous",
    unit: str = "day",
) -> DataFrame:
    """As-of self join: ``values`` of the newest row with a strictly smaller ``at``.

    Rows at the same instant share their predecessor; among rows of one instant
    the highest ``tie`` speaks for it.  Rows with a NULL key or time have none
    and are left out, as in an equality join.  ``unit`` is the length of a
    segment; it does not change the result.
    """
    usable = df.dropna(subset=[*keys, at])
    # One row per instant first: this also absorbs a pile-up at one instant.
    instants = usable.groupBy(*keys, at).agg(F.max_by(F.struct(*values), F.col(tie)).alias("_values"))
    instants = instants.withColumn("_seg", F.date_trunc(unit, at))
    inside = Window.partitionBy(*keys, "_seg").orderBy(at)
    carried = _carried(instants, keys, F.col("_values"), F.col(at))
    # No key is NULL here, so the join keeps the partitioning of the window.
    lookup = instants.withColumn("_inside", F.lag("_values").over(inside)).join(carried, [*keys, "_seg"], "left")
    lookup = lookup.select(*keys, at, F.coalesce("_inside", "_carry").alias(name))
    return usable.join(lookup, [*keys, at], "left").select(*df.columns, name)


def as_of_values(
    df: DataFrame,
    other: DataFrame,
    keys: Sequence[str],
    at: str,
    values: Sequence[str],
    tie: str,
    other_at: str | None = None,
    strict: bool = False,
    name: str = "matched",
    unit: str = "day",
) -> DataFrame:
    """As-of join of two tables: ``values`` of the newest row of ``other`` not later than each row's ``at``.

    Every row of ``df`` stays; ``name`` is NULL where nothing came before, where
    a key is NULL or the time is.  With ``strict`` a row at the same instant does not count.  Of
    rows of ``other`` at one instant the highest ``tie`` speaks.  Matched rows whose values are
    NULL give a non-NULL struct.

    Both sides are reduced to their distinct instants, which absorbs pile-ups, and
    meet in one window per (key, segment of time); a narrow summary row per segment carries the last
    value on.  The rows themselves are joined once, by equality.  ``unit`` is
    the length of a segment; it does not change the result.
    """
    value = F.struct(*values)
    known = other.select(*keys, F.col(other_at or at).alias("_at"), value.alias("_value"), F.col(tie).alias("_tie"))
    known = known.dropna(subset=[*keys, "_at"]).groupBy(*keys, "_at").agg(F.max_by("_value", "_tie").alias("_value"))
    asked = df.select(*keys, F.col(at).alias("_at")).dropna().distinct().withColumn("_asked", F.lit(True))
    both = known.unionByName(asked, allowMissingColumns=True).groupBy(*keys, "_at").agg(
        F.first("_value", True).alias("_value"), F.max("_asked").alias("_asked")
    ).withColumn("_seg", F.date_trunc(unit, "_at"))

    own = F.when(F.col("_value").isNotNull(), F.col("_at"))
    last = both.groupBy(*keys, "_seg").agg(F.max_by("_value", own).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*keys, "_seg", F.last("_last", True).over(earlier).alias("_carry"))
    inside = Window.partitionBy(*keys, "_seg").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    lookup = both.withColumn("_inside", F.last("_value", True).over(inside)).where("_asked").join(carried, [*keys, "_seg"])
    lookup = lookup.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_at", F.coalesce("_inside", "_carry").alias(name))
    same = [F.col(k) == F.col(f"_k_{k}") for k in keys] + [F.col(at) == F.col("_at")]
    return df.join(lookup, reduce(Column.__and__, same), "left").select(*[df[c] for c in df.columns], name)
