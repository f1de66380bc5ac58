"""State folding: current table + batch -> next table.

Each fold is one union and one ``groupBy`` on the key: NULL key parts group
together, several batch rows of one key collapse map-side in their order, and
no join is needed.  ``order`` names the batch columns that give the order of
arrival.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import same_key_join


@dataclass(frozen=True)
class Policy:
    """What happens to each column when the key already exists.

    overwrite: take the last batch row.  keep: take the last non-NULL value,
    else the old one.  fixed: value -> constant on every touch (``reopen`` is
    ``{"valid_to": NULL}``).  on_insert: constant only for a new row.  All other
    columns are written on insert, from the first batch row, and never changed.
    """

    keys: Sequence[str]
    overwrite: Sequence[str] = ()
    keep: Sequence[str] = ()
    fixed: dict[str, Column] = field(default_factory=dict)
    on_insert: dict[str, Column] = field(default_factory=dict)


def upsert(
    current: DataFrame, incoming: DataFrame, policy: Policy, order: Sequence[str]
) -> DataFrame:
    keys = list(policy.keys)
    rest = [c for c in current.columns if c not in keys]
    touched = {*policy.overwrite, *policy.keep, *policy.fixed}
    insert_only = [
        c for c in rest if c not in touched and c not in policy.on_insert and c in incoming.columns
    ]
    batch_columns = {*policy.overwrite, *policy.keep, *insert_only}
    types = dict(current.dtypes)

    old = current.select(*keys, F.struct(*rest).alias("_old"))
    new = incoming.select(
        *[F.col(k).cast(types[k]).alias(k) for k in keys],
        F.struct(*[F.col(c).cast(types[c]).alias(c) for c in rest if c in batch_columns]).alias("_new")
        if batch_columns
        else F.struct(F.lit(1).alias("_any")).alias("_new"),
        F.struct(*order).alias("_at"),
    )
    is_new = F.col("_new").isNotNull()

    aggs = [F.first("_old", True).alias("_old"), F.max(is_new).alias("_hit")]
    if policy.overwrite:
        picked = F.struct(*[F.col(f"_new.{c}").alias(c) for c in policy.overwrite])
        aggs.append(F.max_by(F.when(is_new, picked), F.when(is_new, F.col("_at"))).alias("_last"))
    for c in policy.keep:
        value = F.col(f"_new.{c}")
        aggs.append(F.max_by(value, F.when(value.isNotNull(), F.col("_at"))).alias(f"_keep_{c}"))
    if insert_only:
        picked = F.struct(*[F.col(f"_new.{c}").alias(c) for c in insert_only])
        aggs.append(F.min_by(F.when(is_new, picked), F.when(is_new, F.col("_at"))).alias("_first"))

    grouped = old.unionByName(new, allowMissingColumns=True).groupBy(*keys).agg(*aggs)
    existed, hit = F.col("_old").isNotNull(), F.col("_hit")

    def result(c: str) -> Column:
        before = F.col(f"_old.{c}")
        if c in policy.fixed:
            value = F.when(hit, policy.fixed[c]).otherwise(before)
        elif c in policy.overwrite:
            value = F.when(hit, F.col(f"_last.{c}")).otherwise(before)
        elif c in policy.keep:
            value = F.coalesce(F.col(f"_keep_{c}"), before)
        elif c in policy.on_insert:
            value = F.when(existed, before).otherwise(policy.on_insert[c])
        elif c in insert_only:
            value = F.when(existed, before).otherwise(F.col(f"_first.{c}"))
        else:
            value = before
        return value.cast(types[c]).alias(c)

    return grouped.select(*[F.col(c) if c in keys else result(c) for c in current.columns])


def replace_groups(current: DataFrame, incoming: DataFrame, touched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace every row of the touched keys by the batch rows (which may be none)."""
    kept = same_key_join(current, touched.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(incoming.select(*current.columns))


def retire(
    current: DataFrame,
    seen: DataFrame,
    scope: str,
    keys: Sequence[str],
    at: str = "captured_at",
    closed: str = "valid_to",
) -> DataFrame:
    """Close live rows that a later payload of their ``scope`` no longer lists.

    ``seen`` has one row per listed item and payload time ``at``; a scope whose
    payload was empty is absent, so nothing of it is closed.  A row closes at
    the first payload after the one that listed it last, which makes folding
    several days at once equal to folding them one by one.
    """
    last = seen.groupBy(*keys).agg(F.max(at).alias("_last_listed"))
    runs = seen.select(scope, F.col(at).alias("_last_listed")).distinct()
    order = Window.partitionBy(scope).orderBy("_last_listed")
    runs = runs.withColumn("_next", F.lead("_last_listed").over(order))
    first = seen.groupBy(scope).agg(F.min(at).alias("_first"))
    out = same_key_join(current, last, keys, "left")
    out = same_key_join(out, runs, [scope, "_last_listed"], "left")
    out = same_key_join(out, first, [scope], "left")
    missed = F.when(F.col("_last_listed").isNull(), F.col("_first")).otherwise(F.col("_next"))
    return out.withColumn(closed, F.coalesce(F.col(closed), missed)).select(*current.columns)


def first_known(df: DataFrame, keys: Sequence[str], value: str, priority: Sequence[str]) -> DataFrame:
    """Per key the first non-NULL value by priority; keys with only NULLs survive."""
    at = F.when(F.col(value).isNotNull(), F.struct(*priority))
    return df.groupBy(*keys).agg(F.min_by(value, at).alias(value))
