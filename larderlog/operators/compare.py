"""Differences of two snapshots, row by row or pruned by digests of their partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import same_key_join

#: Differing partitions of a coarse level that are told to the finer one as a small table.
MOST_TOLD = 10_000


def snapshot_diff(
    before: DataFrame, after: DataFrame, keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Keys added, removed or changed, with ``<value>_before`` / ``<value>_after``.

    One union and one aggregate: NULL key parts match, nothing is joined.  Each
    side holds at most one row per key.
    """
    packed = F.struct(*values)
    sides = before.select(*keys, packed.alias("_b"), F.lit(None).cast(packed_type(before, values)).alias("_a"))
    sides = sides.unionByName(
        after.select(*keys, F.lit(None).cast(packed_type(before, values)).alias("_b"), packed.alias("_a"))
    )
    both = sides.groupBy(*keys).agg(F.first("_b", True).alias("_b"), F.first("_a", True).alias("_a"))
    status = (
        F.when(F.col("_b").isNull(), "added")
        .when(F.col("_a").isNull(), "removed")
        .when(~F.col("_b").eqNullSafe(F.col("_a")), "changed")
    )
    return (
        both.withColumn("status", status)
        .where(F.col("status").isNotNull())
        .select(
            *keys,
            "status",
            *[F.col(f"_b.{v}").alias(f"{v}_before") for v in values],
            *[F.col(f"_a.{v}").alias(f"{v}_after") for v in values],
        )
    )


def packed_type(df: DataFrame, values: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return "struct<" + ",".join(f"`{v}`:{types[v]}" for v in values) + ">"


def row_digest(keys: Sequence[str], values: Sequence[str]) -> list[Column]:
    """Two 64-bit hashes of a row's keys and values, by unrelated functions.

    Nulls, arrays and decimals enter by their JSON text, so a NULL part differs from an empty one.
    """
    text = F.to_json(F.struct(*keys, *values), {"ignoreNullFields": "false"})
    return [F.xxhash64(text), F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")]


def partition_digests(rows: DataFrame, partition: Sequence[str], keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``partition`` columns, ``n``, ``d1``, ``d2``: what a partition of a snapshot holds, in no order.

    ``d1`` is the exclusive or of one hash and ``d2`` the sum of the other, in
    whole numbers of any size.  Keys are unique within a snapshot, so no two rows cancel out.
    """
    first, second = row_digest(keys, values)
    return rows.groupBy(*partition).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(first).alias("d1"), F.sum(second.cast("decimal(38,0)")).alias("d2")
    )


def rolled_digests(digests: DataFrame, partition: Sequence[str]) -> DataFrame:
    """Digests of coarser partitions from those of finer ones."""
    return digests.groupBy(*partition).agg(F.sum("n").alias("n"), F.bit_xor("d1").alias("d1"), F.sum("d2").cast("decimal(38,0)").alias("d2"))


def differing_partitions(before: DataFrame, after: DataFrame, levels: Sequence[Sequence[str]]) -> DataFrame:
    """The finest partitions whose digests differ, found level by level.

    ``levels`` go from coarse to fine, each with the columns of the one before:
    ``[["company_id"], ["company_id", "day"]]``.  Finer digests are compared only inside coarse
    partitions that differ.  Counts and both hashes must agree for a partition to
    pass as equal: for two different ones that has a chance of about 2^-124.
    """
    wanted = None
    for level in levels:
        sides = []
        for side, digests in (("b", before), ("a", after)):
            own = digests if wanted is None else same_key_join(digests, wanted, wanted.columns, "left_semi")
            packed = F.struct("n", "d1", "d2")
            sides.append(rolled_digests(own, level).select(*level, packed.alias("_digest"), F.lit(side).alias("_side")))
        both = sides[0].unionByName(sides[1]).groupBy(*level).agg(
            F.first(F.when(F.col("_side") == "b", F.col("_digest")), True).alias("_b"),
            F.first(F.when(F.col("_side") == "a", F.col("_digest")), True).alias("_a"),
        )
        wanted = both.where(~F.col("_b").eqNullSafe(F.col("_a"))).select(*level)
        if level is not levels[-1]:  # a small table leaves the digests where they are; very many partitions are joined
            few = wanted.limit(MOST_TOLD + 1).collect()
            if len(few) <= MOST_TOLD:
                wanted = F.broadcast(before.sparkSession.createDataFrame(few, wanted.schema))
    return wanted


def pruned_snapshot_diff(
    before: DataFrame, after: DataFrame, wanted: DataFrame, keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """As ``snapshot_diff``, over the rows of the ``wanted`` partitions (see ``differing_partitions``) only."""
    sides = [same_key_join(side, wanted, wanted.columns, "left_semi") for side in (before, after)]
    return snapshot_diff(*sides, keys, values)
