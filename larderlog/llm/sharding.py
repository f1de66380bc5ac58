"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a 64-bit ring; a key belongs to the first
point clockwise of its hash.  No shard takes more than its quota: keys beyond it
continue clockwise to the next shard with room, so balance is guaranteed and
only overflowing keys leave their home shard.

Keys of one arc (the stretch before a virtual node) share their walk around the
ring, hence only the number of keys per arc decides who overflows where.  Those
counters, one per virtual node whatever the input, are all the driver sees.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settled, table, text_of

VNODES = 256
#: Pieces an arc is ranked in, so that rows that share a key don't meet in one task.
PIECES = 16


def ring_points(shards: int, vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """(sorted positions, owning shard of each).  A shard's points don't depend on the number of shards."""
    name = np.repeat(np.arange(shards, dtype=np.uint64), vnodes) * np.uint64(1 << 32) + np.tile(
        np.arange(vnodes, dtype=np.uint64), shards
    )
    x = (name + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    at = (x ^ (x >> np.uint64(31))).view(np.int64)
    order = np.argsort(at, kind="stable")
    return at[order], np.repeat(np.arange(shards), vnodes)[order]


def overflow_plan(counts: dict[int, int], owners: np.ndarray, quota: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Where the keys of each arc go: (arc, first rank, end rank, shard, first slot).

    In rounds: every shard first takes keys of its own arcs, in ring order, then
    what its neighbours could not take.  The sum of the quotas must cover all keys.
    """
    shards, points = len(quota), len(owners)
    room, taken, parts = list(quota), [0] * shards, []
    waiting = [(arc, 0, n, arc, frozenset()) for arc, n in sorted(counts.items()) if n]
    while waiting:
        later = []
        for arc, start, left, point, seen in waiting:
            while owners[point % points] in seen:
                point += 1
            shard = int(owners[point % points])
            take = min(left, room[shard])
            if take:
                parts.append((arc, start, start + take, shard, taken[shard]))
                room[shard] -= take
                taken[shard] += take
            if left > take:
                later.append((arc, start + take, left - take, point, seen | {shard}))
        waiting = later
    return parts


def even_quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def assign_shards(
    docs: DataFrame, shards: int, vnodes: int = VNODES, headroom: float = 0.0, pieces: int = PIECES
) -> DataFrame:
    """Shard and slot of every row of (doc_id, text).

    ``headroom`` 0 gives quotas that differ by one row at most and are all
    filled (law ``rows``); 0.1 lets a shard hold a tenth more than its share, so
    fewer keys leave home.  Rows without doc_id are placed by size and checksum
    of their text; repeated rows are placed one by one; an empty table gives no
    rows; other columns are ignored.  A null text has size 1 and checksum 0.
    """
    spark = docs.sparkSession
    positions, owners = ring_points(shards, vnodes)

    @F.pandas_udf("int")
    def arc_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(positions, key.to_numpy(), side="left") % len(positions)).astype("int32")

    size = (F.octet_length(text_of()) + 1).cast("long")
    crc = F.crc32(text_of().cast("binary"))
    rows = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"))
    stand_in = F.when(F.col("doc_id").isNull(), F.struct("size", "text_crc32"))
    rows = rows.withColumn("_arc", arc_of(F.xxhash64("doc_id", stand_in))).withColumn(
        "_piece", F.pmod(F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id()), F.lit(pieces)).cast("int")
    )
    rows = settled(rows, "shard-rows")  # ranks and counts must see the same pieces

    tally = rows.groupBy("_arc", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    # At most shards * vnodes counters reach the driver.
    counts = {r["_arc"]: r["_n"] for r in tally.groupBy("_arc").agg(F.sum("_n").alias("_n")).collect()}
    total = sum(counts.values())
    quota = even_quotas(total, shards) if headroom == 0 else [int(np.ceil(total / shards * (1 + headroom) - 1e-9))] * shards
    plan = spark.createDataFrame(
        overflow_plan(counts, owners, quota), "_arc int, _from long, _to long, shard int, _slot long"
    )
    home = spark.createDataFrame([(i, int(s)) for i, s in enumerate(owners)], "_arc int, home_shard int")

    before = F.sum("_n").over(Window.partitionBy("_arc").orderBy("_piece")) - F.col("_n")
    starts = tally.select("_arc", "_piece", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_arc", "_piece").orderBy("doc_id", "text_crc32", "size"))
    # The three small sides hold at most shards * vnodes * pieces rows.
    placed = (
        rows.withColumn("_inside", inside)
        .join(F.broadcast(starts), ["_arc", "_piece"])
        .withColumn("_rank", F.col("_before") + F.col("_inside") - 1)
        .join(F.broadcast(plan.withColumnRenamed("_arc", "_plan_arc")),
              (F.col("_arc") == F.col("_plan_arc")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
        .join(F.broadcast(home), "_arc")
    )
    return placed.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_slot") + F.col("_rank") - F.col("_from")).alias("slot"), "home_shard"
    )


def op1_shard_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards whose row counts differ by one at most."""
    placed = assign_shards(table(spark, sf_dir, "documents"), 16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "home_shard",
    )
