"""Connected components of a link table, in rounds of joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, spread_join


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))
    )))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, label) of every id in (a, b): label is the smallest id reachable.

    Alternates two steps until no link moves: every node hands its larger
    neighbours to its smallest one, then its smaller neighbours and itself.
    Chains shrink by half a round.  A node with very many links is only ever
    aggregated, or joined in salted parts.
    """
    edges = settled(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(rounds):
        near = _both_ways(edges)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = spread_join(near.where("v > u"), least, ["u"], ["v"], "inner").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.inline(F.array(
            F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")), F.struct("a", F.col("m").alias("b"))
        )))
        edges = settled(small.where("a <> b").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = edges.groupBy("a").agg(F.min("b").alias("label"))
    roots = found.select(F.col("label").alias("id")).distinct().select("id", F.col("id").alias("label"))
    return found.select(F.col("a").alias("id"), "label").unionByName(roots)
