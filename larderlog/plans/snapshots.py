"""Whole-city snapshots: cheapest leaves and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import differing_partitions, pruned_snapshot_diff, snapshot_diff
from ..operators.keyed import top_rows
from ..sources.sinks import read_compared, settle

#: Folders whose names are handed to the scan of a stored snapshot.
MOST_FOLDERS = 10_000
#: Days, then companies within a day, whose digests tell whether their rows are compared.
MENU_LEVELS = [["menu_date"], ["menu_date", "company_id"]]
PRICE_LEVELS = [["city_id"], ["city_id", "company_id"]]
PRICE_ITEM = ["company_id", "city_id", "diet_calories_id", "tier_diet_option_id", "order_days"]
MENU_ITEM = ["company_id", "city_id", "diet_calories_id", "tier_id", "menu_date", "slot_name", "meal_name"]


def cheapest_leaves(leaves: DataFrame, k: int = 5, n_days: int | None = None) -> DataFrame:
    """The k lowest per-day quotes of a snapshot; leaves without a total do not count."""
    days = F.greatest(F.lit(n_days), F.lit(1)) if n_days is not None else F.greatest("order_days", F.lit(1))
    return (
        leaves.where(F.col("total_cost").isNotNull())
        .withColumn("per_day", F.col("total_cost").cast("double") / days)
        .orderBy("per_day", "company_id", "diet_calories_id", F.asc_nulls_first("tier_diet_option_id"))
        .limit(k)
    )


def cheapest_per_city(leaves: DataFrame, k: int = 5) -> DataFrame:
    """``cheapest_leaves`` for every (city, order length)."""
    rows = leaves.where(F.col("total_cost").isNotNull()).withColumn(
        "per_day", F.col("total_cost").cast("double") / F.greatest("order_days", F.lit(1))
    )
    order = [F.asc("per_day"), F.asc("company_id"), F.asc("diet_calories_id"),
             F.asc_nulls_first("tier_diet_option_id")]
    return top_rows(rows, ["city_id", "order_days"], order, k=k, rank="rank")


def menu_diff(before: DataFrame, after: DataFrame, values: list[str] | None = None) -> DataFrame:
    """Planned dishes added, removed or changed between two menu snapshots.

    The dish name identifies a dish: the service's meal id is only a slot index
    of the day.
    """
    return snapshot_diff(before, after, MENU_ITEM, values or ["is_default"])


def price_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    return snapshot_diff(before, after, PRICE_ITEM, ["total_cost"])


def stored_diff(
    spark: SparkSession, before: str, after: str, schema, levels: list[list[str]], keys: list[str], values: list[str]
) -> DataFrame:
    """Difference of two snapshots that ``sinks.write_compared`` wrote.

    Digests of both are compared first, coarse partitions before fine ones; rows
    of equal partitions are not shuffled, and files of equal coarse partitions are not read.
    """
    digests = (spark.read.parquet(f"{path.rstrip('/')}/digests") for path in (before, after))
    wanted = settle(differing_partitions(*digests, levels), "differing")
    # The scan is told the differing values of each folder column; where there are very many, it reads all.
    told = []
    for c in levels[0]:
        found = [r[0] for r in wanted.select(c).distinct().limit(MOST_FOLDERS + 1).collect()]
        if len(found) <= MOST_FOLDERS:
            named = F.col(c).isin([v for v in found if v is not None])
            told.append(named | F.col(c).isNull() if None in found else named)
    sides = [read_compared(spark, path, schema) for path in (before, after)]
    for condition in told:
        sides = [side.where(condition) for side in sides]
    return pruned_snapshot_diff(*sides, wanted, keys, values)
