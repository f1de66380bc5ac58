"""Price history, latest prices and price changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import bucket, day_text
from ..functions.keys import parse_offer_key
from ..functions.lists import comma_joined, has_any
from ..operators.keyed import best_per_bucket, latest_rows
from ..operators.joins import same_key_join
from ..operators.sequence import strictly_earlier
from ..schemas import table
from ..sources.partials import BestRows
from ..sources.tables import Tables

SERIES = ["company_id", "diet_calories_id", "city_id", "order_days"]
QUOTED = ["company_id", "city_id", "diet_calories_id", "order_days", "promo_codes"]


def price_history(
    prices: DataFrame,
    company: str | None = None,
    leaf: int | None = None,
    city_id: int | None = None,
    days: int | None = None,
    tdo: str | None = None,
    unit: str = "day",
) -> DataFrame:
    """Last capture of every day per series, over all series unless arguments pick one.

    A series does not distinguish tiers (a kcal id may be sold under several);
    ``tdo`` narrows it to one composite id.
    """
    given = {"company_id": company, "diet_calories_id": leaf, "city_id": city_id, "order_days": days,
             "tier_diet_option_id": tdo}
    for column, value in given.items():
        if value is not None:
            prices = prices.where(F.col(column) == value)
    last = best_per_bucket(
        prices, SERIES, bucket("captured_at", unit), [F.desc("captured_at"), F.desc("id")], "day"
    )
    return last.select(
        *SERIES, day_text("day").alias("bucket"),
        F.col("per_day_cost_with_discounts").alias("price"), "promo_codes",
    )


def promo_marks(history: DataFrame) -> DataFrame:
    """Points of a history that were quoted with codes."""
    return history.where(has_any("promo_codes")).select(
        *SERIES, "bucket", "price", comma_joined("promo_codes").alias("code")
    )


def latest_prices(prices: DataFrame) -> DataFrame:
    """Newest row per quoted combination; the list of codes is part of the key."""
    return latest_rows(prices, QUOTED)


def latest_view(spark: SparkSession, root: str, unit: str = "day") -> BestRows:
    """``latest_prices`` kept up to date while captures are appended; ``until`` gives those of an earlier day."""
    newest = [F.desc_nulls_last("captured_at"), F.desc_nulls_last("id")]
    return BestRows(spark, root, table("prices"), QUOTED, newest, unit=unit)


def cheapest_view(spark: SparkSession, root: str, cell: str = "day", unit: str = "day") -> BestRows:
    """Lowest total per combination and ``cell`` of time, kept up to date while captures are appended."""
    keys = ["city_id", "company_id", "diet_calories_id", F.coalesce("tier_diet_option_id", F.lit("")), "order_days"]
    order = [F.asc_nulls_last("total_cost"), F.desc("captured_at"), F.desc("id")]
    return BestRows(spark, root, table("prices"), [*keys, bucket("captured_at", cell)], order, unit=unit)


def price_changes(prices: DataFrame, unit: str = "day") -> DataFrame:
    """Rows whose per-day price differs from the newest strictly earlier capture.

    First captures vanish; a change from or to NULL counts.  ``unit`` cuts a
    combination's captures for the work only.
    """
    value = "per_day_cost_with_discounts"
    rows = strictly_earlier(prices, QUOTED, "captured_at", "id", [value], "_before", unit)
    before = F.col("_before")[value]
    return (
        rows.where(F.col("_before").isNotNull() & ~F.col(value).eqNullSafe(before))
        .withColumn("prev_per_day", before)
        .withColumn("delta", F.col(value) - before)
        .drop("_before")
    )


def quote_breakdown(t: Tables, offers: DataFrame, city_id: int | None = None, days: int | None = None) -> DataFrame:
    """Stored quote of each offer key: per-day and total amounts of the newest capture.

    ``offers`` has a column ``offer_id``; malformed keys give one row with the
    ``error`` and no amounts.
    """
    parsed = offers.select("offer_id", parse_offer_key("offer_id").alias("o")).select("offer_id", "o.*")
    prices = t.prices
    if city_id is not None:
        prices = prices.where(F.col("city_id") == city_id)
    if days is not None:
        prices = prices.where(F.col("order_days") == days)
    keys = ["company_id", "diet_calories_id", "_tdo"]
    rows = prices.withColumn("_tdo", F.coalesce("tier_diet_option_id", F.lit("")))
    wanted = parsed.withColumn("_tdo", F.coalesce("tier_diet_option_id", F.lit("")))
    # The offers' columns are part of the ranking key, so other rows can go first.
    asked = same_key_join(rows, wanted.select(*keys).distinct(), keys, "left_semi")
    newest = latest_rows(asked, [*keys, "city_id", "order_days", "promo_codes"])
    return wanted.join(newest.drop("tier_diet_option_id"), keys, "left").select(
        "offer_id", "error", "city_id",
        F.col("order_days").alias("days_count"),
        F.col("promo_codes").alias("promo_applied"),
        F.struct(
            F.col("per_day_cost").alias("list_price"),
            F.col("per_day_cost_with_discounts").alias("final_price"),
        ).alias("per_day"),
        F.struct(
            F.col("total_cost_without_discounts").alias("list_total"),
            F.col("total_cost").alias("final_total"),
            F.col("total_delivery_cost").alias("delivery_total"),
            F.col("total_order_length_discount").alias("order_length_discount"),
            F.col("total_promo_code_discount").alias("promo_discount"),
            F.col("total_delivery_discount").alias("delivery_discount"),
        ).alias("totals"),
        "captured_at",
    )
