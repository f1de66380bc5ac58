"""Offer search over the stored catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_date
from ..functions.keys import offer_key
from ..operators.keyed import top_rows
from ..operators.sequence import as_of_values
from ..sources.tables import Tables
from .arguments import OFFER_DAYS, offer_limit


def configurable_offers(t: Tables) -> DataFrame:
    """Live company -> diet -> tier -> option -> leaf chain; ready diets have no tier and drop out.

    Orders must be enabled (unknown counts as disabled).
    """
    def live(df: DataFrame) -> DataFrame:
        return df.where(F.col("valid_to").isNull())

    companies = t.companies.where(F.coalesce("orders_enabled", F.lit(False))).select(
        "company_id", F.col("name").alias("company_name"), "avg_score", "awarded"
    )
    diets = live(t.diets).select(
        "company_id", "diet_id", F.col("name").alias("diet_name"), "diet_tag", "is_menu_configuration"
    )
    tiers = live(t.tiers).select("company_id", "diet_id", "tier_id", F.col("name").alias("tier_name"))
    options = live(t.diet_options).select(
        "company_id", "diet_id", "tier_id", "diet_option_id", "tier_diet_option_id"
    )
    leaves = live(t.diet_calories).select(
        "company_id", "diet_id", "tier_id", "diet_option_id", "diet_calories_id", "calories"
    )
    return (
        leaves.join(options, ["company_id", "diet_id", "tier_id", "diet_option_id"])
        .join(tiers, ["company_id", "diet_id", "tier_id"])
        .join(diets, ["company_id", "diet_id"])
        .join(companies, "company_id")
        .join(t.company_cities.select("company_id", "city_id"), "company_id")
    )


def offer_prices(prices: DataFrame, days: int = OFFER_DAYS) -> DataFrame:
    """Newest price per (city, leaf id) of the offer length; company, tier and codes are ignored."""
    return top_rows(
        prices.where(F.col("order_days") == days),
        ["city_id", "diet_calories_id"],
        [F.desc_nulls_last("captured_at"), F.desc("id")],
    ).select("city_id", "diet_calories_id", F.col("per_day_cost_with_discounts").alias("price_per_day"))


def prices_in_force(
    asked: DataFrame, prices: DataFrame, keys: Sequence[str] = ("company_id", "city_id"), at: str = "captured_at",
    days: int = OFFER_DAYS, unit: str = "day",
) -> DataFrame:
    """Adds the quote in force at each row's instant: the newest of the offer length up to then.

    ``asked`` has the ``keys`` and a time, a promotion sighting for instance; the rule is
    that of ``offer_prices`` at that instant.  Quotes of one instant are told apart by
    their id, the highest stands.  Without a quote the three columns are NULL.
    """
    quotes = prices.where(F.col("order_days") == days)
    quotes = quotes.withColumnsRenamed({"id": "price_id", "per_day_cost_with_discounts": "price_per_day"})
    found = as_of_values(
        asked, quotes.withColumn("quoted_at", F.col("captured_at")), list(keys), at, ["price_id", "price_per_day", "quoted_at"],
        "price_id", other_at="captured_at", name="_quote", unit=unit,
    )
    return found.select(*asked.columns, "_quote.price_id", "_quote.price_per_day", "_quote.quoted_at")


def _campaigns(t: Tables, as_of) -> DataFrame:
    return t.campaigns.where(
        F.col("is_active") & (F.col("ends_at").isNull() | (F.col("ends_at") >= as_date(as_of)))
    )


def _promo_struct():
    return F.struct(
        F.col("code").alias("code"),
        F.col("discount_percent").alias("discount_percent"),
        F.col("ends_at").alias("deadline"),
    )


def find_offers(
    t: Tables,
    city_id: int | None = None,
    diet_tag: str | None = None,
    kcal_min: int | None = None,
    kcal_max: int | None = None,
    max_price: float | None = None,
    min_score: float | None = None,
    with_promo_only: bool = False,
    as_of=None,
    promo_scope: str = "global",
) -> DataFrame:
    """Every matching offer, unsorted.

    The promotion is one campaign for all offers: the active one that ends
    first.  ``promo_scope="company"`` attaches each company's own instead.
    """
    offers = configurable_offers(t)
    prices = offer_prices(t.prices)
    if city_id is not None:
        offers, prices = offers.where(F.col("city_id") == city_id), prices.where(F.col("city_id") == city_id)
    if diet_tag:
        offers = offers.where(F.col("diet_tag") == diet_tag)
    if kcal_min is not None:
        offers = offers.where(F.col("calories") >= kcal_min)
    if kcal_max is not None:
        offers = offers.where(F.col("calories") <= kcal_max)
    if min_score is not None:
        offers = offers.where(F.col("avg_score") >= min_score)
    rows = offers.join(prices, ["city_id", "diet_calories_id"], "left")
    if max_price is not None:
        rows = rows.where(F.col("price_per_day") <= max_price)

    ending = [F.asc_nulls_last("ends_at"), F.asc("code"), F.asc("source")]
    if promo_scope == "company":
        own = top_rows(_campaigns(t, as_of).where(F.col("company_id").isNotNull()), ["company_id"], ending)
        rows = rows.join(own.select("company_id", _promo_struct().alias("promo")), "company_id", "left")
    else:
        first = _campaigns(t, as_of).orderBy(*ending).limit(1).select(_promo_struct().alias("promo"))
        rows = rows.withColumn("promo", first.scalar())
    rows = rows.withColumn("promo", F.when(F.coalesce(F.col("promo.code"), F.lit("")) != "", F.col("promo")))
    if with_promo_only:
        rows = rows.where(F.col("promo").isNotNull())
    return rows.select(
        "city_id",
        offer_key("company_id", "diet_calories_id", "tier_diet_option_id", "is_menu_configuration").alias("offer_id"),
        "company_id", "company_name", "avg_score", F.coalesce("awarded", F.lit(False)).alias("awarded"),
        "diet_id", "diet_name", "diet_tag",
        F.coalesce("is_menu_configuration", F.lit(False)).alias("is_configurable"),
        "tier_name", "tier_diet_option_id", "diet_calories_id", "calories", "price_per_day", "promo",
    )


def ranked_offers(offers: DataFrame, sort_by: str = "price", limit: int | None = None) -> DataFrame:
    """Best offers of each city: cheapest or best rated first, missing values last."""
    first = F.asc_nulls_last("price_per_day") if sort_by == "price" else F.desc_nulls_last("avg_score")
    order = [first, F.asc("company_id"), F.asc("diet_id"), F.asc("tier_diet_option_id"), F.asc("diet_calories_id")]
    return top_rows(offers, ["city_id"], order, k=offer_limit(limit), rank="rank")
