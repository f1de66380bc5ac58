"""Campaigns: what is live, which codes to quote, which chip to show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_date, as_time
from ..functions.keys import polish_order
from ..functions.lists import is_empty
from ..functions.text import fold_case, strip
from ..operators.joins import same_key_join
from ..operators.keyed import top_rows


def _campaign_order() -> list[Column]:
    return [
        F.asc_nulls_first("company_id"), F.asc_nulls_last("ends_at"),
        F.asc("code"), F.asc("source"),
    ]


def active_promotions(campaigns: DataFrame, as_of=None) -> DataFrame:
    """Campaigns whose deadline and validity have not passed; ``is_active`` is not asked."""
    today = as_date(as_of)
    return campaigns.where(
        (F.coalesce("deadline", today) >= today) & (F.coalesce(F.to_date("valid_to"), today) >= today)
    ).orderBy(*_campaign_order())


def active_campaigns(campaigns: DataFrame, as_of=None) -> DataFrame:
    """Older definition: flagged active and not past its end date."""
    return campaigns.where(
        F.col("is_active") & (F.col("ends_at").isNull() | (F.col("ends_at") >= as_date(as_of)))
    ).orderBy(*_campaign_order())


def usable(campaigns: DataFrame, as_of=None, now=None) -> DataFrame:
    """Active company campaigns within deadline and validity: the ones worth quoting."""
    today, moment = as_date(as_of), as_time(now if now is not None else as_of)
    return campaigns.where(
        F.col("is_active")
        & F.col("company_id").isNotNull()
        & (F.col("deadline").isNull() | (F.col("deadline") >= today))
        & (F.col("valid_to").isNull() | (F.col("valid_to") >= moment))
    )


def active_promo_codes(campaigns: DataFrame, as_of=None, now=None, company: str | None = None) -> DataFrame:
    """(company, code): trimmed, non-blank, one spelling per case-insensitive code."""
    rows = usable(campaigns, as_of, now)
    if company is not None:
        rows = rows.where(F.col("company_id") == company)
    codes = rows.select("company_id", "code").distinct()
    cleaned = codes.select("company_id", F.col("code").alias("_raw"), strip("code").alias("code")).where(
        F.col("code") != ""
    )
    picked = top_rows(
        cleaned.withColumn("_key", fold_case("code")), ["company_id", "_key"], [F.asc("_raw")]
    )
    return picked.select("company_id", "code")


def promo_targets(campaigns: DataFrame, as_of=None, now=None) -> DataFrame:
    """Companies with usable codes and the sorted list of them, as stored."""
    return (
        usable(campaigns, as_of, now)
        .groupBy("company_id")
        .agg(F.sort_array(F.collect_set("code")).alias("codes"))
        .orderBy("company_id")
    )


def no_code_coverage(prices: DataFrame, now=None, hours: int = 6) -> DataFrame:
    """Per company: quotes without any code captured in the last hours."""
    recent = F.col("captured_at") > as_time(now) - F.expr(f"INTERVAL {int(hours)} HOURS")
    counted = prices.where(recent & is_empty("promo_codes")).groupBy("company_id").agg(F.count(F.lit(1)).alias("recent"))
    companies = prices.select("company_id").distinct()
    kept = same_key_join(companies, counted, ["company_id"], "left")
    return kept.select("company_id", F.coalesce("recent", F.lit(0)).alias("recent"))


def promo_rollup(observations: DataFrame) -> DataFrame:
    """One row per (company, code): attributes of the most trusted feed, all sources sorted.

    ``observations`` carries ``feed`` (priority) and may carry the place in it
    (``feed_page``, ``feed_pos``); the first record of a feed wins.  Rows without
    company or code and banners do not take part.
    """
    attrs = ["discount_percents", "deadline", "promo_text", "separate"]
    places = [c for c in ("feed_page", "feed_pos") if c in observations.columns]
    at = F.struct("feed", "captured_at", *places, "id")
    return (
        observations.where(
            (F.coalesce("company_id", F.lit("")) != "")
            & (F.coalesce("code", F.lit("")) != "")
            & (F.col("source") != "banner")
        )
        .groupBy("company_id", "code")
        .agg(
            F.min_by(F.struct(*attrs), at).alias("a"),
            F.sort_array(F.collect_set("source")).alias("sources"),
        )
        .select("company_id", "code", *[F.col(f"a.{c}").alias(c) for c in attrs], "sources")
    )


def promo_chips(campaigns: DataFrame) -> DataFrame:
    """Chips per company (or global, NULL company): one per code, the first in campaign order.

    Blank codes are dropped; an empty company id means global.
    """
    rows = campaigns.where(F.coalesce("code", F.lit("")) != "").withColumn(
        "company_id", F.nullif("company_id", F.lit(""))
    )
    first = top_rows(
        rows, ["company_id", "code"], [F.asc_nulls_last("ends_at"), F.asc("code"), F.asc("source")]
    )
    return first.select(
        "company_id", "code", "discount_percent",
        F.when(F.col("company_id").isNull(), "global").otherwise("company").alias("scope"),
    )


def primary_promo(tiles: DataFrame, chips: DataFrame) -> DataFrame:
    """The one chip to show per tile row (``company_id``, ``applied_code``).

    The applied code wins, made up when no campaign knows it; otherwise the
    company's highest discount (unknown counts as 0), ties in Polish order.
    """
    own = chips.where(F.col("scope") == "company")
    best = top_rows(
        own,
        ["company_id"],
        [F.desc(F.coalesce("discount_percent", F.lit(0))), polish_order("code").asc(), F.asc("code")],
    ).select("company_id", F.struct("code", "discount_percent", "scope").alias("_best"))
    known = own.select(
        "company_id", F.col("code").alias("applied_code"),
        F.struct("code", "discount_percent", "scope").alias("_known"),
    )
    applied = F.nullif("applied_code", F.lit(""))
    made_up = F.struct(
        applied.alias("code"),
        F.lit(None).cast("decimal(5,2)").alias("discount_percent"),
        F.lit("company").alias("scope"),
    )
    return (
        tiles.join(known, ["company_id", "applied_code"], "left")
        .join(best, "company_id", "left")
        .withColumn(
            "chip",
            F.when(applied.isNotNull(), F.coalesce("_known", made_up)).otherwise(F.col("_best")),
        )
        .drop("_known", "_best")
    )


def promo_validity(prices: DataFrame) -> DataFrame:
    """Verdict on each (company, code) from stored quotes: works if it ever took money off."""
    used = prices.select("company_id", F.explode("promo_codes").alias("code"), "total_promo_code_discount")
    return (
        used.groupBy("company_id", "code")
        .agg(
            F.coalesce(F.max(F.col("total_promo_code_discount") > 0), F.lit(False)).alias("works"),
            F.count(F.lit(1)).alias("quotes"),
            F.max("total_promo_code_discount").alias("best_discount"),
        )
    )
