"""Menus: current state, dish line-ups, calendars and what to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_date, calendar_dates, day_text
from ..functions.keys import parse_offer_key, polish_order, slot_rank
from ..operators.joins import same_key_join
from ..operators.keyed import latest_rows, top_rows
from ..sources.tables import Tables
from .arguments import MENU_DAYS

MENU_KEY = ["company_id", "city_id", "diet_calories_id", "tier_id", "menu_date", "slot_name", "meal_name"]
DISH = ["name", "label", "kcal", "protein_g", "fat_g", "carbs_g", "image_url", "allergens"]


def current_daily_menu(daily_menu: DataFrame) -> DataFrame:
    """Newest capture of every planned dish; a missing tier or meal is a key value."""
    return latest_rows(daily_menu, MENU_KEY)


def target_option(leaves: DataFrame, company: str, leaf: int, tier: int | None) -> DataFrame:
    """Option group of one leaf id, preferring the row of the given tier."""
    same = F.col("tier_id").eqNullSafe(F.lit(tier).cast("bigint"))
    return (
        leaves.where((F.col("company_id") == company) & (F.col("diet_calories_id") == leaf))
        .orderBy(
            same.desc(), F.asc_nulls_first("tier_id"), F.asc_nulls_first("diet_option_id"), F.asc("diet_id")
        )
        .limit(1)
        .select("company_id", "diet_id", "tier_id", "diet_option_id")
    )


def sibling_leaves(leaves: DataFrame, target: DataFrame) -> DataFrame:
    """Leaf ids of the target's option group at any kcal."""
    group = ["company_id", "diet_id", "tier_id", "diet_option_id"]
    return same_key_join(leaves, target, group, "left_semi").select("company_id", "diet_calories_id").distinct()


def variant_meals(
    t: Tables, company: str, leaf: int, tier: int | None = None, as_of=None, days: int = 14
) -> DataFrame:
    """Dishes served lately under a leaf or its siblings, most frequent first per slot."""
    siblings = sibling_leaves(t.diet_calories, target_option(t.diet_calories, company, leaf, tier))
    menu = t.daily_menu.where(F.col("company_id") == company)
    served = _lineup(menu, as_of, days)
    rows = _tally(served.join(siblings, ["company_id", "diet_calories_id"], "left_semi"), [], t.meals.where(F.col("company_id") == company))
    return rows.orderBy("slot_name", F.desc("occurrences"), F.desc("last_seen_date"), "name")


def option_meals(t: Tables, as_of=None, days: int = 14) -> DataFrame:
    """``variant_meals`` for every option group at once."""
    group = ["diet_id", "tier_id", "diet_option_id"]
    groups = t.diet_calories.select("company_id", "diet_calories_id", *group).distinct()
    served = _lineup(t.daily_menu, as_of, days).drop("tier_id")
    return _tally(served.join(groups, ["company_id", "diet_calories_id"]), ["company_id", *group], t.meals)


def _lineup(menu: DataFrame, as_of, days: int) -> DataFrame:
    recent = menu.where(
        (F.col("menu_date") >= F.date_sub(as_date(as_of), days)) & F.col("meal_name").isNotNull()
    )
    # A dish is often planned for many leaves and captures; one row per day is enough.
    return recent.select(
        "company_id", "diet_calories_id", "tier_id", "menu_date", "slot_name", F.col("meal_name").alias("name")
    ).distinct()


def _tally(served: DataFrame, keys: list[str], meals: DataFrame) -> DataFrame:
    """Days are counted in narrow rows; the dish's fields come by a join afterwards."""
    group = [*keys, "company_id"] if "company_id" not in keys else keys
    counted = served.groupBy(*group, "slot_name", "name").agg(
        day_text(F.max("menu_date")).alias("last_seen_date"),
        F.countDistinct("menu_date").alias("occurrences"),
    )
    rows = counted.join(meals.select("company_id", *DISH).distinct(), ["company_id", "name"])
    return rows.select(*keys, "slot_name", *DISH, "last_seen_date", "occurrences")


SERVED = ["company_id", "diet_calories_id", "slot_name", "name", "month"]


def served_days(daily_menu: DataFrame) -> DataFrame:
    """The days of each month that a dish was planned for a leaf and slot, as one number.

    Bit d - 1 of ``days`` stands for day d.  Rows of several batches merge by
    ``merged_days``, any number of times.
    """
    planned = daily_menu.where(F.col("meal_name").isNotNull() & F.col("menu_date").isNotNull())
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.dayofmonth("menu_date") - 1)
    keys = [F.col("meal_name").alias("name") if c == "name" else F.trunc("menu_date", "month").alias("month") if c == "month" else F.col(c)
            for c in SERVED]
    return planned.groupBy(*keys).agg(F.bit_or(bit).alias("days"))


def merged_days(days: DataFrame, keys: list[str] = SERVED) -> DataFrame:
    return days.groupBy(*keys).agg(F.bit_or("days").alias("days"))


def option_meals_of_days(t: Tables, served: DataFrame, as_of=None, days: int = 14) -> DataFrame:
    """``option_meals`` from stored ``served_days`` instead of the menu's rows, for any ``as_of``.

    Months before the window are not read where ``month`` is a partition; in its
    first month earlier days are masked away.
    """
    start = F.date_sub(as_date(as_of), days)
    since = F.call_function("shiftright", F.lit(0x7FFFFFFF).cast("bigint"), F.dayofmonth(start) - 1)
    since = F.call_function("shiftleft", since, F.dayofmonth(start) - 1)
    first = F.trunc(start, "month")
    recent = served.where(F.col("month") >= first).withColumn(
        "days", F.when(F.col("month") == first, F.col("days").bitwiseAND(since)).otherwise(F.col("days"))
    ).where("days <> 0")
    group = ["diet_id", "tier_id", "diet_option_id"]
    groups = t.diet_calories.select("company_id", "diet_calories_id", *group).distinct()
    shown = recent.join(groups, ["company_id", "diet_calories_id"])
    # Leaves of one option group share their days; then months add up.
    per_month = merged_days(shown, ["company_id", *group, "slot_name", "name", "month"])
    last = F.date_add("month", F.length(F.bin("days")).cast("int") - 1)
    dishes = per_month.groupBy("company_id", *group, "slot_name", "name").agg(
        day_text(F.max(last)).alias("last_seen_date"), F.sum(F.bit_count("days")).alias("occurrences")
    )
    return dishes.join(t.meals.select("company_id", *DISH), ["company_id", "name"])


def meals_by_slot(meals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Slots of a line-up in day order with their dishes, counted.

    Dishes keep the line-up order; an array holds the dishes of one slot of one
    option group within the window of days.
    """
    keys = keys or []
    packed = F.struct(
        (-F.col("occurrences")).alias("_o"),
        F.col("last_seen_date").alias("_d0"),
        F.col("name").alias("name"),
        F.col("kcal").alias("kcal"),
        F.col("occurrences").alias("occurrences"),
        F.col("last_seen_date").alias("last_seen_date"),
    )

    def order(a: Column, b: Column) -> Column:
        return (
            F.when(a["_o"] < b["_o"], -1).when(a["_o"] > b["_o"], 1)
            .when(a["_d0"] > b["_d0"], -1).when(a["_d0"] < b["_d0"], 1)
            .when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1)
            .otherwise(0)
        )

    dishes = F.transform(
        F.array_sort(F.collect_list(packed), order),
        lambda x: F.struct(x["name"], x["kcal"], x["occurrences"], x["last_seen_date"]),
    )
    grouped = meals.groupBy(*keys, "slot_name").agg(dishes.alias("meals"))
    return (
        grouped.withColumn("slot_rank", slot_rank("slot_name"))
        .withColumn("dishes", F.size("meals"))
        .orderBy(*keys, "slot_rank", polish_order("slot_name"))
    )


def menu_targets(t: Tables, company: str | None = None, key: str = "option") -> DataFrame:
    """One representative live leaf per option group: lowest kcal, then lowest id.

    ``key="tier_option"`` groups by (tier, option) alone, as the whole-city
    snapshot does.
    """
    leaves = t.diet_calories.where(F.col("valid_to").isNull())
    if company is not None:
        leaves = leaves.where(F.col("company_id") == company)
    diets = t.diets.where(F.col("valid_to").isNull()).select(
        "company_id", "diet_id", F.coalesce("is_menu_configuration", F.lit(False)).alias("is_menu_configuration")
    )
    group = ["company_id", "tier_id", "diet_option_id"] + (["diet_id"] if key == "option" else [])
    rows = top_rows(
        leaves.join(diets, ["company_id", "diet_id"]),
        group,
        [F.asc_nulls_last("calories"), F.asc("diet_calories_id"), F.asc("diet_id")],
    )
    return rows.select(
        "company_id", "diet_id", "tier_id", "diet_option_id", "diet_calories_id", "is_menu_configuration"
    )


def snapshot_menu_targets(leaves: DataFrame, only_configurable: bool = True) -> DataFrame:
    """First listed leaf per (tier, option) of each company of a snapshot."""
    if only_configurable:
        leaves = leaves.where("is_menu_configuration")
    return top_rows(
        leaves,
        ["company_id", "city_id", "tier_id", "diet_option_id"],
        [F.asc(c) for c in ("pos", "tier_pos", "option_pos", "leaf_pos")],
    )


def menu_horizon(cap: int = MENU_DAYS) -> Column:
    """Days to fetch: the company's horizon (none or 0 means the default), capped, at least 1."""
    ahead = F.coalesce(F.nullif("menu_days_ahead", F.lit(0)), F.lit(MENU_DAYS))
    return F.greatest(F.lit(1), F.least(ahead, F.lit(cap)))


def menu_jobs(t: Tables, as_of=None, cap: int = MENU_DAYS, company: str | None = None) -> DataFrame:
    """(target leaf, date) work list of the companies whose menu is not disabled."""
    config = t.companies.where(F.coalesce("menu_enabled", F.lit(True))).select(
        "company_id", menu_horizon(cap).alias("_days")
    )
    return (
        menu_targets(t, company)
        .join(config, "company_id")
        .withColumn("menu_date", F.explode(calendar_dates(as_date(as_of), F.col("_days"))))
        .select("company_id", "diet_calories_id", "tier_id", "is_menu_configuration", "menu_date")
    )


def menu_calendar(t: Tables, offers: DataFrame, dates: list[str], city_id: int | None = None) -> DataFrame:
    """Stored menu per offer key and date: slots with options and the default pick.

    A date without a menu keeps its row with an empty list of slots.
    """
    spine = (
        offers.select("offer_id", parse_offer_key("offer_id").alias("o"))
        .select("offer_id", "o.*")
        .withColumn("menu_date", F.explode(F.array(*[F.lit(d).cast("date") for d in dates])))
    )
    # Dates, city and leaf are part of the menu key, so other rows can go before the ranking.
    stored = t.daily_menu.where(F.col("menu_date").isin([F.lit(d).cast("date") for d in dates]))
    if city_id is not None:
        stored = stored.where(F.col("city_id") == city_id)
    leaf = ["company_id", "diet_calories_id"]
    menu = current_daily_menu(same_key_join(stored, spine.select(*leaf).distinct(), leaf, "left_semi"))
    option = F.struct(
        F.col("api_meal_slot_id").alias("pick_id"), F.col("meal_name").alias("name"),
        F.coalesce("is_default", F.lit(False)).alias("is_default"),
    )
    slots = (
        menu.groupBy("company_id", "city_id", "diet_calories_id", "menu_date", "slot_name", "tier_id")
        .agg(
            F.array_sort(F.collect_list(option)).alias("options"),
            F.max(F.when(F.col("is_default"), F.col("api_meal_slot_id"))).alias("default_pick_id"),
        )
        .withColumn("_rank", slot_rank("slot_name"))
        .groupBy("company_id", "city_id", "diet_calories_id", "menu_date", "tier_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("_rank", "slot_name", "default_pick_id", "options"))
            ).alias("slots")
        )
    )
    # The tier of a configurable offer is the part before the dash of its composite id.
    wanted = spine.withColumn(
        "tier_id", F.split_part("tier_diet_option_id", F.lit("-"), F.lit(1)).try_cast("bigint")
    )
    keys = ["company_id", "diet_calories_id", "menu_date", "tier_id"]
    out = same_key_join(wanted, slots, keys, "left")
    none = F.array().cast(dict(slots.dtypes)["slots"])
    return out.select(
        "offer_id", "error", "is_menu_configuration", "city_id", "menu_date",
        F.coalesce("slots", none).alias("slots"),
    )


def planned_per_slot(menu: DataFrame) -> DataFrame:
    """Number of distinct dishes per company and slot, slots in day order."""
    return (
        menu.groupBy("company_id", "slot_name")
        .agg(F.countDistinct("meal_name").alias("dishes"), F.count(F.lit(1)).alias("rows"))
        .withColumn("slot_rank", slot_rank("slot_name"))
    )
