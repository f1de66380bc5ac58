"""Cities, kcal bounds and the catering page.

All queries are set-based: without a city or order length they answer for every
one, keyed by it.  Arguments only add predicates, which reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import bucket
from ..functions.keys import per_day, price_delta, tier_option_id
from ..functions.text import fold_case, joined_line
from ..operators.keyed import best_per_bucket, current_with_previous, distinct_values, top_rows
from ..operators.ranks import ranked_between
from ..sources.tables import Tables
from .arguments import KCAL_CAP, KCAL_PRESETS, KCAL_RANGE, SUGGESTIONS, PageArgs

COMBO = ["company_id", "diet_calories_id", "_tdo", "order_days"]
#: Ranks up to which a page's tiles and all before them may meet in one task.
DEEP_RANKS = 10_000


def live(df: DataFrame) -> DataFrame:
    return df.where(F.col("valid_to").isNull())


def cities_with_companies(t: Tables) -> DataFrame:
    return (
        t.cities.join(t.company_cities.select("city_id"), "city_id", "left_semi")
        .select("city_id", "name")
        .orderBy("name", "city_id")
    )


def resolve_city(cities: DataFrame, name: str) -> DataFrame:
    """Best stored city of that name: the largest of its name, then most companies."""
    wanted = F.lower(F.lit(name))
    return (
        cities.where((F.lower("name") == wanted) | (F.lower("sanitized_name") == wanted))
        .orderBy(
            F.desc_nulls_last("largest_city_for_name"), F.desc_nulls_last("number_of_companies"), "city_id"
        )
        .limit(1)
        .select("city_id", "name")
    )


def resolve_cities(cities: DataFrame, names: DataFrame, column: str = "name_wanted") -> DataFrame:
    """``resolve_city`` for a table of names: one equi join per spelling, then the best hit."""
    wanted = names.select(column).distinct().withColumn("_key", F.lower(column))
    spelled = (
        cities.withColumn("_key", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("sanitized_name")))))
    )
    hits = wanted.join(spelled, "_key")
    return top_rows(
        hits,
        [column],
        [F.desc_nulls_last("largest_city_for_name"), F.desc_nulls_last("number_of_companies"), F.asc("city_id")],
    ).select(column, "city_id", "name")


def pick_search_hit(hits: DataFrame, name: str) -> DataFrame:
    """City of a search answer to ingest: the active exact match, else the first active."""
    exact = fold_case("name") == fold_case(F.lit(name))
    return (
        hits.where(F.coalesce("city_status", F.lit(False)))
        .orderBy(F.when(exact, 0).otherwise(1), "pos")
        .limit(1)
    )


def suggest_cities(hits: DataFrame) -> DataFrame:
    """Names to offer when nothing matches; a missing status counts as active."""
    ok = F.coalesce("city_status", F.lit(True))
    return hits.where(ok).orderBy("pos", "city_id").limit(SUGGESTIONS).select("name")


def kcal_bounds(t: Tables, city_id: int | None = None) -> DataFrame:
    """Per city: lowest and highest live kcal up to the cap, and the preset chips.

    Presets keep their fixed order; all are offered when none has data.
    """
    served = t.company_cities.select("company_id", "city_id")
    if city_id is not None:
        served = served.where(F.col("city_id") == city_id)
    per_company = (
        live(t.diet_calories).where(F.col("calories").isNotNull()).select("company_id", "calories").distinct()
    )
    capped = F.when(F.col("calories") <= KCAL_CAP, F.col("calories"))
    candidates = F.array(*[F.lit(c) for c in KCAL_PRESETS])
    hit = F.when(F.col("calories").isin(list(KCAL_PRESETS)), F.col("calories"))
    return (
        served.join(per_company, "company_id")
        .groupBy("city_id")
        .agg(F.min(capped).alias("lo"), F.max(capped).alias("hi"), F.collect_set(hit).alias("seen"))
        .select(
            "city_id",
            F.coalesce("lo", F.lit(KCAL_RANGE[0])).alias("kcal_min"),
            F.coalesce("hi", F.lit(KCAL_RANGE[1])).alias("kcal_max"),
            F.when(
                F.size("seen") > 0, F.filter(candidates, lambda c: F.array_contains("seen", c))
            ).otherwise(candidates).alias("presets"),
        )
    )


def kcal_bounds_of(t: Tables, city_id: int) -> DataFrame:
    """``kcal_bounds`` of one city; a city without data gets the defaults."""
    spark = t.company_cities.sparkSession
    wanted = spark.range(city_id, city_id + 1).withColumnRenamed("id", "city_id")
    found = wanted.join(kcal_bounds(t, city_id), "city_id", "left")
    return found.select(
        "city_id",
        F.coalesce("kcal_min", F.lit(KCAL_RANGE[0])).alias("kcal_min"),
        F.coalesce("kcal_max", F.lit(KCAL_RANGE[1])).alias("kcal_max"),
        F.coalesce("presets", F.array(*[F.lit(c) for c in KCAL_PRESETS])).alias("presets"),
    )


def day_options(t: Tables, city_id: int | None = None) -> DataFrame:
    prices = t.prices if city_id is None else t.prices.where(F.col("city_id") == city_id)
    return distinct_values(prices, "order_days", by=["city_id"])


def current_prices(
    prices: DataFrame, unit: str = "day", reduce_to: DataFrame | None = None
) -> DataFrame:
    """Cheapest capture of the newest bucket per (city, combo), with the bucket before it.

    Order-length and code discounts do not stack, so the lowest total of a
    bucket is the offer.  ``prev_per_day`` belongs to the previous *captured*
    bucket.  ``reduce_to`` (live leaves with ``company_id, diet_calories_id,
    _tdo``) drops prices of other leaves before ranking; the keys are part of
    the ranking partition, so the result for those leaves does not change.
    """
    keys = ["city_id", *COMBO]
    rows = prices.withColumn("_tdo", F.coalesce("tier_diet_option_id", F.lit("")))
    if reduce_to is not None:
        rows = rows.join(reduce_to, ["company_id", "diet_calories_id", "_tdo"], "left_semi")
    cheapest = best_per_bucket(
        rows,
        keys,
        bucket("captured_at", unit),
        [F.asc_nulls_last("total_cost"), F.desc("captured_at"), F.desc("id")],
        "capture_bucket",
    )
    priced = cheapest.withColumn("effective_per_day", per_day("total_cost", "order_days"))
    return current_with_previous(priced, keys, "capture_bucket", {"effective_per_day": "prev_per_day"})


def offered_leaves(
    t: Tables, kcal_min: int | None = None, kcal_max: int | None = None, names: bool = True
) -> DataFrame:
    """Live leaves of live diets, by default with the names of diet, tier and option.

    A leaf with only one of tier and option set can match no price and is left
    out; ``_tdo`` is the price-side key ('' for ready diets).
    """
    leaves = live(t.diet_calories)
    if kcal_min is not None and kcal_max is not None:
        leaves = leaves.where(F.col("calories").between(kcal_min, kcal_max))
    leaves = leaves.where(F.col("tier_id").isNull() == F.col("diet_option_id").isNull()).select(
        "company_id", "diet_id", "tier_id", "diet_option_id", "diet_calories_id", "calories",
        F.coalesce(tier_option_id("tier_id", "diet_option_id"), F.lit("")).alias("_tdo"),
    )
    diets = live(t.diets).select(
        "company_id", "diet_id", F.col("name").alias("diet_name"), "diet_tag",
        F.col("description").alias("diet_description"),
    )
    if not names:
        return leaves.join(diets.select("company_id", "diet_id"), ["company_id", "diet_id"])
    tiers = t.tiers.select("company_id", "diet_id", "tier_id", F.col("name").alias("tier_name"))
    options = t.diet_options.select(
        "company_id", "diet_id", "tier_id", "diet_option_id", F.col("name").alias("diet_option_name")
    )
    return (
        leaves.join(diets, ["company_id", "diet_id"])
        .join(tiers, ["company_id", "diet_id", "tier_id"], "left")
        .join(options, ["company_id", "diet_id", "tier_id", "diet_option_id"], "left")
    )


TILE = ["city_id", "order_days", "company_id"]
LEAF_FIELDS = [
    "company_id", "diet_id", "diet_name", "diet_tag", "diet_description", "tier_id", "tier_name",
    "diet_option_id", "diet_option_name", "diet_calories_id", "calories", "per_day_cost",
    "per_day_cost_with_discounts", "total_cost", "total_cost_without_discounts",
    "total_delivery_cost", "total_promo_code_discount", "total_order_length_discount",
    "promo_codes", "effective_per_day", "captured_at", "prev_per_day",
]


def priced_leaves(
    t: Tables,
    city_id: int | None = None,
    days: int | None = None,
    kcal_min: int | None = None,
    kcal_max: int | None = None,
    unit: str = "day",
    reduce_first: bool = False,
    only: DataFrame | None = None,
    names: bool = True,
) -> DataFrame:
    """Every offered leaf with its current and previous price, per city and order length.

    ``only`` keeps the given tiles (unique city_id, order_days, company_id) and
    adds their other columns; its keys are part of the ranking key, so it is
    joined before the ranking and other companies' prices go no further.
    ``names=False`` leaves out the descriptive columns and their joins.
    """
    prices = t.prices
    if city_id is not None:
        prices = prices.where(F.col("city_id") == city_id)
    if days is not None:
        prices = prices.where(F.col("order_days") == days)
    if only is not None:
        prices = prices.join(only, TILE)
    leaves = offered_leaves(t, kcal_min, kcal_max, names)
    # A NULL composite id belongs to ready diets only, an empty one to nobody.
    ready = F.col("tier_diet_option_id").isNull() & F.col("tier_id").isNull()
    tiered = F.col("tier_diet_option_id").isNotNull() & F.col("tier_id").isNotNull()
    keys = ["company_id", "diet_calories_id", "_tdo"]
    current = current_prices(prices, unit, leaves.select(*keys) if reduce_first else None)
    out = current.join(leaves, keys).where(ready | tiered)
    more = [c for c in only.columns if c not in TILE] if only is not None else []
    return out.select("city_id", "order_days", *[c for c in LEAF_FIELDS if c in out.columns], *more)


def company_tiles(leaves: DataFrame, companies: DataFrame) -> DataFrame:
    """One row per (city, order length, company): cheapest price and number of leaves."""
    grouped = leaves.groupBy(*TILE).agg(
        F.min("effective_per_day").alias("cheapest"), F.count(F.lit(1)).alias("variants")
    )
    names = companies.select(
        "company_id", F.col("name").alias("company_name"), "awarded", "feedback_value", "feedback_number"
    )
    return grouped.join(names, "company_id")


def page_totals(tiles: DataFrame) -> DataFrame:
    """Totals of the whole range per (city, order length), independent of the page."""
    return tiles.groupBy("city_id", "order_days").agg(
        F.count(F.lit(1)).alias("total_companies"),
        F.min("cheapest").alias("overall_min"),
        F.max("cheapest").alias("overall_max"),
    )


def page_of_tiles(tiles: DataFrame, args: PageArgs, cells: int | None = None) -> DataFrame:
    """Tiles of the page with their rank label, per (city, order length).

    Up to DEEP_RANKS the leading tiles of a city are ranked in one task; deeper
    pages, or any page if ``cells`` is given, are found by prefix counts, so that no task holds a city.
    """
    order = [F.asc_nulls_last("cheapest"), F.asc("company_id")]
    if cells is not None or args.offset + args.size > DEEP_RANKS:
        return ranked_between(tiles, ["city_id", "order_days"], order, args.offset, args.offset + args.size, cells)
    upto = top_rows(tiles, ["city_id", "order_days"], order, k=args.offset + args.size, rank="rank")
    return upto.where(F.col("rank") > args.offset)


def _leaf_order() -> list[Column]:
    return [
        F.col("effective_per_day").isNull().alias("_np"), F.col("effective_per_day").alias("_p"),
        F.col("calories").isNull().alias("_nk"), F.col("calories").alias("_k"),
        F.col("diet_calories_id").alias("_l"),
        F.coalesce(tier_option_id("tier_id", "diet_option_id"), F.lit("")).alias("_o"),
        F.col("diet_id").alias("_d"),
    ]


def catering_page(t: Tables, args: PageArgs, city_id: int | None = None, unit: str = "day") -> DataFrame:
    """The catering page: one row per company with its leaves as an ordered array.

    ``leaves`` is sorted by price, kcal, then leaf key; ``leaves[0]`` is the
    cheapest.  Tiles are ranked on narrow rows; only the companies of the page
    are priced again in full and get an array, so what is nested is at most one
    page of catalogues.  Totals describe the whole range even
    beyond the last page.
    """
    scope = (t, city_id, args.days, args.kcal_min, args.kcal_max, unit)
    tiles = company_tiles(priced_leaves(*scope, names=False), t.companies)
    page = page_of_tiles(tiles, args)
    shown = priced_leaves(*scope, only=page)
    packed = F.struct(*_leaf_order(), F.struct(*LEAF_FIELDS).alias("leaf"))
    return (
        shown.groupBy(*page.columns)
        .agg(F.transform(F.array_sort(F.collect_list(packed)), lambda x: x["leaf"]).alias("leaves"))
        .join(page_totals(tiles), ["city_id", "order_days"])
        .orderBy("city_id", "order_days", "rank")
    )


def page_cheapest(page: DataFrame) -> DataFrame:
    """Head line of each tile: cheapest leaf, diet line, price movement, first applied code."""
    c = F.get("leaves", F.lit(0))
    return page.select(
        "city_id", "order_days", "company_id", "rank", "total_companies", "overall_min", "overall_max",
        F.size("leaves").alias("variants"),
        joined_line(c["diet_name"], c["tier_name"], c["diet_option_name"]).alias("diet_line"),
        c["effective_per_day"].alias("effective_per_day"),
        c["prev_per_day"].alias("prev_per_day"),
        price_delta(c["effective_per_day"], c["prev_per_day"]).alias("delta"),
        F.get(c["promo_codes"], F.lit(0)).alias("applied_code"),
        c["captured_at"].alias("captured_at"),
    )


def page_freshness(page: DataFrame) -> DataFrame:
    """Newest capture among the cheapest leaves that are visible."""
    return page.groupBy("city_id", "order_days").agg(
        F.max(F.get("leaves", F.lit(0))["captured_at"]).alias("latest_capture_at")
    )


def leaf_shares(leaves: DataFrame) -> DataFrame:
    """Hidden variants of a tile: everything beyond the first eight."""
    counts = leaves.groupBy(*TILE).agg(F.count(F.lit(1)).alias("variants"))
    return counts.withColumn("hidden", F.greatest(F.col("variants") - VISIBLE_VARIANTS, F.lit(0)))


# Fixed value: variants shown before the drill-down is expanded.
VISIBLE_VARIANTS = 8

