"""Nested payloads -> flat rows of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import fingerprint, tier_option_id
from ..functions.lists import first_item, name_list, or_empty, tidy_names
from ..functions.text import (
    blank_to_null,
    first_number,
    info_kcal,
    info_macro,
    money,
)
from ..operators.folding import first_known
from ..operators.joins import keep_known, same_key_join
from ..schemas import table

RUN = ["company_id", "city_id", "captured_at"]
# Order in which promotion feeds are believed; see promo_rollup.
FEEDS = ["awarded-and-top", "constant", "recommended-diets", "banner"]


def typed(df: DataFrame, name: str, *extra: str) -> DataFrame:
    """Cast to the stored table's columns; missing ones become NULL."""
    have = set(df.columns)
    cols = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in table(name).fields
    ]
    return df.select(*cols, *extra)


# -- discovery --------------------------------------------------------------


def listing_companies(
    listing: DataFrame, only: list[str] | None = None, first: int | None = None
) -> DataFrame:
    """All pages of a listing, one row per company; its slug is the company id.

    A run can be narrowed to named companies or to the first ones of the list.
    """
    rows = (
        listing.select("city_id", "captured_at", "currentPage", F.posexplode("searchData").alias("pos", "c"))
        .select("city_id", "captured_at", "currentPage", "pos", F.col("c.name").alias("company_id"), "c.*")
        .drop("name")
    )
    if only is not None:
        rows = rows.where(F.col("company_id").isin(only))
    return rows if first is None else rows.orderBy("currentPage", "pos").limit(first)


def found_cities(search: DataFrame) -> DataFrame:
    c = search.select("query", "captured_at", F.posexplode("cities").alias("pos", "c"))
    rows = c.select(
        "query",
        "captured_at",
        "pos",
        F.col("c.cityId").alias("city_id"),
        F.col("c.name").alias("name"),
        F.col("c.sanitizedName").alias("sanitized_name"),
        F.col("c.countyName").alias("county_name"),
        F.col("c.municipalityName").alias("municipality_name"),
        F.col("c.provinceName").alias("province_name"),
        F.col("c.cityStatus").alias("city_status"),
        F.col("c.numberOfCompanies").alias("number_of_companies"),
        F.coalesce("c.largestCityForName", F.lit(False)).alias("largest_city_for_name"),
    )
    return typed(rows, "cities", "query", "captured_at", "pos")


def tag_rows(dictionary: DataFrame) -> DataFrame:
    t = dictionary.select("captured_at", F.explode(F.map_values("tags")).alias("t"))
    rows = t.select(
        "captured_at",
        F.col("t.dietTagId").alias("tag_code"),
        F.col("t.name").alias("label"),
        F.col("t.imageUrl").alias("image_url"),
    )
    return typed(rows, "diet_tags", "captured_at")


# -- catalogue --------------------------------------------------------------


def company_rows(catalogue: DataFrame, card: DataFrame) -> DataFrame:
    h, p, m = "companyHeader", "companyParams", "menuSettings"
    side = card.select(*RUN, "companySettings", "companyPriceCategory")
    rows = catalogue.join(side, RUN, "left").select(
        "company_id",
        "city_id",
        F.coalesce(f"{h}.name", "company_id").alias("name"),
        F.col(f"{h}.logoUrl").alias("logo_url"),
        F.col(f"{h}.rateValue").alias("avg_score"),
        F.col(f"{h}.feedbackValue").alias("feedback_value"),
        F.col(f"{h}.feedbackNumber").alias("feedback_number"),
        F.coalesce(f"{h}.awarded", F.lit(False)).alias("awarded"),
        F.col("companyPriceCategory").alias("price_category"),
        F.col(f"{p}.deliveryOnSaturday").alias("delivery_on_saturday"),
        F.col(f"{p}.deliveryOnSunday").alias("delivery_on_sunday"),
        F.col(f"{m}.menuEnabled").alias("menu_enabled"),
        F.col(f"{m}.menuDaysAhead").alias("menu_days_ahead"),
        F.col("companySettings.ordersEnabled").alias("orders_enabled"),
        F.col("companySettings.deliveryEnabled").alias("delivery_enabled"),
        F.col("captured_at").alias("created_at"),
        F.col("captured_at").alias("updated_at"),
        "captured_at",
    )
    return typed(rows, "companies", "captured_at", "city_id")


def company_snapshot_rows(companies: DataFrame) -> DataFrame:
    """One observation per company and run, out of ``company_rows``."""
    return typed(companies, "company_snapshots")


def company_city_rows(card: DataFrame) -> DataFrame:
    rows = card.select(
        "company_id",
        "city_id",
        F.col("citySearchResult.deliveryFee").alias("delivery_fee"),
        money("lowestPrice.standard").alias("lowest_price_standard"),
        money("lowestPrice.menuConfiguration").alias("lowest_price_menu_config"),
        F.col("captured_at").alias("created_at"),
        F.col("captured_at").alias("updated_at"),
        "captured_at",
    )
    return typed(rows, "company_cities", "captured_at")


def _diets(catalogue: DataFrame) -> DataFrame:
    return catalogue.select(*RUN, F.posexplode("companyDiets").alias("pos", "d"))


def diet_rows(catalogue: DataFrame) -> DataFrame:
    rows = _diets(catalogue).select(
        "company_id",
        "captured_at",
        "pos",
        F.col("d.dietId").alias("diet_id"),
        F.col("d.name").alias("name"),
        F.col("d.description").alias("description"),
        F.col("d.imageUrl").alias("image_url"),
        F.coalesce("d.awarded", F.lit(False)).alias("awarded"),
        F.col("d.avgScore").alias("avg_score"),
        F.col("d.feedbackValue").alias("feedback_value"),
        F.col("d.feedbackNumber").alias("feedback_number"),
        F.col("d.dietTag").alias("diet_tag"),
        F.coalesce("d.isMenuConfiguration", F.lit(False)).alias("is_menu_configuration"),
        F.col("d.dietMealCount").alias("diet_meal_count"),
        F.col("captured_at").alias("created_at"),
        F.col("captured_at").alias("updated_at"),
        F.col("captured_at").alias("valid_from"),
    )
    return typed(rows, "diets", "captured_at", "pos")


def discount_rows(catalogue: DataFrame) -> DataFrame:
    rows = (
        _diets(catalogue)
        .select("company_id", F.col("d.dietId").alias("diet_id"), F.explode("d.discounts").alias("x"))
        .select(
            "company_id",
            "diet_id",
            "x.discount",
            F.col("x.minimumDays").alias("minimum_days"),
            F.col("x.discountType").alias("discount_type"),
        )
    )
    return typed(rows, "diet_discounts")


def _tiers(catalogue: DataFrame) -> DataFrame:
    return _diets(catalogue).select(
        *RUN, "pos", F.col("d.dietId").alias("diet_id"), F.posexplode("d.dietTiers").alias("tier_pos", "t")
    )


def _options(catalogue: DataFrame) -> DataFrame:
    return _tiers(catalogue).select(
        *RUN,
        "pos",
        "tier_pos",
        "diet_id",
        F.col("t.tierId").alias("tier_id"),
        F.posexplode("t.dietOptions").alias("option_pos", "o"),
    )


def tier_rows(catalogue: DataFrame) -> DataFrame:
    rows = _tiers(catalogue).select(
        "company_id",
        "captured_at",
        "diet_id",
        F.col("tier_pos").alias("pos"),
        F.col("t.tierId").alias("tier_id"),
        F.col("t.name").alias("name"),
        money("t.minPrice").alias("min_price"),
        F.col("t.mealsNumber").alias("meals_number"),
        F.coalesce("t.defaultOptionChange", F.lit(False)).alias("default_option_change"),
        F.col("t.tag").alias("tag"),
        F.col("captured_at").alias("created_at"),
        F.col("captured_at").alias("updated_at"),
        F.col("captured_at").alias("valid_from"),
    )
    return typed(rows, "tiers", "captured_at", "pos")


def option_rows(catalogue: DataFrame) -> DataFrame:
    rows = _options(catalogue).select(
        "company_id",
        "captured_at",
        "diet_id",
        "tier_id",
        F.col("option_pos").alias("pos"),
        F.col("o.dietOptionId").alias("diet_option_id"),
        F.col("o.tierDietOptionId").alias("tier_diet_option_id"),
        F.col("o.name").alias("name"),
        F.col("o.dietOptionTag").alias("diet_option_tag"),
        F.coalesce("o.defaultOption", F.lit(False)).alias("is_default"),
        F.col("captured_at").alias("created_at"),
        F.col("captured_at").alias("updated_at"),
        F.col("captured_at").alias("valid_from"),
    )
    return typed(rows, "diet_options", "captured_at", "pos")


def _flat_options(catalogue: DataFrame, flat: Column) -> DataFrame:
    """Kcal entries listed directly under a diet, for the diets where ``flat`` holds."""
    return (
        _diets(catalogue)
        .where(flat)
        .select(*RUN, "pos", F.col("d").alias("d"), F.posexplode("d.dietOptions").alias("option_pos", "o"))
        .select(
            *RUN,
            "pos",
            "option_pos",
            F.col("d.dietId").alias("diet_id"),
            F.col("o.dietOptionId").alias("diet_option_id"),
            F.posexplode("o.dietCalories").alias("leaf_pos", "k"),
        )
        .select(
            *RUN, "pos", "option_pos", "leaf_pos", "diet_id", "diet_option_id",
            F.col("k.dietCaloriesId").alias("diet_calories_id"), F.col("k.calories").alias("calories"),
        )
    )


def _tiered_leaves(options: DataFrame) -> DataFrame:
    return options.select(
        *RUN,
        "pos",
        "tier_pos",
        "option_pos",
        "diet_id",
        "tier_id",
        F.col("o.dietOptionId").alias("diet_option_id"),
        F.posexplode("o.dietCalories").alias("leaf_pos", "k"),
    ).select(
        *RUN, "pos", "tier_pos", "option_pos", "leaf_pos", "diet_id", "tier_id", "diet_option_id",
        F.col("k.dietCaloriesId").alias("diet_calories_id"), F.col("k.calories").alias("calories"),
    )


def leaf_rows(catalogue: DataFrame, card: DataFrame) -> DataFrame:
    """Stored leaves of a catalogue run.

    A diet with tiers yields its tier/option/kcal tree.  Any other diet yields
    the ids of its options and of the city card, options first, without option
    or tier; the first known kcal of an id wins.
    """
    tiered = _tiered_leaves(_options(catalogue))
    has_no_tiers = F.coalesce(F.size("d.dietTiers"), F.lit(0)) <= 0
    listed = _flat_options(catalogue, has_no_tiers).select(
        *RUN, "diet_id", "diet_calories_id", "calories",
        F.lit(0).alias("feed"), "pos", "option_pos", "leaf_pos",
    )
    # Later entries of the card replace earlier ones of the same diet.
    ids = (
        card.select(*RUN, F.posexplode("dietPriceInfo").alias("p", "e"))
        .groupBy(*RUN, F.col("e.dietId").alias("diet_id"))
        .agg(F.max_by("e.dietCaloriesIds", "p").alias("ids"))
        .select(*RUN, "diet_id", F.posexplode("ids").alias("leaf_pos", "diet_calories_id"))
    )
    flat_diets = _diets(catalogue).where(has_no_tiers).select(*RUN, F.col("d.dietId").alias("diet_id")).distinct()
    advertised = ids.join(flat_diets, [*RUN, "diet_id"], "left_semi").select(
        *RUN, "diet_id", "diet_calories_id", F.lit(None).cast("int").alias("calories"),
        F.lit(1).alias("feed"), F.lit(0).alias("pos"), F.lit(0).alias("option_pos"), "leaf_pos",
    )
    flat = first_known(
        listed.unionByName(advertised),
        [*RUN, "diet_id", "diet_calories_id"],
        "calories",
        ["feed", "pos", "option_pos", "leaf_pos"],
    )
    rows = tiered.unionByName(flat, allowMissingColumns=True)
    rows = rows.withColumns({c: F.col("captured_at") for c in ("created_at", "updated_at", "valid_from")})
    positions = [F.coalesce(c, F.lit(0)).alias(c) for c in ("pos", "tier_pos", "option_pos", "leaf_pos")]
    return typed(rows, "diet_calories", "captured_at", *positions)


def snapshot_leaves(catalogue: DataFrame) -> DataFrame:
    """Leaves of the whole-city snapshot form.

    Differs from ``leaf_rows`` on purpose: tiers are walked only for
    menu-configuration diets, and flat diets keep their option id.
    """
    walks = F.coalesce("d.isMenuConfiguration", F.lit(False)) & (
        F.coalesce(F.size("d.dietTiers"), F.lit(0)) > 0
    )
    diets = _diets(catalogue)
    tree = (
        diets.where(walks)
        .select(*RUN, "pos", "d", F.posexplode("d.dietTiers").alias("tier_pos", "t"))
        .select(*RUN, "pos", "tier_pos", "d", "t", F.posexplode("t.dietOptions").alias("option_pos", "o"))
    )
    flat = diets.where(~walks).select(
        *RUN, "pos", F.lit(0).alias("tier_pos"), "d", F.posexplode("d.dietOptions").alias("option_pos", "o")
    )

    def project(df: DataFrame, tiered: bool) -> DataFrame:
        tier = (lambda f, t: F.col(f"t.{f}")) if tiered else (lambda f, t: F.lit(None).cast(t))
        return df.select(
            *RUN, "pos", "tier_pos", "option_pos",
            F.col("d.dietId").alias("diet_id"),
            F.col("d.name").alias("diet_name"),
            F.col("d.dietTag").alias("diet_tag"),
            F.coalesce("d.isMenuConfiguration", F.lit(False)).alias("is_menu_configuration"),
            tier("tierId", "bigint").alias("tier_id"),
            tier("name", "string").alias("tier_name"),
            tier("mealsNumber", "int").alias("tier_meals_number"),
            F.col("o.dietOptionId").alias("diet_option_id"),
            F.col("o.name").alias("diet_option_name"),
            F.col("o.dietOptionTag").alias("diet_option_tag"),
            F.posexplode("o.dietCalories").alias("leaf_pos", "k"),
        ).select(
            "*",
            tier_option_id("tier_id", "diet_option_id").alias("tier_diet_option_id"),
            F.col("k.dietCaloriesId").alias("diet_calories_id"),
            F.col("k.calories").alias("calories"),
        ).drop("k")

    return project(tree, True).unionByName(project(flat, False))


def with_advertised(leaves: DataFrame, card: DataFrame) -> DataFrame:
    """Attach the advertised price of the kcal id; the last entry naming an id wins."""
    entries = (
        card.select(*RUN, F.posexplode("dietPriceInfo").alias("p", "e"))
        .select(*RUN, "p", "e", F.posexplode("e.dietCaloriesIds").alias("q", "diet_calories_id"))
        .groupBy(*RUN, "diet_calories_id")
        .agg(
            F.max_by(
                F.struct(
                    F.col("e.discountPrice").alias("discount_price"),
                    F.col("e.defaultPrice").alias("default_price"),
                    F.col("e.dietPriceInCompanyPromotion").alias("in_promotion"),
                ),
                F.struct("p", "q"),
            ).alias("advertised")
        )
    )
    return same_key_join(leaves, entries, [*RUN, "diet_calories_id"], "left")


# -- quotes -----------------------------------------------------------------


def price_rows(quotes: DataFrame) -> DataFrame:
    """One price per answered quote; a quote without a cart yields no row."""
    item = first_item("items")
    rows = quotes.where(F.col("cart").isNotNull()).select(
        F.xxhash64(
            *RUN, "diet_calories_id", "tier_diet_option_id", "order_days", "promo_codes"
        ).alias("id"),
        "diet_calories_id",
        "company_id",
        "city_id",
        "tier_diet_option_id",
        "order_days",
        or_empty("promo_codes", "string").alias("promo_codes"),
        item["perDayDietCost"].alias("per_day_cost"),
        item["perDayDietWithDiscountsCost"].alias("per_day_cost_with_discounts"),
        F.col("cart.totalCostToPay").alias("total_cost"),
        F.col("cart.totalCostWithoutDiscounts").alias("total_cost_without_discounts"),
        F.col("cart.totalDeliveryCost").alias("total_delivery_cost"),
        F.col("cart.totalOrderLengthDiscount").alias("total_order_length_discount"),
        F.col("cart.totalPromoCodeDiscount").alias("total_promo_code_discount"),
        F.col("cart.totalDeliveriesOnDateDiscount").alias("total_delivery_discount"),
        "captured_at",
    )
    return typed(rows, "prices")


# -- menus ------------------------------------------------------------------


def _allergen_names(allergens: Column) -> Column:
    """The service's own name of each allergen (the entry also has the company's)."""
    def own(m: Column) -> Column:
        named = F.map_filter(
            m, lambda k, _: F.endswith(k, F.lit("AllergenName")) & (k != "companyAllergenName")
        )
        return F.get(F.map_values(named), F.lit(0))

    return F.transform(allergens, own)


def dish_rows(menus: DataFrame) -> DataFrame:
    """One row per slot option of a menu, with the dish's parsed fields."""
    slots = menus.select(
        *RUN, "diet_calories_id", "tier_id", F.col("date").alias("menu_date"),
        F.posexplode("meals").alias("slot_pos", "s"),
    )
    options = slots.select(
        *RUN, "diet_calories_id", "tier_id", "menu_date", "slot_pos",
        F.col("s.name").alias("slot_name"),
        F.col("s.baseDietCaloriesMealId").alias("base_id"),
        F.posexplode("s.options").alias("option_pos", "o"),
    ).where(F.col("o.dietCaloriesMealId").isNotNull())
    d = "o.details"
    name = F.coalesce("o.name", f"{d}.name")
    fields = options.select(
        *RUN, "diet_calories_id", "tier_id", "menu_date", "slot_pos", "option_pos", "slot_name",
        F.col("o.dietCaloriesMealId").alias("api_meal_slot_id"),
        F.coalesce(F.col("base_id") == F.col("o.dietCaloriesMealId"), F.lit(False)).alias("is_default"),
        name.alias("raw_name"),
        blank_to_null(name).alias("name"),
        F.col("o.label").alias("label"),
        F.coalesce("o.thermo", f"{d}.thermo").alias("thermo"),
        F.coalesce(first_number(f"{d}.calories"), info_kcal("o.info")).alias("kcal"),
        F.coalesce(first_number(f"{d}.protein"), info_macro("o.info", "protein_g")).alias("protein_g"),
        F.coalesce(first_number(f"{d}.fat"), info_macro("o.info", "fat_g")).alias("fat_g"),
        F.coalesce(first_number(f"{d}.carbohydrate"), info_macro("o.info", "carbs_g")).alias("carbs_g"),
        first_number(f"{d}.dietaryFiber").alias("fiber_g"),
        first_number(f"{d}.sugar").alias("sugar_g"),
        first_number(f"{d}.saturatedFattyAcids").alias("saturated_fat_g"),
        first_number(f"{d}.salt").alias("salt_g"),
        F.col(f"{d}.imageUrl").alias("image_url"),
        F.col("o.reviewsScore").alias("reviews_score"),
        F.col("o.reviewsNumber").alias("reviews_number"),
        tidy_names(_allergen_names(F.col(f"{d}.allergensWithExcluded"))).alias("allergens"),
        name_list(F.col(f"{d}.ingredients.name")).alias("ingredients"),
    )
    return fields.withColumn(
        "fingerprint",
        fingerprint("raw_name", "kcal", "protein_g", "carbs_g", "fat_g", "reviews_score", "reviews_number"),
    ).drop("raw_name")


def daily_menu_rows(dishes: DataFrame) -> DataFrame:
    """Every slot option counts, unnamed dishes included (with a NULL meal)."""
    rows = dishes.select(
        F.xxhash64(
            *RUN, "diet_calories_id", "tier_id", "menu_date", "slot_pos", "option_pos"
        ).alias("id"),
        *RUN, "diet_calories_id", "tier_id", "menu_date", "slot_name",
        F.col("name").alias("meal_name"), "api_meal_slot_id", "is_default",
    )
    return typed(rows, "daily_menu")


def compact_menu_days(menus: DataFrame) -> DataFrame:
    """Nested diff-friendly form of a menu day: slots -> options, details flattened."""
    def option(o: Column) -> Column:
        d = o["details"]
        return F.struct(
            o["dietCaloriesMealId"].alias("dietCaloriesMealId"),
            *[o[f].alias(f) for f in ("name", "label", "info", "thermo", "reviewsScore", "reviewsNumber")],
            d["imageUrl"].alias("imageUrl"),
            F.struct(
                *[d[f].alias(f) for f in ("calories", "protein", "carbohydrate", "fat")],
                d["dietaryFiber"].alias("fiber"),
                d["sugar"].alias("sugar"),
                d["saturatedFattyAcids"].alias("saturatedFat"),
                d["salt"].alias("salt"),
            ).alias("macros"),
            F.coalesce(
                _allergen_names(d["allergensWithExcluded"]), F.array().cast("array<string>")
            ).alias("allergens"),
            F.coalesce(
                F.transform(d["ingredients"], lambda i: i["name"]), F.array().cast("array<string>")
            ).alias("ingredients"),
        )

    def slot(s: Column) -> Column:
        return F.struct(
            s["name"].alias("name"),
            s["baseDietCaloriesMealId"].alias("baseDietCaloriesMealId"),
            F.transform(s["options"], option).alias("options"),
        )

    return menus.select(
        *RUN, "diet_calories_id", "tier_id", "date", "calories",
        F.transform("meals", slot).alias("meals"),
    )


# -- promotions -------------------------------------------------------------


def _promo(df: DataFrame, source: str, info: str, raw: Column) -> DataFrame:
    """Observations of an active-promotion block; blank codes are dropped."""
    return df.where(F.coalesce(F.col(f"{info}.code"), F.lit("")) != "").select(
        "captured_at",
        F.col(f"{info}.code").alias("code"),
        F.lit(source).alias("source"),
        "company_id",
        "city_id",
        F.col(f"{info}.discountPercents").alias("discount_percents"),
        F.col(f"{info}.promoText").alias("promo_text"),
        F.col(f"{info}.promoDeadline").alias("deadline"),
        F.col(f"{info}.separate").alias("separate"),
        F.to_json(raw).alias("raw"),
        *[F.col(c).alias(f"feed_{name}") for c, name in (("currentPage", "page"), ("pos", "pos")) if c in df.columns],
    )


def promo_rows(
    listing: DataFrame | None = None,
    catalogue: DataFrame | None = None,
    banners: DataFrame | None = None,
    recommended: DataFrame | None = None,
) -> DataFrame:
    """Union of the promotion feeds that are given, with their ``feed`` priority.

    ``feed_page`` and ``feed_pos`` are the place of a record in its list; feeds
    that bring one record per payload have zeros.
    """
    feeds: dict[str, DataFrame] = {}
    if listing is not None:
        c = listing_companies(listing)
        feeds["awarded-and-top"] = _promo(
            c, "awarded-and-top", "activePromotionInfo", F.struct("company_id", "activePromotionInfo")
        )
    if catalogue is not None:
        c = catalogue.select(*RUN, F.col("companyHeader.activePromotionInfo").alias("info"))
        feeds["constant"] = _promo(c, "constant", "info", F.col("info"))
    if recommended is not None:
        c = recommended.withColumn("company_id", F.col("companyData.companyId"))
        feeds["recommended-diets"] = _promo(
            c, "recommended-diets", "activePromotion", F.struct("companyData", "activePromotion")
        )
    if banners is not None:
        feeds["banner"] = banners.where(F.coalesce("code", F.lit("")) != "").select(
            "captured_at",
            "code",
            F.lit("banner").alias("source"),
            F.lit(None).cast("string").alias("company_id"),
            "city_id",
            F.col("name").alias("promo_text"),
            F.col("validFrom").alias("valid_from"),
            F.col("validTo").alias("valid_to"),
            F.to_json(
                F.struct("name", "code", "url", "validFrom", "validTo", "deepLink", "target", "priority", "type")
            ).alias("raw"),
            "target",
            F.col("deepLink").alias("deep_link"),
            F.col("url").alias("banner_image_url"),
        )
    out = None
    for name in FEEDS:
        if name in feeds:
            part = feeds[name].withColumn("feed", F.lit(FEEDS.index(name)))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no promotion feed given")
    for c in ("target", "deep_link", "banner_image_url"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    for c in ("feed_page", "feed_pos"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)).cast("int") if c in out.columns else F.lit(0))
    out = out.withColumn(
        "id",
        F.xxhash64("captured_at", "code", "source", "company_id", "city_id", "promo_text", "raw"),
    )
    return typed(
        out, "promo_observations", "feed", "feed_page", "feed_pos", "target", "deep_link", "banner_image_url"
    )


def known_companies(observations: DataFrame, companies: DataFrame) -> DataFrame:
    """Observations of a company that is not catalogued lose the link, not the row."""
    return keep_known(observations, "company_id", companies, "company_id")
