"""Landed payloads as JSON text, written by Spark from the star schema tables.

One payload per supplier (catalogue, city card), per line item (quote, menu) or
per order (banner, recommendation).  A company has 20 parts, so the nesting
below collects at most 20 rows per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larderlog.sources.starviews import load, parts_as_leaves

RUN_AT = "2001-01-01T06:00:00.000Z"


def _json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("payload"))


def _run(company: Column, city: Column) -> list[Column]:
    return [company.alias("company_id"), city.alias("city_id"), F.lit(RUN_AT).alias("captured_at")]


def _zloty(amount: Column) -> Column:
    """67.0 -> "67,00 zł", thousands parted by a no-break space."""
    whole = F.regexp_replace(F.floor(amount).cast("string"), r"(\d)(?=(\d{3})+$)", "$1 ")
    cents = F.lpad(F.round((amount - F.floor(amount)) * 100).cast("int").cast("string"), 2, "0")
    return F.concat(whole, F.lit(","), cents, F.lit(" zł"))


def _nest(df: DataFrame, keys: list[str], item: Column, name: str, *more: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias(name), *more)


def catalogue(spark, folder: str) -> DataFrame:
    leaves = parts_as_leaves(load(spark, folder, "part")).withColumn(
        "calories", F.expr("CASE WHEN p_size <> 50 THEN p_size * 100 END")
    )
    kcal = F.struct(F.col("diet_calories_id").alias("dietCaloriesId"), F.col("calories").alias("calories"))
    tiered = leaves.where("tier_id IS NOT NULL")
    options = _nest(
        tiered, ["company_id", "diet_id", "tier_id", "option_key"], kcal, "dietCalories",
        F.max("p_brand").alias("name"), F.min("p_retailprice").alias("low"),
    )
    option = F.struct(
        F.col("option_key").alias("dietOptionId"),
        F.concat("tier_id", F.lit("-"), "option_key").alias("tierDietOptionId"),
        "name", (F.col("option_key") == 1).alias("defaultOption"), "dietCalories",
    )
    tiers = _nest(options, ["company_id", "diet_id", "tier_id"], option, "dietOptions", F.min("low").alias("low"))
    tier = F.struct(
        F.col("tier_id").alias("tierId"), F.concat(F.lit("Tier "), "tier_id").alias("name"),
        _zloty(F.col("low")).alias("minPrice"), F.size("dietOptions").alias("mealsNumber"), "dietOptions",
    )
    tier_lists = _nest(tiers, ["company_id", "diet_id"], tier, "dietTiers")
    # The first two ready parts are listed in the catalogue, the others only on the city card.
    ready = leaves.where("tier_id IS NULL AND p_partkey % 20 < 18")
    flat = F.struct(F.lit(9).alias("dietOptionId"), F.lit("Ready").alias("name"), F.array(kcal).alias("dietCalories"))
    option_lists = _nest(ready, ["company_id", "diet_id"], flat, "dietOptions")
    names = leaves.groupBy("company_id", "diet_id").agg(
        F.min("p_name").alias("name"), F.min("p_type").alias("tag"), F.count("*").alias("n")
    )
    diets = names.join(tier_lists, ["company_id", "diet_id"], "left").join(
        option_lists, ["company_id", "diet_id"], "left"
    )
    diet = F.struct(
        F.col("diet_id").alias("dietId"), "name", F.col("tag").alias("dietTag"), F.col("n").alias("dietMealCount"),
        (F.col("diet_id") < 5).alias("isMenuConfiguration"),
        F.when(
            F.col("diet_id") % 2 == 0,
            F.array(F.struct(F.lit(2.5).alias("discount"), F.lit(10).alias("minimumDays"),
                             F.lit("PERCENTAGE").alias("discountType"))),
        ).alias("discounts"),
        "dietOptions", "dietTiers",
    )
    by_company = _nest(diets, ["company_id"], diet, "companyDiets")
    s = load(spark, folder, "supplier").withColumn("company_id", F.col("s_suppkey").cast("string"))
    rows = s.join(by_company, "company_id").select(
        *_run(F.col("company_id"), F.col("s_suppkey") % 23),
        F.struct(
            F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("name"),
            (F.col("s_suppkey") % 100).cast("double").alias("rateValue"),
            F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal") > 0).alias("awarded"),
            F.struct(
                F.when(F.col("s_suppkey") % 4 == 0, "START").otherwise("").alias("code"),
                F.lit(12.5).alias("discountPercents"), F.lit("2001-02-01").alias("promoDeadline"),
                F.lit(True).alias("separate"),
            ).alias("activePromotionInfo"),
        ).alias("companyHeader"),
        F.struct((F.col("s_suppkey") % 2 == 0).alias("deliveryOnSaturday")).alias("companyParams"),
        F.struct(F.lit(True).alias("menuEnabled"), (F.col("s_suppkey") % 21).alias("menuDaysAhead")).alias("menuSettings"),
        "companyDiets",
    )
    return _json(rows)


def city_card(spark, folder: str) -> DataFrame:
    leaves = parts_as_leaves(load(spark, folder, "part"))
    ids = leaves.groupBy("company_id", "diet_id").agg(
        F.array_sort(F.collect_set("diet_calories_id")).alias("dietCaloriesIds"),
        F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"),
    )
    entry = F.struct(
        F.col("diet_id").alias("dietId"), _zloty(F.col("low")).alias("discountPrice"),
        _zloty(F.col("high")).alias("defaultPrice"), "dietCaloriesIds",
        (F.col("diet_id") == 1).alias("dietPriceInCompanyPromotion"),
    )
    by_company = _nest(ids, ["company_id"], entry, "dietPriceInfo")
    s = load(spark, folder, "supplier").withColumn("company_id", F.col("s_suppkey").cast("string"))
    rows = s.join(by_company, "company_id").select(
        *_run(F.col("company_id"), F.col("s_suppkey") % 23),
        "dietPriceInfo", F.lit("CHEAP").alias("companyPriceCategory"),
        F.struct((F.col("s_suppkey") % 3 == 0).alias("ordersEnabled")).alias("companySettings"),
        F.struct((F.col("s_suppkey") % 23).alias("cityId"), F.lit(4.5).alias("deliveryFee")).alias("citySearchResult"),
        F.struct(
            _zloty(F.abs("s_acctbal")).alias("standard"),
            F.when(F.col("s_suppkey") % 2 == 0, "not a price").alias("menuConfiguration"),
        ).alias("lowestPrice"),
    )
    return _json(rows)


def listing(spark, folder: str) -> DataFrame:
    """Pages of ten companies."""
    s = load(spark, folder, "supplier")
    item = F.struct(
        F.col("s_suppkey").alias("_k"), F.col("s_suppkey").cast("string").alias("name"),
        F.col("s_name").alias("fullName"), (F.abs("s_acctbal") / 2000).alias("rate"),
        (F.col("s_acctbal") > 0).alias("awarded"),
        F.when(
            F.col("s_suppkey") % 3 == 0,
            F.struct(
                F.concat(F.lit("TOP"), F.col("s_suppkey") % 5).alias("code"),
                (F.col("s_suppkey") % 30).cast("double").alias("discountPercents"),
                F.lit("2001-03-01").alias("promoDeadline"),
            ),
        ).alias("activePromotionInfo"),
    )
    pages = _nest(s.withColumn("page", F.expr("s_suppkey DIV 10")), ["page"], item, "searchData")
    rows = pages.select(
        F.lit(7).alias("city_id"), F.lit(RUN_AT).alias("captured_at"), F.col("page").alias("currentPage"), "searchData"
    )
    return _json(rows)


def grown_quotes(spark, folder: str) -> DataFrame:
    """Quotes of orders with fields that no schema names; every seventh is unreadable."""
    k = F.col("o_orderkey")
    loyalty = F.when(k % 3 == 0, F.format_string(',"loyalty":%d', k)).when(k % 3 == 1, F.lit(',"loyalty":"gold"')).otherwise(F.lit(""))
    coupon = F.when(k % 5 == 0, F.lit(',"coupon":{"code":"A","uses":[1,2]}')).otherwise(F.lit(""))
    line = F.concat(
        F.lit('{"company_id":"'), k.cast("string"), F.lit('","captured_at":"2001-01-01T00:00:00Z","cart":{"totalCostToPay":1.5'), coupon,
        F.lit("}"), loyalty, F.when(k % 7 == 0, F.lit(",")).otherwise(F.lit("}")),
    )
    return load(spark, folder, "orders").select(line.alias("payload"))


def torn_listing(spark, folder: str) -> DataFrame:
    """Orders as companies on pages of ten per customer nation, read while the listing changes.

    A city's page is lost where its number leaves 3 by 7, delivered twice where it leaves 4 by 11, and where it leaves 5 by 13 its
    first company was on the page before, too.
    """
    o = load(spark, folder, "orders")
    placed = o.select(
        (F.col("o_custkey") % 25).alias("city_id"), (F.col("o_orderkey") % 3).alias("run"), (F.col("o_orderkey") % 50).alias("page"),
        F.col("o_orderkey").alias("k"),
    )
    item = F.struct(F.col("k").alias("_k"), F.col("k").cast("string").alias("name"))
    pages = _nest(placed, ["city_id", "run", "page"], item, "searchData")
    before = pages.select("city_id", "run", (F.col("page") + 1).alias("page"), F.get("searchData", F.lit(0)).alias("_before"))
    pages = pages.join(before, ["city_id", "run", "page"], "left")
    moved = (F.col("page") % 13 == 5) & F.col("_before").isNotNull()
    pages = pages.withColumn("searchData", F.when(moved, F.concat(F.array("_before"), "searchData")).otherwise(F.col("searchData")))
    copies = F.when(F.col("page") % 7 == 3, 0).when(F.col("page") % 11 == 4, 2).otherwise(1)
    rows = pages.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
    stamp = F.date_add(F.lit("2001-01-01").cast("date"), F.col("run").cast("int"))
    return _json(rows.select(
        "city_id", F.concat(stamp.cast("string"), F.lit("T00:00:00Z")).alias("captured_at"), F.col("page").alias("currentPage"),
        F.lit(52).alias("totalPages"), "searchData",
    ))


def quotes(spark, folder: str) -> DataFrame:
    """Every 50-piece line is an unanswered quote; untaxed open returns are cut off."""
    rows = load(spark, folder, "lineitem").select(
        F.expr("l_returnflag = 'R' AND l_linestatus = 'O' AND l_tax = 0").alias("cut"),
        F.to_json(
            F.struct(
                F.expr("CAST(l_partkey DIV 20 AS STRING)").alias("company_id"),
                F.expr("l_suppkey % 23").alias("city_id"),
                _iso("l_shipdate").alias("captured_at"),
                F.col("l_partkey").alias("diet_calories_id"),
                F.expr("CASE WHEN l_linenumber > 3 THEN concat(l_linenumber, '-1') END").alias("tier_diet_option_id"),
                F.lit(10).alias("order_days"),
                F.expr("CASE WHEN l_linestatus = 'F' THEN array('FIT') END").alias("promo_codes"),
                F.when(
                    F.col("l_quantity") < 50,
                    F.struct(
                        F.col("l_extendedprice").alias("totalCostToPay"),
                        (F.col("l_extendedprice") + 10).alias("totalCostWithoutDiscounts"),
                        F.lit(5.5).alias("totalDeliveryCost"),
                    ),
                ).alias("cart"),
                F.expr(
                    "CASE WHEN l_linenumber = 7 THEN array() ELSE array(struct(l_quantity AS perDayDietCost, "
                    "l_quantity - 0.5D AS perDayDietWithDiscountsCost), struct(1.0D AS perDayDietCost, "
                    "1.0D AS perDayDietWithDiscountsCost)) END"
                ).alias("items"),
            )
        ).alias("text"),
    )
    return rows.select(F.when(F.col("cut"), F.substring("text", 1, 25)).otherwise(F.col("text")).alias("payload"))


def _iso(c: str) -> Column:
    return F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def menus(spark, folder: str) -> DataFrame:
    """One slot with one option per line; every tenth order has no meals list."""
    entry = F.expr(
        """array(struct(
          concat('Slot ', l_linenumber) AS name, l_orderkey % 5 AS baseDietCaloriesMealId,
          array(struct(
            CASE WHEN l_suppkey % 11 <> 0 THEN l_suppkey % 5 END AS dietCaloriesMealId,
            CASE WHEN l_suppkey % 19 <> 0 THEN concat('  Dish ', l_suppkey % 19, '\u00a0') ELSE ' ' END AS name,
            concat(CAST(l_quantity AS INT) * 10, ' kcal • B:', l_linenumber, 'g • W:30,5g • T:11g') AS info,
            l_linenumber AS reviewsNumber, l_quantity AS reviewsScore,
            CASE WHEN l_orderkey % 2 = 1 THEN struct(
              concat(CAST(l_quantity AS INT) * 20, '.45 kcal / 1257 kJ') AS calories,
              concat(l_linenumber, ',87g') AS protein, '0.5 g' AS salt, 'HOT' AS thermo,
              array(map('companyAllergenName', 'x', 'serviceAllergenName', ' Mleko '),
                    map('companyAllergenName', 'y', 'serviceAllergenName', 'Gluten'),
                    map('companyAllergenName', 'z', 'serviceAllergenName', ' '),
                    map('companyAllergenName', 'x', 'serviceAllergenName', 'Mleko')) AS allergensWithExcluded,
              array(struct(' Jajko ' AS name), struct(' ' AS name), struct('Sól' AS name)) AS ingredients
            ) END AS details)) AS options))"""
    )
    rows = load(spark, folder, "lineitem").select(
        F.expr("CAST(l_partkey DIV 20 AS STRING)").alias("company_id"),
        F.expr("l_suppkey % 23").alias("city_id"),
        _iso("l_shipdate").alias("captured_at"),
        F.col("l_partkey").alias("diet_calories_id"),
        F.expr("CASE WHEN l_linenumber > 3 THEN l_linenumber END").alias("tier_id"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        F.when(F.col("l_orderkey") % 10 != 0, entry).alias("meals"),
    )
    return _json(rows)


def banners(spark, folder: str) -> DataFrame:
    rows = load(spark, folder, "orders").select(
        F.expr("o_custkey % 23").alias("city_id"), _iso("o_orderdate").alias("captured_at"),
        F.concat(F.lit("Banner "), F.col("o_orderkey") % 10).alias("name"),
        F.expr("CASE WHEN o_orderstatus = 'F' THEN '' ELSE substring(o_orderpriority, 3) END").alias("code"),
        _iso("o_orderdate").alias("validFrom"), F.lit("DASHBOARD").alias("target"),
        F.concat(F.lit("/b/"), "o_orderkey").alias("deepLink"),
    )
    return _json(rows)


def recommended(spark, folder: str) -> DataFrame:
    rows = load(spark, folder, "orders").select(
        F.expr("o_custkey % 23").alias("city_id"), _iso("o_orderdate").alias("captured_at"),
        F.struct(F.expr("CAST(o_custkey DIV 14 AS STRING)").alias("companyId")).alias("companyData"),
        F.when(
            F.col("o_orderstatus") != "P",
            F.struct(
                F.expr("substring(o_orderpriority, 3)").alias("code"),
                F.expr("CAST(o_orderkey % 40 AS DOUBLE)").alias("discountPercents"),
                F.expr("CAST(date_add(CAST(o_orderdate AS DATE), 30) AS STRING)").alias("promoDeadline"),
                F.lit("tekst").alias("promoText"),
            ),
        ).alias("activePromotion"),
    )
    return _json(rows)


def tag_dictionaries(spark, folder: str) -> DataFrame:
    """One dictionary per part name, keyed by the types it is sold as (a handful)."""
    p = load(spark, folder, "part").select("p_brand", "p_type").distinct()
    entry = F.struct("p_type", F.struct(
        F.concat("p_brand", F.lit("/"), "p_type").alias("dietTagId"), F.lower("p_type").alias("name"),
        F.concat(F.lit("/img/"), "p_type").alias("imageUrl"),
    ))
    rows = p.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(entry)).alias("tags"))
    return _json(rows.select(F.lit(RUN_AT).alias("captured_at"), "tags"))


def city_searches(spark, folder: str) -> DataFrame:
    """One search per region: its nations, of which there are 25 in all."""
    n = load(spark, folder, "nation")
    hit = F.struct(
        F.col("n_nationkey").alias("cityId"), F.col("n_name").alias("name"),
        F.lower("n_name").alias("sanitizedName"), (F.col("n_nationkey") % 6 != 0).alias("cityStatus"),
        (F.col("n_nationkey") * 3).alias("numberOfCompanies"),
    )
    rows = _nest(n, ["n_regionkey"], hit, "cities")
    return _json(rows.select(F.lit(RUN_AT).alias("captured_at"), F.lit("NATION").alias("query"), "cities"))
