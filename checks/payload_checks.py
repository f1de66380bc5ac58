"""Payload normalisation and catalogue folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from larderlog.plans import catering, listings, menus as menu_plans, state
from larderlog.session import work_folder
from larderlog.sources import normalise as n
from larderlog.sources import payloads, sinks
from larderlog.sources.payloads import parse_payload, split_rejects
from larderlog.sources.sinks import append_observations
from larderlog.sources.starviews import load, parts_as_leaves
from larderlog.sources.tables import empty_table, read_tables

from . import payload_texts as texts
from .registry import check, plain

STAMP = "'%Y-%m-%d %H:%M:%S'"


def parsed(spark, folder, kind, text):
    return split_rejects(parse_payload(text(spark, folder), kind, "payload"))[0]


def catalogue(spark, folder):
    return parsed(spark, folder, "catalogue", texts.catalogue)


def card(spark, folder):
    return parsed(spark, folder, "city_card", texts.city_card)


@check(
    """
SELECT CAST(s_suppkey AS VARCHAR) AS company_id, CASE WHEN s_suppkey % 3 <> 0 THEN s_name ELSE
    CAST(s_suppkey AS VARCHAR) END AS name, CAST(s_suppkey % 100 AS DOUBLE) AS avg_score,
  CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal > 0 ELSE false END AS awarded, 'CHEAP' AS price_category,
  s_suppkey % 2 = 0 AS delivery_on_saturday, s_suppkey % 21 AS menu_days_ahead, s_suppkey % 3 = 0 AS orders_enabled
FROM supplier
"""
)
def catalogue_companies(spark, folder):
    rows = n.company_rows(catalogue(spark, folder), card(spark, folder))
    folded = state.fold_companies(empty_table(spark, "companies"), rows)
    return plain(
        folded, "company_id", "name", "avg_score", "awarded", "price_category", "delivery_on_saturday",
        "menu_days_ahead", "orders_enabled",
    )


@check(
    """
SELECT CAST(s_suppkey AS VARCHAR) AS company_id, s_suppkey % 23 AS city_id, 4.5::DOUBLE AS delivery_fee,
  abs(s_acctbal) AS lowest_price_standard, NULL::DOUBLE AS lowest_price_menu_config FROM supplier
"""
)
def catalogue_company_cities(spark, folder):
    rows = n.company_city_rows(card(spark, folder))
    folded = state.fold_company_cities(empty_table(spark, "company_cities"), rows)
    return plain(folded.drop("created_at", "updated_at"))


@check(
    """
SELECT company_id, diet_id, min(p_name) AS name, min(p_type) AS diet_tag, count(*) AS diet_meal_count,
  diet_id < 5 AS is_menu_configuration, CASE WHEN diet_id % 2 = 0 THEN 2.5::DOUBLE END AS discount
FROM leafparts GROUP BY company_id, diet_id
"""
)
def catalogue_diets(spark, folder):
    c = catalogue(spark, folder)
    diets = state.fold_diets(empty_table(spark, "diets"), n.diet_rows(c))
    discounts = state.fold_discounts(empty_table(spark, "diet_discounts"), n.discount_rows(c), diets)
    rows = diets.join(discounts, ["company_id", "diet_id"], "left")
    return plain(rows, "company_id", "diet_id", "name", "diet_tag", "diet_meal_count", "is_menu_configuration", "discount")


@check(
    """
SELECT company_id, diet_id, tier_id, 'Tier ' || tier_id AS name, min(p_retailprice) AS min_price,
  count(DISTINCT option_key) AS meals_number FROM leafparts WHERE tier_id IS NOT NULL GROUP BY ALL
"""
)
def catalogue_tiers(spark, folder):
    folded = state.fold_tiers(empty_table(spark, "tiers"), n.tier_rows(catalogue(spark, folder)))
    return plain(folded, "company_id", "diet_id", "tier_id", "name", "min_price", "meals_number")


@check(
    """
SELECT company_id, diet_id, tier_id, option_key AS diet_option_id, tier_id || '-' || option_key AS tier_diet_option_id,
  max(p_brand) AS name, option_key = 1 AS is_default FROM leafparts WHERE tier_id IS NOT NULL GROUP BY ALL
"""
)
def catalogue_options(spark, folder):
    folded = state.fold_options(empty_table(spark, "diet_options"), n.option_rows(catalogue(spark, folder)))
    return plain(
        folded, "company_id", "diet_id", "tier_id", "diet_option_id", "tier_diet_option_id", "name", "is_default"
    )


@check(
    """
SELECT company_id, diet_id, tier_id, option_key AS diet_option_id, diet_calories_id,
  CASE WHEN p_size <> 50 AND p_partkey % 20 < 18 THEN CAST(p_size AS BIGINT) * 100 END AS calories FROM leafparts
"""
)
def catalogue_leaves(spark, folder):
    rows = n.leaf_rows(catalogue(spark, folder), card(spark, folder))
    folded = state.fold_leaves(empty_table(spark, "diet_calories"), rows)
    return plain(folded, "company_id", "diet_id", "tier_id", "diet_option_id", "diet_calories_id", "calories")


@check(
    """
SELECT p.company_id, p.diet_id, tier_id, coalesce(option_key, 9) AS diet_option_id,
  tier_id || '-' || option_key AS tier_diet_option_id, diet_calories_id,
  CASE WHEN p_size <> 50 THEN CAST(p_size AS BIGINT) * 100 END AS calories, low AS discount_price, p.diet_id = 1 AS in_promotion
FROM leafparts p JOIN (SELECT company_id, diet_id, min(p_retailprice) AS low FROM leafparts GROUP BY ALL) m
  ON m.company_id = p.company_id AND m.diet_id = p.diet_id
WHERE p_partkey % 20 < 18
"""
)
def snapshot_leaves(spark, folder):
    from larderlog.functions.text import money

    rows = n.with_advertised(n.snapshot_leaves(catalogue(spark, folder)), card(spark, folder))
    return plain(
        rows.select(
            "company_id", "diet_id", "tier_id", "diet_option_id", "tier_diet_option_id", "diet_calories_id",
            "calories", money("advertised.discount_price").alias("discount_price"),
            F.col("advertised.in_promotion").alias("in_promotion"),
        )
    )


@check(
    """
SELECT company_id, tier_id, coalesce(option_key, 9) AS diet_option_id,
  arg_min(diet_calories_id, (diet_id, diet_calories_id)) AS diet_calories_id
FROM leafparts WHERE p_partkey % 20 < 18 GROUP BY ALL
"""
)
def snapshot_menu_targets(spark, folder):
    rows = menu_plans.snapshot_menu_targets(n.snapshot_leaves(catalogue(spark, folder)), only_configurable=False)
    return plain(rows, "company_id", "tier_id", "diet_option_id", "diet_calories_id")


@check(
    """
SELECT CAST(s_suppkey AS VARCHAR) AS company_id, s_name AS "fullName", s_suppkey // 10 AS page,
  abs(s_acctbal) / 2000 AS rate FROM supplier
"""
)
def listed_companies(spark, folder):
    rows = n.listing_companies(parsed(spark, folder, "listing", texts.listing))
    return plain(rows.select("company_id", "fullName", F.col("currentPage").alias("page"), "rate"))


@check(
    """
SELECT 'quote' AS feed, field, type, n FROM (
  SELECT 'loyalty' AS field, 'BIGINT' AS type, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0
  UNION ALL SELECT 'loyalty', 'STRING', count(*) FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 7 <> 0
  UNION ALL SELECT 'cart.coupon', 'OBJECT<code: STRING, uses: ARRAY<BIGINT>>', count(*) FROM orders
    WHERE o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0)
"""
)
def appeared_fields(spark, folder):
    """Which fields a feed began to send, and with what types."""
    return plain(payloads.appeared_fields(texts.grown_quotes(spark, folder), "quote", "payload"))


@check(
    """
SELECT CAST(o_orderkey AS VARCHAR) AS company_id, CAST(1.5 AS DOUBLE) AS total_cost, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS points,
  CASE WHEN o_orderkey % 5 = 0 THEN 'A' END AS coupon, o_orderkey % 3 < 2 OR o_orderkey % 5 = 0 AS grown
FROM orders WHERE o_orderkey % 7 <> 0
"""
)
def open_quotes(spark, folder):
    """Known fields as ever, unknown ones kept beside them and read later by path; both written and read again."""
    rows, out = payloads.parse_open_payload(texts.grown_quotes(spark, folder), "quote", "payload"), work_folder(spark, "open-quotes")
    split_rejects(rows)[0].write.parquet(out)
    extra = F.col(payloads.EXTRA)
    return plain(spark.read.parquet(out).select(
        "company_id", F.col("cart.totalCostToPay").alias("total_cost"), F.try_variant_get(extra, "$.loyalty", "bigint").alias("points"),
        F.try_variant_get(extra, "$['cart.coupon'].code", "string").alias("coupon"), extra.isNotNull().alias("grown"),
    ))


TORN = {
    "placed": """SELECT o_custkey % 25 AS city_id, o_orderkey % 3 AS run, o_orderkey % 50 AS page, min(o_orderkey) AS first
      FROM orders GROUP BY ALL""",
    "there": "SELECT * FROM placed WHERE page % 7 <> 3",
}


@check(
    """
SELECT CAST(city_id AS BIGINT) AS city_id, strftime(DATE '2001-01-01' + CAST(run AS INTEGER), '%Y-%m-%d') AS day, kind,
  CAST(from_page AS BIGINT) AS from_page, CAST(to_page AS BIGINT) AS to_page, companies
FROM (
  SELECT city_id, run, 'missing' AS kind, min(page) AS from_page, max(page) AS to_page, CAST(NULL AS BIGINT) AS companies
  FROM (SELECT city_id, run, page, page - row_number() OVER (PARTITION BY city_id, run ORDER BY page) AS island
    FROM (SELECT DISTINCT city_id, run FROM there), generate_series(0, 51) g(page)
    WHERE (city_id, run, page) NOT IN (SELECT (city_id, run, page) FROM there))
  GROUP BY city_id, run, island
  UNION ALL SELECT city_id, run, 'repeated', page, page, NULL FROM there WHERE page % 11 = 4
  UNION ALL SELECT city_id, run, 'shifted', page, page, 1 FROM there
    WHERE page % 13 = 5 AND (city_id, run, page - 1) IN (SELECT (city_id, run, page) FROM there))
"""
    , TORN,
)
def listing_gaps(spark, folder):
    """Pages lost, answered twice, and companies that moved while the listing was read."""
    gaps = listings.listing_gaps(parsed(spark, folder, "listing", texts.torn_listing))
    return plain(gaps.select("city_id", F.to_date("captured_at").alias("day"), "kind", "from_page", "to_page", "companies"))


@check("SELECT 7 AS city_id, count(DISTINCT s_suppkey // 10) AS pages FROM supplier")
def complete_listings(spark, folder):
    """A listing without a gap is complete."""
    listing = parsed(spark, folder, "listing", texts.listing)
    whole = listing.join(listings.complete_captures(listing), listings.CAPTURE, "left_semi")
    return plain(whole.groupBy("city_id").agg(F.countDistinct("currentPage").alias("pages")))


QUOTED = """l_quantity < 50 AND NOT (l_returnflag = 'R' AND l_linestatus = 'O' AND l_tax = 0)"""


@check(
    f"""
SELECT CAST(l_partkey // 20 AS VARCHAR) AS company_id, l_suppkey % 23 AS city_id, l_partkey AS diet_calories_id,
  CASE WHEN l_linenumber > 3 THEN l_linenumber || '-1' END AS tier_diet_option_id,
  CASE WHEN l_linestatus = 'F' THEN 'FIT' ELSE '' END AS promo_codes, l_extendedprice AS total_cost,
  CASE WHEN l_linenumber < 7 THEN l_quantity END AS per_day_cost, 5.5::DOUBLE AS total_delivery_cost,
  CASE WHEN l_linenumber < 7 THEN l_quantity - 0.5 END AS per_day_cost_with_discounts,
  strftime(l_shipdate, {STAMP}) AS captured_at
FROM lineitem WHERE {QUOTED}
"""
)
def quoted_prices(spark, folder):
    rows = n.price_rows(parsed(spark, folder, "quote", texts.quotes))
    return plain(
        rows, "company_id", "city_id", "diet_calories_id", "tier_diet_option_id", "promo_codes", "total_cost",
        "per_day_cost", "total_delivery_cost", "per_day_cost_with_discounts", "captured_at",
    )


@check(
    "SELECT l_returnflag = 'R' AND l_linestatus = 'O' AND l_tax = 0 AS rejected, count(*) AS n "
    "FROM lineitem GROUP BY 1"
)
def rejected_quotes(spark, folder):
    from larderlog.schemas import REJECT_COLUMN

    rows = parse_payload(texts.quotes(spark, folder), "quote", "payload")
    return plain(rows.groupBy(F.col(REJECT_COLUMN).isNotNull().alias("rejected")).agg(F.count("*").alias("n")))


MENU_LINES = """
SELECT CAST(l_partkey // 20 AS VARCHAR) AS company_id, l_partkey AS diet_calories_id,
  CASE WHEN l_linenumber > 3 THEN CAST(l_linenumber AS BIGINT) END AS tier_id, strftime(l_shipdate, '%Y-%m-%d') AS menu_date,
  'Slot ' || l_linenumber AS slot_name, CASE WHEN l_suppkey % 19 <> 0 THEN 'Dish ' || l_suppkey % 19 END AS {name},
  l_suppkey % 5 AS api_meal_slot_id, l_suppkey % 5 = l_orderkey % 5 AS is_default {more}
FROM lineitem WHERE l_orderkey % 10 <> 0 AND l_suppkey % 11 <> 0
"""


@check(
    MENU_LINES.format(
        name="name",
        more=""",
  CASE WHEN l_orderkey % 2 = 1 THEN CAST(l_quantity AS INT) * 20 + 0.45::DOUBLE
    ELSE CAST(l_quantity AS INT) * 10.0::DOUBLE END AS kcal,
  CASE WHEN l_orderkey % 2 = 1 THEN l_linenumber + 0.87::DOUBLE ELSE l_linenumber::DOUBLE END AS protein_g,
  30.5::DOUBLE AS carbs_g, 11::DOUBLE AS fat_g, CASE WHEN l_orderkey % 2 = 1 THEN 0.5::DOUBLE END AS salt_g,
  CASE WHEN l_orderkey % 2 = 1 THEN 'HOT' END AS thermo,
  CASE WHEN l_orderkey % 2 = 1 THEN 'Gluten,Mleko' ELSE '' END AS allergens,
  CASE WHEN l_orderkey % 2 = 1 THEN 'Jajko; Sól' END AS ingredients""",
    )
)
def menu_dishes(spark, folder):
    rows = n.dish_rows(parsed(spark, folder, "menu", texts.menus))
    return plain(
        rows, "company_id", "diet_calories_id", "tier_id", "menu_date", "slot_name", "name", "api_meal_slot_id",
        "is_default", "kcal", "protein_g", "carbs_g", "fat_g", "salt_g", "thermo", "allergens", "ingredients",
    )


@check(MENU_LINES.format(name="meal_name", more=""))
def menu_entries(spark, folder):
    rows = n.daily_menu_rows(n.dish_rows(parsed(spark, folder, "menu", texts.menus)))
    return plain(rows.drop("id", "captured_at", "city_id"))


@check(
    """
SELECT CAST(l_partkey // 20 AS VARCHAR) AS company_id, l_partkey AS diet_calories_id,
  CASE WHEN l_orderkey % 10 <> 0 THEN 'Slot ' || l_linenumber END AS slot,
  CASE WHEN l_orderkey % 10 <> 0 AND l_orderkey % 2 = 1 THEN CAST(l_quantity AS INT) * 20 || '.45 kcal / 1257 kJ'
    END AS calories,
  CASE WHEN l_orderkey % 10 = 0 THEN NULL WHEN l_orderkey % 2 = 1 THEN ' Mleko ,Gluten, ,Mleko' ELSE '' END AS allergens
FROM lineitem
"""
)
def compact_menu_days(spark, folder):
    rows = n.compact_menu_days(parsed(spark, folder, "menu", texts.menus))
    slot = F.get("meals", F.lit(0))
    option = F.get(slot["options"], F.lit(0))
    return plain(
        rows.select(
            "company_id", "diet_calories_id", slot["name"].alias("slot"),
            option["macros"]["calories"].alias("calories"), option["allergens"].alias("allergens"),
        )
    )


FEEDS = """
SELECT CAST(s_suppkey AS VARCHAR) AS company_id, 'TOP' || s_suppkey % 5 AS code, 'awarded-and-top' AS source, 7 AS city_id,
  CAST(s_suppkey % 30 AS DOUBLE) AS discount_percents, '2001-03-01' AS deadline, NULL AS promo_text
FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'START', 'constant', s_suppkey % 23, 12.5, '2001-02-01', NULL
FROM supplier WHERE s_suppkey % 4 = 0
UNION ALL SELECT CAST(o_custkey // 14 AS VARCHAR), substr(o_orderpriority, 3), 'recommended-diets', o_custkey % 23,
  o_orderkey % 40, strftime(CAST(o_orderdate AS DATE) + 30, '%Y-%m-%d'), 'tekst' FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT NULL, substr(o_orderpriority, 3), 'banner', o_custkey % 23, NULL, NULL, 'Banner ' || o_orderkey % 10
FROM orders WHERE o_orderstatus <> 'F'
"""


@check(FEEDS)
def promo_feeds(spark, folder):
    rows = n.promo_rows(
        parsed(spark, folder, "listing", texts.listing),
        catalogue(spark, folder),
        parsed(spark, folder, "banner", texts.banners),
        parsed(spark, folder, "recommended", texts.recommended),
    )
    return plain(rows, "company_id", "code", "source", "city_id", "discount_percents", "deadline", "promo_text")


@check(
    "SELECT DISTINCT p_brand || '/' || p_type AS tag_code, lower(p_type) AS label, CAST(NULL AS VARCHAR) AS description, "
    "'/img/' || p_type AS image_url FROM part"
)
def diet_tags(spark, folder):
    rows = n.tag_rows(parsed(spark, folder, "tag_dictionary", texts.tag_dictionaries))
    return plain(state.fold_diet_tags(empty_table(spark, "diet_tags"), rows))


@check(
    "SELECT CAST(n_nationkey AS BIGINT) AS city_id, n_name AS name, CAST(n_nationkey AS BIGINT) * 3 AS number_of_companies, "
    "n_nationkey % 6 <> 0 AS city_status, false AS largest_city_for_name FROM nation"
)
def searched_cities(spark, folder):
    rows = n.found_cities(parsed(spark, folder, "city_search", texts.city_searches))
    folded = state.fold_cities(empty_table(spark, "cities"), rows)
    return plain(folded, "city_id", "name", "number_of_companies", "city_status", "largest_city_for_name")


@check(
    "SELECT n_nationkey::BIGINT AS city_id, n_name AS name FROM nation WHERE n_nationkey % 6 <> 0 "
    "ORDER BY n_name <> 'NATION_8', n_regionkey, n_nationkey LIMIT 1"
)
def picked_city(spark, folder):
    rows = n.found_cities(parsed(spark, folder, "city_search", texts.city_searches))
    return plain(catering.pick_search_hit(rows, "nation_8"), "city_id", "name")


@check(
    """
SELECT n_name AS name FROM (
  SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS pos FROM nation)
WHERE n_nationkey % 6 <> 0 ORDER BY pos, n_nationkey LIMIT 5
"""
)
def city_suggestions(spark, folder):
    rows = n.found_cities(parsed(spark, folder, "city_search", texts.city_searches))
    return plain(catering.suggest_cities(rows), "name")


@check("SELECT CAST(s_suppkey AS VARCHAR) AS company_id FROM supplier WHERE s_suppkey < 30 AND s_suppkey % 2 = 1 "
       "ORDER BY s_suppkey // 10, s_suppkey LIMIT 12")
def narrowed_listing(spark, folder):
    """A run narrowed to named companies, and of these to the first of the list."""
    only = [str(i) for i in range(1, 30, 2)]
    return plain(n.listing_companies(parsed(spark, folder, "listing", texts.listing), only, 12), "company_id")


@check(
    f"""
SELECT CAST(s_suppkey AS VARCHAR) AS company_id, CAST(s_suppkey % 100 AS DOUBLE) AS avg_score,
  CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal > 0 ELSE false END AS awarded, 'CHEAP' AS price_category
FROM supplier
"""
)
def company_snapshots(spark, folder):
    rows = n.company_snapshot_rows(n.company_rows(catalogue(spark, folder), card(spark, folder)))
    return plain(rows, "company_id", "avg_score", "awarded", "price_category")


@check(
    """
SELECT 'awarded-and-top' AS source, CAST(s_suppkey AS VARCHAR) AS company, 'TOP' || s_suppkey % 5 AS code
FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT 'constant', NULL, 'START' FROM supplier WHERE s_suppkey % 4 = 0
UNION ALL SELECT 'recommended-diets', CAST(o_custkey // 14 AS VARCHAR), substr(o_orderpriority, 3)
FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'banner', NULL, substr(o_orderpriority, 3) FROM orders WHERE o_orderstatus <> 'F'
"""
)
def raw_observations(spark, folder):
    """What the raw record of every feed says about company and code."""
    rows = n.promo_rows(
        parsed(spark, folder, "listing", texts.listing), catalogue(spark, folder),
        parsed(spark, folder, "banner", texts.banners), parsed(spark, folder, "recommended", texts.recommended),
    )
    said = lambda *paths: F.coalesce(*[F.get_json_object("raw", p) for p in paths])
    return plain(
        rows.select(
            "source", said("$.company_id", "$.companyData.companyId").alias("company"),
            said("$.code", "$.activePromotionInfo.code", "$.activePromotion.code").alias("code"),
        )
    )


@check(
    f"""
SELECT CAST(l_partkey // 20 AS VARCHAR) AS company_id, l_partkey AS diet_calories_id, l_extendedprice AS total_cost,
  strftime(l_shipdate, {STAMP}) AS captured_at FROM lineitem WHERE {QUOTED}
"""
)
def appended_prices(spark, folder):
    """Written by capture year and read back as a stored table."""
    out = work_folder(spark, "appended")
    rows = n.price_rows(parsed(spark, folder, "quote", texts.quotes))
    append_observations(rows, f"{out}/prices", "prices", unit="year")
    prices = read_tables(spark, out, ["prices"]).prices
    return plain(prices, "company_id", "diet_calories_id", "total_cost", "captured_at")


@check(
    """
SELECT CAST(s_suppkey AS VARCHAR) AS company_id, s_suppkey % 23 AS city_id, day AS snapshot_date,
  count(diet_calories_id) AS leaves, count(diet_calories_id) FILTER (diet_calories_id % 2 = 0) AS quotes,
  'CHEAP' AS category
FROM supplier CROSS JOIN (VALUES ('2001-01-01'), ('2001-01-02')) runs(day)
LEFT JOIN (FROM leafparts WHERE p_partkey % 20 < 18) ON company_id = CAST(s_suppkey AS VARCHAR)
WHERE s_suppkey IN (SELECT CAST(company_id AS BIGINT) FROM leafparts)
GROUP BY ALL
"""
)
def snapshot_documents(spark, folder):
    """Two runs of all companies; quotes exist for every second leaf."""
    days = F.explode(F.array(*[F.lit(d).cast("timestamp") for d in ("2001-01-01", "2001-01-02")]))
    twice = lambda df: df.drop("captured_at").withColumn("captured_at", days)
    whole, cards = twice(catalogue(spark, folder)), twice(card(spark, folder))
    leaves = n.snapshot_leaves(whole)
    prices = leaves.where("diet_calories_id % 2 = 0").select(
        "city_id", "company_id", "captured_at", "diet_calories_id", "tier_diet_option_id", F.lit(10).alias("order_days")
    )
    docs = sinks.snapshot_documents(whole, leaves, card=cards.drop("dietPriceInfo"), prices=prices)
    quoted = F.aggregate("leaves", F.lit(0), lambda acc, x: acc + F.coalesce(F.size(x["quotes"]), F.lit(0)))
    return plain(
        docs.select(
            "company_id", "city_id", "snapshot_date", F.coalesce(F.size("leaves"), F.lit(0)).alias("leaves"),
            F.coalesce(quoted, F.lit(0)).alias("quotes"), F.col("card.companyPriceCategory").alias("category"),
        )
    )


# -- two runs of a catalogue ------------------------------------------------

RUNS = {
    "one": "SELECT *, TIMESTAMP '2001-01-01' AS at FROM leafparts",
    "listed": """SELECT company_id, diet_id, min(p_name) AS old_name, max(p_name) AS new_name,
        (CAST(company_id AS BIGINT) + diet_id) % 4 <> 0 AND CAST(company_id AS BIGINT) % 9 <> 0 AS again,
        CAST(company_id AS BIGINT) % 9 = 0 AS silent, min(p_type) AS tag FROM one GROUP BY company_id, diet_id""",
}


@check(
    """
SELECT company_id, diet_id, CASE WHEN again THEN new_name ELSE old_name END AS name, tag AS diet_tag,
  CASE WHEN NOT again AND NOT silent THEN '2001-01-02 00:00:00' END AS valid_to,
  CASE WHEN again THEN '2001-01-02 00:00:00' ELSE '2001-01-01 00:00:00' END AS updated_at FROM listed
""",
    RUNS,
)
def retired_diets(spark, folder):
    """Second run renames diets, drops some, and has nothing for every ninth company."""
    parts = parts_as_leaves(load(spark, folder, "part"))
    diets = parts.groupBy("company_id", "diet_id").agg(
        F.min("p_name").alias("old_name"), F.max("p_name").alias("new_name"), F.min("p_type").alias("diet_tag")
    )
    c = F.col("company_id").cast("bigint")

    def run(rows, name, tag, at):
        stamp = F.lit(at).cast("timestamp")
        rows = rows.withColumns(
            {"name": F.col(name), "diet_tag": tag, "captured_at": stamp, "updated_at": stamp, "created_at": stamp}
        )
        return n.typed(rows, "diets", "captured_at", F.lit(0).alias("pos"))

    first = run(diets, "old_name", F.col("diet_tag"), "2001-01-01")
    again = diets.where(((c + F.col("diet_id")) % 4 != 0) & (c % 9 != 0))
    second = run(again, "new_name", F.lit("IGNORED"), "2001-01-02")
    folded = state.fold_diets(state.fold_diets(empty_table(spark, "diets"), first), second)
    return plain(folded, "company_id", "diet_id", "name", "diet_tag", "valid_to", "updated_at")


@check(
    """
SELECT company_id, diet_id, tier_id, diet_option_id, diet_calories_id,
  CAST(coalesce(CASE WHEN p_partkey % 3 <> 0 THEN p_size * 10 END, CASE WHEN p_size <> 50 THEN p_size * 100 END)
    AS BIGINT) AS calories,
  '2001-01-02 00:00:00' AS updated_at
FROM leafparts
"""
)
def merged_leaves(spark, folder):
    """A run without kcal keeps the stored one; keys with NULL parts meet their like."""
    parts = parts_as_leaves(load(spark, folder, "part"))

    def run(calories, at):
        stamp = F.lit(at).cast("timestamp")
        rows = parts.withColumns(
            {"calories": F.expr(calories), "captured_at": stamp, "updated_at": stamp, "created_at": stamp}
        )
        zero = [F.lit(0).alias(c) for c in ("pos", "tier_pos", "option_pos", "leaf_pos")]
        return n.typed(rows, "diet_calories", "captured_at", *zero)

    first = run("CASE WHEN p_size <> 50 THEN p_size * 100 END", "2001-01-01")
    second = run("CASE WHEN p_partkey % 3 <> 0 THEN p_size * 10 END", "2001-01-02")
    folded = state.fold_leaves(state.fold_leaves(empty_table(spark, "diet_calories"), first), second)
    return plain(
        folded, "company_id", "diet_id", "tier_id", "diet_option_id", "diet_calories_id", "calories", "updated_at"
    )


