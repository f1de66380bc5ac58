"""Catering tables derived from a star schema of orders, parts and events.

Lets every query run, and be checked, on general-purpose tables: a part is a
kcal leaf of the supplier whose number is ``partkey div 20``, a line item is a
price quote and a menu entry, an order is a promotion sighting, an event is a
price capture of a time series.  All rows of the tables take part and nothing
is joined, so the derivation is one projection over each table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.state import campaign_rows, fold_campaigns
from .normalise import typed
from .tables import empty_table

CITIES = 23
SLOTS = ["Śniadanie", "II śniadanie", "Obiad - zupa", "Obiad", "Podwieczorek", "Kolacja", "Zupa dnia"]
CODES = ["URGENT", "HIGH", "MEDIUM", "LOW", "LATE"]
EPOCH = "TIMESTAMP '1995-01-01 00:00:00'"
CLOSED = "TIMESTAMP '2001-01-01 00:00:00'"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _money(cents: str) -> Column:
    return F.expr(f"CAST(({cents}) * 0.01BD AS DECIMAL(10,2))")


def _stamp(date: str, key: str) -> Column:
    """A capture minute inside the day of a date column."""
    return F.expr(f"CAST({date} AS TIMESTAMP) + make_dt_interval(0, 0, CAST({key} % 1440 AS INT))")


# Leaf identity of a part number p (0-based position j = p % 20 inside its company).
def _leaf(p: str) -> dict[str, Column]:
    j = f"({p} % 20)"
    return {
        "company_id": F.expr(f"CAST({p} DIV 20 AS STRING)"),
        "diet_id": F.expr(f"{j} DIV 4 + 1"),
        "diet_calories_id": F.expr(f"CASE WHEN {j} >= 16 THEN {p} ELSE {p} - {p} % 2 END + 1"),
        "tier_id": F.expr(f"CASE WHEN {j} < 16 THEN {j} % 2 + 1 END"),
        "option_key": F.expr(f"CASE WHEN {j} < 16 THEN 1 + {j} DIV 8 END"),
    }


def parts_as_leaves(part: DataFrame) -> DataFrame:
    """One row per part with its place in the catalogue; position 15 has no option."""
    leaf = _leaf("p_partkey")
    return part.select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice",
        *[c.alias(n) for n, c in leaf.items()],
    ).withColumn("diet_option_id", F.expr("CASE WHEN p_partkey % 20 <> 15 THEN option_key END"))


def companies(supplier: DataFrame) -> DataFrame:
    s = supplier.withColumn("cents", F.expr("CAST(abs(round(s_acctbal * 100)) AS BIGINT)"))
    rows = s.select(
        F.expr("CAST(s_suppkey AS STRING)").alias("company_id"),
        F.col("s_name").alias("name"),
        _money("cents DIV 100").alias("avg_score"),
        _money("cents % 1000").alias("feedback_value"),
        F.expr("cents % 5000").alias("feedback_number"),
        F.expr("s_acctbal > 5000").alias("awarded"),
        F.expr("element_at(array('CHEAP', 'MEDIUM', 'EXPENSIVE'), CAST(cents % 3 + 1 AS INT))").alias("price_category"),
        F.expr("s_suppkey % 2 = 0").alias("delivery_on_saturday"),
        F.expr("s_suppkey % 5 = 0").alias("delivery_on_sunday"),
        F.expr("CASE s_suppkey % 4 WHEN 1 THEN false WHEN 0 THEN NULL ELSE true END").alias("menu_enabled"),
        F.expr("CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE s_suppkey % 21 END").alias("menu_days_ahead"),
        F.expr("CASE s_suppkey % 5 WHEN 1 THEN false WHEN 2 THEN NULL ELSE true END").alias("orders_enabled"),
        F.lit(True).alias("delivery_enabled"),
        F.expr(EPOCH).alias("created_at"),
        F.expr(EPOCH).alias("updated_at"),
    )
    return typed(rows, "companies")


def cities(nation: DataFrame, region: DataFrame) -> DataFrame:
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(
        F.col("n_nationkey").alias("city_id"),
        F.col("n_name").alias("name"),
        F.expr("lower(replace(n_name, '_', '-'))").alias("sanitized_name"),
        F.col("r_name").alias("province_name"),
        F.expr("n_nationkey % 6 <> 0").alias("city_status"),
        F.expr("CAST(n_nationkey * 3 % 17 AS INT)").alias("number_of_companies"),
        F.expr("n_nationkey % 2 = 0").alias("largest_city_for_name"),
    )
    return typed(rows, "cities")


def company_cities(supplier: DataFrame) -> DataFrame:
    rows = supplier.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).select(
        F.expr("CAST(s_suppkey AS STRING)").alias("company_id"),
        F.expr(f"CAST((s_suppkey + i) % {CITIES} AS BIGINT)").alias("city_id"),
        _money("s_suppkey % 7 * 100").alias("delivery_fee"),
    )
    return typed(rows, "company_cities")


def diets(leaves: DataFrame) -> DataFrame:
    g = leaves.groupBy("company_id", "diet_id").agg(
        F.min("p_name").alias("name"), F.max("p_name").alias("description"),
        F.min("p_type").alias("diet_tag"), F.count(F.lit(1)).alias("diet_meal_count"),
    )
    rows = g.select(
        "*",
        F.expr("diet_id < 5").alias("is_menu_configuration"),
        F.expr(f"CASE WHEN (CAST(company_id AS BIGINT) + diet_id) % 11 = 0 THEN {CLOSED} END").alias("valid_to"),
        F.expr(EPOCH).alias("valid_from"),
    )
    return typed(rows, "diets")


def tiers(leaves: DataFrame) -> DataFrame:
    g = leaves.where("tier_id IS NOT NULL").groupBy("company_id", "diet_id", "tier_id").agg(
        F.min("p_brand").alias("name"), F.min("p_retailprice").alias("min_price"),
        F.count(F.lit(1)).alias("meals_number"),
    )
    rows = g.select(
        "*",
        F.expr(
            f"CASE WHEN (CAST(company_id AS BIGINT) + diet_id + tier_id) % 13 = 0 THEN {CLOSED} END"
        ).alias("valid_to"),
    )
    return typed(rows, "tiers")


def diet_options(leaves: DataFrame) -> DataFrame:
    keys = ["company_id", "diet_id", "tier_id", "diet_option_id"]
    g = leaves.where("diet_option_id IS NOT NULL").groupBy(*keys).agg(F.max("p_brand").alias("name"))
    rows = g.select(
        "*",
        F.expr("concat(tier_id, '-', diet_option_id)").alias("tier_diet_option_id"),
        F.expr("diet_option_id = 1").alias("is_default"),
        F.expr(
            f"CASE WHEN (CAST(company_id AS BIGINT) + diet_id * 3 + tier_id) % 17 = 0 THEN {CLOSED} END"
        ).alias("valid_to"),
    )
    return typed(rows, "diet_options")


def diet_calories(leaves: DataFrame) -> DataFrame:
    rows = leaves.select(
        "company_id", "diet_id", "tier_id", "diet_option_id", "diet_calories_id",
        F.expr("CASE WHEN p_size <> 50 THEN p_size * 100 END").alias("calories"),
        F.expr(f"CASE WHEN p_size % 10 = 0 AND p_size <> 50 THEN {CLOSED} END").alias("valid_to"),
    )
    return typed(rows, "diet_calories")


def line_id() -> Column:
    return F.expr("(l_orderkey * 8 + l_linenumber) * 100000 + l_partkey % 100000")


def prices(lineitem: DataFrame) -> DataFrame:
    """Catalogue form: 5/10/20-day quotes, some without total, some with a code."""
    leaf = _leaf("l_partkey")
    base = lineitem.select(
        line_id().alias("id"),
        *[c.alias(n) for n, c in leaf.items() if n != "diet_id"],
        F.expr(f"(l_partkey DIV 20 + l_linenumber % 2) % {CITIES}").alias("city_id"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 5 WHEN 'N' THEN 10 ELSE 20 END").alias("n"),
        F.expr("CAST(round(l_extendedprice * 100) AS BIGINT)").alias("c"),
        F.expr("CAST(round(l_discount * 100) AS BIGINT)").alias("d"),
        F.expr("CAST(round(l_tax * 100) AS BIGINT)").alias("x"),
        F.expr("l_linestatus = 'F'").alias("coded"),
        F.expr("l_quantity < 50").alias("priced"),
        "l_linenumber",
        _stamp("l_shipdate", "l_orderkey").alias("captured_at"),
    )
    codes = ", ".join(f"'{c}'" for c in CODES)
    rows = base.select(
        "id", "diet_calories_id", "company_id", "city_id", "captured_at",
        F.expr("concat(tier_id, '-', option_key)").alias("tier_diet_option_id"),
        F.col("n").alias("order_days"),
        F.expr(
            f"CASE WHEN coded THEN array(element_at(array({codes}), CAST(d % 5 + 1 AS INT))) "
            "ELSE CAST(array() AS ARRAY<STRING>) END"
        ).alias("promo_codes"),
        _money("(2 * c + n) DIV (2 * n)").alias("per_day_cost"),
        _money("(c * (100 - d)) DIV (100 * n)").alias("per_day_cost_with_discounts"),
        F.when(F.col("priced"), _money("c")).alias("total_cost"),
        _money("c + 1000").alias("total_cost_without_discounts"),
        _money("l_linenumber * 100").alias("total_delivery_cost"),
        _money("c * x DIV 100").alias("total_order_length_discount"),
        F.when(F.col("coded"), _money("c * d DIV 100")).otherwise(_money("0")).alias("total_promo_code_discount"),
        _money("0").alias("total_delivery_discount"),
    )
    return typed(rows, "prices")


def price_series(events: DataFrame) -> DataFrame:
    """Time-series form: unique instants, prices in steps of 20, some unknown."""
    base = events.select(
        "event_id", "user_id", "event_type",
        F.expr("CAST(round(value * 100) AS BIGINT)").alias("c"),
        F.expr("CAST(get_json_object(props, '$.k') AS INT)").alias("k"),
        F.col("ts").cast("timestamp").alias("captured_at"),
    )
    rows = base.select(
        F.col("event_id").alias("id"), "captured_at",
        F.col("user_id").cast("string").alias("company_id"),
        F.lit(0).alias("city_id"),
        F.expr("CAST(length(event_type) AS BIGINT)").alias("diet_calories_id"),
        F.lit(10).alias("order_days"),
        F.expr(
            "CASE WHEN k % 3 = 0 THEN CAST(array() AS ARRAY<STRING>) ELSE array(concat('K', k % 3)) END"
        ).alias("promo_codes"),
        F.when(F.expr("k % 10 <> 0"), _money("c DIV 2000 * 2000")).alias("per_day_cost_with_discounts"),
        F.when(F.expr("k % 10 <> 0"), _money("c * 10")).alias("total_cost"),
    )
    return typed(rows, "prices")


def promo_observations(orders: DataFrame) -> DataFrame:
    """Sightings of codes by three feeds; some without company, some of unknown companies."""
    base = orders.select(
        "*",
        F.expr("CAST(round(o_totalprice * 100) AS BIGINT)").alias("c"),
        F.expr("CAST(o_orderdate AS DATE)").alias("day"),
        _stamp("o_orderdate", "o_orderkey").alias("captured_at"),
    )
    rows = base.select(
        F.col("o_orderkey").alias("id"), "captured_at",
        F.expr(
            "CASE WHEN o_orderstatus = 'F' THEN lower(substring(o_orderpriority, 3)) "
            "ELSE substring(o_orderpriority, 3) END"
        ).alias("code"),
        F.expr(
            "CASE o_orderstatus WHEN 'O' THEN 'awarded-and-top' WHEN 'P' THEN 'banner' ELSE 'constant' END"
        ).alias("source"),
        F.expr("CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_custkey DIV 14 AS STRING) END").alias("company_id"),
        F.expr("o_custkey % 23").alias("city_id"),
        F.when(F.expr("o_orderkey % 4 <> 0"), _money("c % 4100")).cast("decimal(5,2)").alias("discount_percents"),
        F.expr("CASE WHEN o_orderkey % 5 <> 0 THEN concat('promo ', o_orderkey % 10) END").alias("promo_text"),
        F.expr("CASE WHEN o_orderkey % 3 <> 0 THEN date_add(day, 30) END").alias("deadline"),
        F.expr("o_orderkey % 2 = 0").alias("separate"),
        F.expr("CASE WHEN o_orderstatus = 'P' THEN CAST(day AS TIMESTAMP) END").alias("valid_from"),
        F.expr("CASE WHEN o_orderstatus = 'P' THEN CAST(date_add(day, 60) AS TIMESTAMP) END").alias("valid_to"),
    )
    feed = F.expr("CASE source WHEN 'awarded-and-top' THEN 0 WHEN 'constant' THEN 1 ELSE 3 END")
    return typed(rows.withColumn("feed", feed), "promo_observations", "feed")


def dishes(lineitem: DataFrame) -> DataFrame:
    """Menu entries in the flat form of ``normalise.dish_rows``, ordered by ``seq``."""
    leaf = _leaf("l_partkey")
    slots = ", ".join(f"'{s}'" for s in SLOTS)
    base = lineitem.select(
        line_id().alias("seq"),
        *[c.alias(n) for n, c in leaf.items() if n != "diet_id"],
        F.expr(f"(l_partkey DIV 20 + l_linenumber % 2) % {CITIES}").alias("city_id"),
        F.expr("date_add(CAST(l_shipdate AS DATE), l_linenumber)").alias("menu_date"),
        F.expr(f"element_at(array({slots}), l_linenumber)").alias("slot_name"),
        F.expr("l_suppkey % 5").alias("api_meal_slot_id"),
        F.expr("l_suppkey % 5 = l_orderkey % 5").alias("is_default"),
        F.expr("CASE WHEN l_suppkey % 19 <> 0 THEN concat('Dish ', l_suppkey % 19) END").alias("name"),
        F.expr("CAST(floor(l_quantity / 10) * 100 AS DECIMAL(7,2))").alias("kcal"),
        F.expr("CAST(l_linenumber % 2 AS DECIMAL(7,2))").alias("protein_g"),
        _stamp("l_shipdate", "l_orderkey").alias("captured_at"),
    )
    known = {"seq", "option_key", "company_id", "diet_calories_id", "tier_id", "city_id", "menu_date",
             "slot_name", "api_meal_slot_id", "is_default", "captured_at"}
    fields = typed(base, "meals", *sorted(known - {"company_id"}))
    numbers = ["kcal", "protein_g", "carbs_g", "fat_g", "reviews_score", "reviews_number"]
    mark = F.sha1(F.to_json(F.struct(F.coalesce("name", F.lit("")).alias("n"), *numbers), {"ignoreNullFields": "false"}))
    return fields.withColumn("fingerprint", mark)


def daily_menu(dish_view: DataFrame) -> DataFrame:
    return typed(dish_view.withColumns({"id": F.col("seq"), "meal_name": F.col("name")}), "daily_menu")


def latest_meals(dish_view: DataFrame) -> DataFrame:
    """Dish table as if every entry had been folded: last values per (company, name)."""
    named = dish_view.where("name IS NOT NULL")
    fields = ["label", "kcal", "protein_g", "fat_g", "carbs_g", "fingerprint"]
    g = named.groupBy("company_id", "name").agg(
        F.max_by(F.struct(*fields), F.struct("captured_at", "seq")).alias("v"),
        F.min("captured_at").alias("first_seen_at"), F.max("captured_at").alias("last_seen_at"),
    )
    return typed(g.select("*", "v.*"), "meals")


class StarTables:
    """The stored tables over a star schema folder, each built on first use."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _load(self, name: str) -> DataFrame:
        return load(self.spark, self.folder, name)

    @cached_property
    def _leaves(self) -> DataFrame:
        return parts_as_leaves(self._load("part"))

    @cached_property
    def dishes(self) -> DataFrame:
        return dishes(self._load("lineitem"))

    @cached_property
    def cities(self) -> DataFrame:
        return cities(self._load("nation"), self._load("region"))

    @cached_property
    def companies(self) -> DataFrame:
        return companies(self._load("supplier"))

    @cached_property
    def company_cities(self) -> DataFrame:
        return company_cities(self._load("supplier"))

    @cached_property
    def diets(self) -> DataFrame:
        return diets(self._leaves)

    @cached_property
    def tiers(self) -> DataFrame:
        return tiers(self._leaves)

    @cached_property
    def diet_options(self) -> DataFrame:
        return diet_options(self._leaves)

    @cached_property
    def diet_calories(self) -> DataFrame:
        return diet_calories(self._leaves)

    @cached_property
    def prices(self) -> DataFrame:
        return prices(self._load("lineitem"))

    @cached_property
    def promo_observations(self) -> DataFrame:
        return promo_observations(self._load("orders"))

    @cached_property
    def campaigns(self) -> DataFrame:
        """Folded from all sightings; ends 15 days after the deadline."""
        rows = campaign_rows(self.promo_observations, self.companies)
        folded = fold_campaigns(empty_table(self.spark, "campaigns"), rows)
        return folded.withColumn("ends_at", F.date_add("deadline", 15))

    @cached_property
    def meals(self) -> DataFrame:
        return latest_meals(self.dishes)

    @cached_property
    def daily_menu(self) -> DataFrame:
        return daily_menu(self.dishes)


def star_tables(spark: SparkSession, folder: str) -> StarTables:
    return StarTables(spark, folder)
