"""Menus, dishes and their drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from larderlog.functions.keys import offer_key, slot_rank
from larderlog.plans import menus, snapshots, state
from larderlog.session import work_folder
from larderlog.sources.sinks import settle, write_compared
from larderlog.sources.starviews import dishes, load, star_tables
from larderlog.sources.tables import empty_table

from .registry import AS_OF, check, plain

STAMP = "'%Y-%m-%d %H:%M:%S'"


@check(
    f"""
SELECT DISTINCT ON (company_id, city_id, diet_calories_id, tier_id, menu_date, slot_name, name)
  seq AS id, company_id, city_id, diet_calories_id, tier_id, strftime(menu_date, '%Y-%m-%d') AS menu_date, slot_name,
  name AS meal_name, is_default, strftime(captured_at, {STAMP}) AS captured_at
FROM dishes
ORDER BY company_id, city_id, diet_calories_id, tier_id, menu_date, slot_name, name, captured_at DESC, seq DESC
"""
)
def current_daily_menu(spark, folder):
    rows = menus.current_daily_menu(star_tables(spark, folder).daily_menu)
    return plain(rows.drop("api_meal_slot_id"))


LINEUP = {
    "grouped": """SELECT DISTINCT company_id, diet_calories_id, diet_id, tier_id AS t, diet_option_id AS o
      FROM diet_calories""",
    "lineup": """SELECT g.company_id, g.diet_id, g.t AS tier_id, g.o AS diet_option_id, d.slot_name, m.name, m.kcal,
        m.protein_g, strftime(max(d.menu_date), '%Y-%m-%d') AS last_seen_date,
        count(DISTINCT d.menu_date) AS occurrences
      FROM dishes d JOIN meals m ON m.company_id = d.company_id AND m.name = d.name
      JOIN grouped g ON g.company_id = d.company_id AND g.diet_calories_id = d.diet_calories_id
      WHERE d.menu_date >= DATE '1998-06-01' - 14
      GROUP BY ALL""",
}


@check(
    """SELECT company_id, diet_id, tier_id, diet_option_id, slot_name, name, CAST(kcal AS DOUBLE) AS kcal,
  CAST(protein_g AS DOUBLE) AS protein_g, last_seen_date, occurrences FROM lineup""",
    LINEUP,
)
def option_meals(spark, folder):
    rows = menus.option_meals(star_tables(spark, folder), as_of=AS_OF)
    return plain(rows.drop("label", "fat_g", "carbs_g", "image_url", "allergens"))


def _option_meals_of_days(spark, folder, as_of):
    """Bitmaps of three batches of captures; every batch has days of many months, and the last repeats the first."""
    t, out = star_tables(spark, folder), work_folder(spark, "served-days")
    for n in range(4):
        batch = t.daily_menu.where(F.col("id") % 3 == n % 3)
        menus.served_days(batch).hint("rebalance", "month").write.partitionBy("month").parquet(f"{out}/batch={n}")
    served = spark.read.parquet(out).drop("batch")
    rows = menus.option_meals_of_days(t, menus.merged_days(served), as_of=as_of)
    return plain(rows.select(
        "company_id", "diet_id", "tier_id", "diet_option_id", "slot_name", "name", "kcal", "protein_g", "last_seen_date", "occurrences"
    ))


LINEUP_SQL = """SELECT company_id, diet_id, tier_id, diet_option_id, slot_name, name, CAST(kcal AS DOUBLE) AS kcal,
  CAST(protein_g AS DOUBLE) AS protein_g, last_seen_date, occurrences FROM lineup"""


@check(LINEUP_SQL, LINEUP)
def option_meals_bitmaps(spark, folder):
    return _option_meals_of_days(spark, folder, AS_OF)


@check(LINEUP_SQL, {k: v.replace("1998-06-01", "1996-03-09") for k, v in LINEUP.items()})
def option_meals_bitmaps_earlier(spark, folder):
    """The same stored days, asked for a window that begins inside an earlier month."""
    return _option_meals_of_days(spark, folder, "1996-03-09")


@check(
    """
SELECT slot_name, m.name, CAST(m.kcal AS DOUBLE) AS kcal, strftime(max(d.menu_date), '%Y-%m-%d') AS last_seen_date,
  count(DISTINCT d.menu_date) AS occurrences
FROM dishes d JOIN meals m ON m.company_id = d.company_id AND m.name = d.name
WHERE d.company_id = '3' AND d.menu_date >= DATE '1998-06-01' - 14 AND d.diet_calories_id IN (
  SELECT s.diet_calories_id FROM diet_calories s, (SELECT * FROM diet_calories WHERE company_id = '3'
    AND diet_calories_id = 63 ORDER BY (tier_id IS NOT DISTINCT FROM 2) DESC LIMIT 1) t
  WHERE s.company_id = '3' AND s.diet_id = t.diet_id AND s.tier_id IS NOT DISTINCT FROM t.tier_id
    AND s.diet_option_id IS NOT DISTINCT FROM t.diet_option_id)
GROUP BY slot_name, m.name, m.kcal
"""
)
def variant_meals(spark, folder):
    rows = menus.variant_meals(star_tables(spark, folder), "3", 63, tier=2, as_of=AS_OF)
    return plain(rows, "slot_name", "name", "kcal", "last_seen_date", "occurrences")


RANK = """CAST(CASE slot_name WHEN 'Śniadanie' THEN 0 WHEN 'II śniadanie' THEN 2 WHEN 'Obiad' THEN 4
  WHEN 'Obiad - zupa' THEN 4 WHEN 'Podwieczorek' THEN 5 WHEN 'Kolacja' THEN 7 ELSE 8 END AS BIGINT)"""


@check(
    f"""
SELECT company_id, diet_id, tier_id, diet_option_id, slot_name, {RANK} AS slot_rank, count(*) AS dishes,
  string_agg(name, ',' ORDER BY occurrences DESC, last_seen_date DESC, name) AS names
FROM lineup GROUP BY ALL
""",
    LINEUP,
)
def meals_by_slot(spark, folder):
    keys = ["company_id", "diet_id", "tier_id", "diet_option_id"]
    rows = menus.meals_by_slot(menus.option_meals(star_tables(spark, folder), as_of=AS_OF), keys)
    return plain(
        rows.select(
            *keys, "slot_name", "slot_rank", F.col("dishes").cast("bigint").alias("dishes"),
            F.col("meals.name").alias("names"),
        )
    )


@check(
    f"SELECT company_id, slot_name, {RANK} AS slot_rank, count(DISTINCT name) AS dishes, count(*) AS rows "
    "FROM dishes GROUP BY company_id, slot_name"
)
def planned_per_slot(spark, folder):
    return plain(menus.planned_per_slot(star_tables(spark, folder).daily_menu))


TARGETS = {
    "targets": """SELECT company_id, diet_id, tier_id, diet_option_id, any_value(is_menu_configuration) AS is_menu_configuration,
        arg_min(diet_calories_id, (calories IS NULL, coalesce(calories, 0), diet_calories_id)) AS diet_calories_id
      FROM (FROM diet_calories WHERE valid_to IS NULL)
      JOIN (SELECT company_id, diet_id, is_menu_configuration FROM diets WHERE valid_to IS NULL) USING (company_id, diet_id)
      GROUP BY company_id, diet_id, tier_id, diet_option_id""",
}


@check(
    "SELECT company_id, diet_id, tier_id, diet_option_id, diet_calories_id, is_menu_configuration FROM targets",
    TARGETS,
)
def menu_targets(spark, folder):
    return plain(menus.menu_targets(star_tables(spark, folder)))


@check(
    """
SELECT t.company_id, t.diet_calories_id, t.tier_id, t.is_menu_configuration,
  strftime(DATE '1998-06-01' + CAST(i AS INTEGER), '%Y-%m-%d') AS menu_date
FROM targets t JOIN companies c ON c.company_id = t.company_id, generate_series(0, 13) g(i)
WHERE c.menu_enabled IS DISTINCT FROM false
  AND i < greatest(1, least(coalesce(nullif(c.menu_days_ahead, 0), 7), 14))
""",
    TARGETS,
)
def menu_jobs(spark, folder):
    return plain(menus.menu_jobs(star_tables(spark, folder), as_of=AS_OF, cap=14))


@check(
    """
SELECT o.offer_id, strftime(o.d, '%Y-%m-%d') AS menu_date, m.city_id, coalesce(m.slots, 0) AS slots,
  coalesce(m.options, 0) AS options, m.first_slot
FROM (SELECT DISTINCT 'v1:' || company_id || ':' || diet_calories_id ||
    CASE WHEN tier_id IS NULL THEN '' ELSE ':' || tier_id || '-' || option_key END AS offer_id,
    company_id, diet_calories_id, tier_id, unnest([DATE '1998-06-01', DATE '1998-06-02']) AS d FROM dishes) o
LEFT JOIN (SELECT company_id, diet_calories_id, tier_id, menu_date, city_id, count(DISTINCT slot_name) AS slots,
    count(DISTINCT (slot_name, name)) AS options, arg_min(slot_name, (rank, slot_name)) AS first_slot
  FROM (SELECT *, """
    + RANK
    + """ AS rank FROM dishes) GROUP BY ALL) m ON m.company_id = o.company_id
  AND m.diet_calories_id = o.diet_calories_id AND m.tier_id IS NOT DISTINCT FROM o.tier_id AND m.menu_date = o.d
"""
)
def menu_calendar(spark, folder):
    t = star_tables(spark, folder)
    lines = dishes(load(spark, folder, "lineitem"))
    offers = lines.select(
        offer_key(
            "company_id", "diet_calories_id", F.expr("concat(tier_id, '-', option_key)"),
            F.col("tier_id").isNotNull(),
        ).alias("offer_id")
    ).distinct()
    rows = menus.menu_calendar(t, offers, ["1998-06-01", "1998-06-02"])
    return plain(
        rows.select(
            "offer_id", "menu_date", "city_id", F.size("slots").alias("slots"),
            F.aggregate("slots", F.lit(0), lambda n, s: n + F.size(s["options"])).alias("options"),
            F.get("slots", F.lit(0))["slot_name"].alias("first_slot"),
        )
    )


@check(
    f"""
SELECT company_id, name, CAST(arg_max(kcal, (captured_at, seq)) AS DOUBLE) AS kcal,
  strftime(min(captured_at), {STAMP}) AS first_seen_at, strftime(max(captured_at), {STAMP}) AS last_seen_at,
  strftime(max(captured_at) FILTER (before IS DISTINCT FROM fingerprint), {STAMP}) AS updated_at
FROM (SELECT *, lag(fingerprint) OVER (PARTITION BY company_id, name ORDER BY captured_at, seq) AS before
  FROM dishes WHERE name IS NOT NULL)
GROUP BY company_id, name
"""
)
def meals_folded(spark, folder):
    """Two batches folded in turn, with the second seeded by the state of the first."""
    lines = dishes(load(spark, folder, "lineitem"))
    early = F.col("captured_at") < F.lit(AS_OF).cast("timestamp")
    none = empty_table(spark, "meals")
    first = settle(state.fold_meals(none, state.dish_sightings(none, lines.where(early), ["seq"])), "meals")
    second = state.fold_meals(first, state.dish_sightings(first, lines.where(~early), ["seq"]))
    return plain(second, "company_id", "name", "kcal", "first_seen_at", "last_seen_at", "updated_at")


DRIFT = f"""
SELECT company_id, name, CAST(kcal AS DOUBLE) AS kcal, CAST(protein_g AS DOUBLE) AS protein_g,
  strftime(captured_at, {STAMP}) AS captured_at
FROM (SELECT *, lag(fingerprint) OVER (PARTITION BY company_id, name ORDER BY captured_at, seq) AS before
  FROM dishes WHERE name IS NOT NULL)
WHERE before <> fingerprint
"""


@check(DRIFT)
def dish_drift(spark, folder):
    lines = dishes(load(spark, folder, "lineitem"))
    seen = state.dish_sightings(empty_table(spark, "meals"), lines, ["seq"])
    return plain(state.drift_events(seen), "company_id", "name", "kcal", "protein_g", "captured_at")


@check(DRIFT)
def dish_drift_hot_keys(spark, folder):
    """The same in segments of a year."""
    lines = dishes(load(spark, folder, "lineitem"))
    seen = state.dish_sightings(empty_table(spark, "meals"), lines, ["seq"], unit="year")
    return plain(state.drift_events(seen), "company_id", "name", "kcal", "protein_g", "captured_at")


MENUS = {
    f"{side}": f"""SELECT company_id, city_id, diet_calories_id, tier_id, slot_name, coalesce(name, '') AS name,
        bool_or(is_default) AS v FROM dishes WHERE captured_at {op} TIMESTAMP '1998-06-01' GROUP BY ALL"""
    for side, op in (("a", "<"), ("b", ">="))
}


@check(
    """
SELECT coalesce(a.company_id, b.company_id) AS company_id, coalesce(a.city_id, b.city_id) AS city_id,
  coalesce(a.diet_calories_id, b.diet_calories_id) AS diet_calories_id, coalesce(a.tier_id, b.tier_id) AS tier_id,
  coalesce(a.slot_name, b.slot_name) AS slot_name, coalesce(a.name, b.name) AS meal_name,
  CASE WHEN a.company_id IS NULL THEN 'added' WHEN b.company_id IS NULL THEN 'removed' ELSE 'changed' END AS status
FROM a FULL JOIN b ON a.company_id = b.company_id AND a.city_id = b.city_id AND a.slot_name = b.slot_name
  AND a.diet_calories_id = b.diet_calories_id AND a.tier_id IS NOT DISTINCT FROM b.tier_id AND a.name = b.name
WHERE a.company_id IS NULL OR b.company_id IS NULL OR a.v <> b.v
""",
    MENUS,
)
def menu_snapshot_diff(spark, folder):
    menu = star_tables(spark, folder).daily_menu
    keys = [c for c in snapshots.MENU_ITEM if c not in ("menu_date", "meal_name")]
    early = F.col("captured_at") < F.lit(AS_OF).cast("timestamp")
    sides = [
        menu.where(c)
        .groupBy(*keys, F.coalesce("meal_name", F.lit("")).alias("meal_name"))
        .agg(F.bool_or("is_default").alias("is_default"))
        .withColumn("menu_date", F.lit("1998-06-01").cast("date"))
        for c in (early, ~early)
    ]
    return plain(snapshots.menu_diff(*sides), *keys, "meal_name", "status")


LATER_MENUS = {
    side: f"""SELECT company_id, city_id, diet_calories_id, tier_id, menu_date, slot_name, coalesce(name, '') AS name,
        bool_or(is_default) AS v FROM dishes WHERE {which} GROUP BY ALL"""
    for side, which in (("a", "captured_at < TIMESTAMP '1998-06-01'"), ("b", "true"))
}


@check(
    """
SELECT b.company_id, b.city_id, b.diet_calories_id, b.tier_id, strftime(b.menu_date, '%Y-%m-%d') AS menu_date, b.slot_name,
  b.name AS meal_name, CASE WHEN a.company_id IS NULL THEN 'added' ELSE 'changed' END AS status,
  a.v AS is_default_before, b.v AS is_default_after
FROM b LEFT JOIN a ON a.company_id = b.company_id AND a.city_id = b.city_id AND a.slot_name = b.slot_name
  AND a.diet_calories_id = b.diet_calories_id AND a.tier_id IS NOT DISTINCT FROM b.tier_id AND a.name = b.name
  AND a.menu_date = b.menu_date
WHERE a.company_id IS NULL OR a.v <> b.v
""",
    LATER_MENUS,
)
def menu_snapshot_diff_pruned(spark, folder):
    """Stored menus before and after the last year's captures: the days of earlier years have equal digests."""
    menu, out = star_tables(spark, folder).daily_menu, work_folder(spark, "menu-snapshots")
    levels = [["menu_year"], ["menu_year", "menu_date", "company_id"]]
    keys, values = [*snapshots.MENU_ITEM, "menu_year"], ["is_default"]
    for name, which in (("a", F.col("captured_at") < F.lit(AS_OF).cast("timestamp")), ("b", F.lit(True))):
        side = menu.where(which).withColumns({"menu_year": F.year("menu_date"), "meal_name": F.coalesce("meal_name", F.lit(""))})
        side = side.select(*keys, *values)
        write_compared(side, f"{out}/{name}", levels, keys, values, merge={"is_default": F.bool_or("is_default")})
    diff = snapshots.stored_diff(spark, f"{out}/a", f"{out}/b", side.schema, levels, keys, values)
    return plain(diff.drop("menu_year"))


@check(f"SELECT slot_name, count(*) AS n, {RANK} AS rank FROM dishes GROUP BY slot_name")
def slot_order(spark, folder):
    rows = dishes(load(spark, folder, "lineitem")).groupBy("slot_name").agg(F.count("*").alias("n"))
    return plain(rows.withColumn("rank", slot_rank("slot_name")))
