"""Cities, prices and the catering page."""

from __future__ import annotations

from pyspark.sql import functions as F

from larderlog.functions.dates import bucket
from larderlog.functions.keys import offer_key, price_delta, tier_option_id
from larderlog.functions.text import joined_line
from larderlog.operators.keyed import best_per_bucket
from larderlog.plans import catering, offers, pricing, snapshots
from larderlog.plans.arguments import page_args
from larderlog.session import work_folder
from larderlog.sources.sinks import write_compared
from larderlog.sources.starviews import load, price_series, star_tables

from .registry import AS_OF, MICROS, check, plain

PAGE = page_args(1500, 3500, days=10, page=2, size=5)


@check(
    """
SELECT p.city_id, p.rank, p.company_id, c.name AS company_name, p.variants,
  p.total_companies, CAST(p.lo AS DOUBLE) / 100 AS overall_min, CAST(p.hi AS DOUBLE) / 100 AS overall_max,
  l.pos, l.diet_calories_id, coalesce(l.tier_diet_option_id, '') AS tdo, l.calories,
  l.diet_name || coalesce(' · ' || l.tier_name, '') || coalesce(' · ' || l.diet_option_name, '') AS diet_line,
  CAST(l.eff_c AS DOUBLE) / 100 AS effective_per_day, CAST(l.prev_c AS DOUBLE) / 100 AS prev_per_day,
  strftime(l.captured_at, '%Y-%m-%d %H:%M:%S') AS captured_at
FROM paged p JOIN companies c ON c.company_id = p.company_id
JOIN ordered l ON l.city_id = p.city_id AND l.company_id = p.company_id
WHERE p.rank BETWEEN 6 AND 10
""",
    {
        "ranged": "SELECT * FROM priced WHERE order_days = 10 AND calories BETWEEN 1500 AND 3500",
        "ordered": """SELECT *, row_number() OVER (PARTITION BY city_id, company_id ORDER BY eff_c NULLS LAST,
            calories NULLS LAST, diet_calories_id, coalesce(tier_diet_option_id, ''), diet_id) - 1 AS pos
          FROM ranged""",
        "paged": """SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY cheapest NULLS LAST, company_id) AS rank,
            count(*) OVER (PARTITION BY city_id) AS total_companies,
            min(cheapest) OVER (PARTITION BY city_id) AS lo, max(cheapest) OVER (PARTITION BY city_id) AS hi
          FROM (SELECT city_id, company_id, min(eff_c) AS cheapest, count(*) AS variants FROM ranged GROUP BY ALL)""",
    },
)
def catering_page(spark, folder):
    return page_rows(spark, folder, PAGE)


def page_rows(spark, folder, args):
    """A catering page, one row per leaf with its position in the tile."""
    page = catering.catering_page(star_tables(spark, folder), args, unit="month")
    leaves = page.select(
        "city_id", "rank", "company_id", "company_name", "variants", "total_companies", "overall_min",
        "overall_max", F.posexplode("leaves").alias("pos", "leaf"),
    )
    return plain(
        leaves.select(
            *[c for c in leaves.columns if c != "leaf"],
            "leaf.diet_calories_id",
            F.coalesce(tier_option_id("leaf.tier_id", "leaf.diet_option_id"), F.lit("")).alias("tdo"),
            "leaf.calories",
            joined_line("leaf.diet_name", "leaf.tier_name", "leaf.diet_option_name").alias("diet_line"),
            "leaf.effective_per_day", "leaf.prev_per_day", "leaf.captured_at",
        )
    )


@check(
    """
SELECT city_id, order_days, company_id, CAST(min(eff_c) AS DOUBLE) / 100 AS cheapest, count(*) AS variants,
  greatest(count(*) - 8, 0) AS hidden
FROM priced GROUP BY city_id, order_days, company_id
"""
)
def company_tiles(spark, folder):
    t = star_tables(spark, folder)
    leaves = catering.priced_leaves(t, unit="month", names=False)
    tiles = catering.company_tiles(leaves, t.companies)
    hidden = F.greatest(F.col("variants") - catering.VISIBLE_VARIANTS, F.lit(0)).alias("hidden")
    return plain(tiles.select("city_id", "order_days", "company_id", "cheapest", "variants", hidden))


@check(
    """
SELECT * FROM (SELECT city_id, order_days, company_id, CAST(cheapest AS DOUBLE) / 100 AS cheapest, variants,
    row_number() OVER (PARTITION BY city_id, order_days ORDER BY cheapest NULLS LAST, company_id) AS rank
  FROM (SELECT city_id, order_days, company_id, min(eff_c) AS cheapest, count(*) AS variants FROM priced GROUP BY ALL))
WHERE rank BETWEEN 6 AND 10
"""
)
def deep_page_of_tiles(spark, folder):
    """The second page of five by prefix counts over eleven cells, for every city and order length."""
    t = star_tables(spark, folder)
    tiles = catering.company_tiles(catering.priced_leaves(t, unit="month", names=False), t.companies)
    rows = catering.page_of_tiles(tiles, page_args(page=2, size=5), cells=11)
    return plain(rows, "city_id", "order_days", "company_id", "cheapest", "variants", "rank")


@check(
    """
SELECT city_id, order_days, company_id, diet_calories_id, diet_id, tier_id, coalesce(tier_diet_option_id, '') AS tdo,
  CAST(total_c AS DOUBLE) / 100 AS total_cost, CAST(eff_c AS DOUBLE) / 100 AS effective_per_day,
  CASE WHEN eff_c IS NULL OR prev_c IS NULL OR eff_c = prev_c THEN 'flat'
    WHEN eff_c < prev_c THEN 'down' ELSE 'up' END AS movement,
  CASE WHEN eff_c <> prev_c THEN round(abs(eff_c - prev_c) / 100.0, 2) END AS amount,
  array_to_string(promo_codes, ',') AS codes
FROM priced
"""
)
def priced_leaves(spark, folder):
    leaves = catering.priced_leaves(star_tables(spark, folder), unit="month", reduce_first=True)
    delta = price_delta("effective_per_day", "prev_per_day")
    return plain(
        leaves.select(
            "city_id", "order_days", "company_id", "diet_calories_id", "diet_id", "tier_id",
            F.coalesce(tier_option_id("tier_id", "diet_option_id"), F.lit("")).alias("tdo"),
            "total_cost", "effective_per_day", delta["kind"].alias("movement"),
            F.round(delta["amount"], 2).alias("amount"), F.col("promo_codes").alias("codes"),
        )
    )


@check(
    """
SELECT city_id, company_id, diet_calories_id, coalesce(tier_diet_option_id, '') AS tdo, order_days,
  strftime(bucket, '%Y-%m-%d') AS bucket, CAST(total_c AS DOUBLE) / 100 AS total_cost, id
FROM cheapest
"""
)
def cheapest_per_bucket(spark, folder):
    rows = star_tables(spark, folder).prices.withColumn("tdo", F.coalesce("tier_diet_option_id", F.lit("")))
    best = best_per_bucket(
        rows,
        ["city_id", "company_id", "diet_calories_id", "tdo", "order_days"],
        bucket("captured_at", "month"),
        [F.asc_nulls_last("total_cost"), F.desc("captured_at"), F.desc("id")],
    )
    return plain(
        best.select(
            "city_id", "company_id", "diet_calories_id", "tdo", "order_days",
            F.to_date("bucket").alias("bucket"), "total_cost", "id",
        )
    )


@check(
    """
SELECT city_id, max(strftime(captured_at, '%Y-%m-%d %H:%M:%S')) AS latest_capture_at, count(*) AS tiles
FROM (SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY eff_c NULLS LAST, company_id) AS rank
  FROM (SELECT DISTINCT ON (city_id, company_id) * FROM priced
    WHERE order_days = 10 AND calories BETWEEN 1500 AND 3500
    ORDER BY city_id, company_id, eff_c NULLS LAST, calories NULLS LAST, diet_calories_id,
      coalesce(tier_diet_option_id, ''), diet_id))
WHERE rank BETWEEN 1 AND 25 GROUP BY city_id
"""
)
def page_freshness(spark, folder):
    args = page_args(3500, 1500, days=7, available_days=[10, 20])
    page = catering.catering_page(star_tables(spark, folder), args, unit="month")
    heads = catering.page_cheapest(page)
    fresh = catering.page_freshness(page).join(
        heads.groupBy("city_id", "order_days").agg(F.count("company_id").alias("tiles")), ["city_id", "order_days"]
    )
    return plain(fresh, "city_id", "latest_capture_at", "tiles")


@check("SELECT city_id, name FROM cities c WHERE EXISTS (SELECT 1 FROM company_cities x WHERE x.city_id = c.city_id)")
def cities_with_companies(spark, folder):
    return plain(catering.cities_with_companies(star_tables(spark, folder)))


@check(
    """
SELECT cc.city_id, coalesce(min(calories) FILTER (calories <= 4000), 1000) AS kcal_min,
  coalesce(max(calories) FILTER (calories <= 4000), 3000) AS kcal_max,
  coalesce(string_agg(DISTINCT CAST(calories AS VARCHAR), ',' ORDER BY CAST(calories AS VARCHAR))
    FILTER (calories IN (1200, 1500, 1800, 2000, 2500)), '1200,1500,1800,2000,2500') AS presets
FROM company_cities cc JOIN diet_calories dc ON dc.company_id = cc.company_id
WHERE dc.valid_to IS NULL AND calories IS NOT NULL GROUP BY cc.city_id
"""
)
def kcal_bounds(spark, folder):
    return plain(catering.kcal_bounds(star_tables(spark, folder)))


@check("SELECT DISTINCT city_id, order_days FROM prices")
def day_options(spark, folder):
    return plain(catering.day_options(star_tables(spark, folder)))


@check(
    """
SELECT DISTINCT ON (w.name_wanted) w.name_wanted, c.city_id, c.name
FROM (SELECT DISTINCT upper(name) AS name_wanted FROM cities UNION SELECT upper(sanitized_name) FROM cities) w
JOIN cities c ON lower(c.name) = lower(w.name_wanted) OR lower(c.sanitized_name) = lower(w.name_wanted)
ORDER BY w.name_wanted, c.largest_city_for_name DESC NULLS LAST, c.number_of_companies DESC NULLS LAST, c.city_id
"""
)
def resolve_cities(spark, folder):
    cities = star_tables(spark, folder).cities
    names = cities.select(F.explode(F.array(F.upper("name"), F.upper("sanitized_name"))).alias("name_wanted"))
    return plain(catering.resolve_cities(cities, names))


# -- price history ----------------------------------------------------------


@check(
    """
SELECT DISTINCT ON (company_id, diet_calories_id, city_id, order_days, date_trunc('day', captured_at))
  company_id, diet_calories_id, city_id, order_days, strftime(captured_at, '%Y-%m-%d') AS bucket,
  CAST(per_day_net_c AS DOUBLE) / 100 AS price, array_to_string(promo_codes, ',') AS promo_codes
FROM prices
ORDER BY company_id, diet_calories_id, city_id, order_days, date_trunc('day', captured_at), captured_at DESC, id DESC
"""
)
def price_history(spark, folder):
    return plain(pricing.price_history(star_tables(spark, folder).prices))


@check(
    """
SELECT company_id, diet_calories_id, bucket, CAST(per_day_net_c AS DOUBLE) / 100 AS price, codes AS code
FROM (SELECT DISTINCT ON (company_id, diet_calories_id, date_trunc('day', captured_at)) *,
    strftime(captured_at, '%Y-%m-%d') AS bucket FROM price_series
  ORDER BY company_id, diet_calories_id, date_trunc('day', captured_at), captured_at DESC, id DESC)
WHERE codes <> ''
"""
)
def promo_marks(spark, folder):
    series = price_series(load(spark, folder, "events"))
    marks = pricing.promo_marks(pricing.price_history(series))
    return plain(marks, "company_id", "diet_calories_id", "bucket", "price", "code")


@check(
    """
SELECT DISTINCT ON (company_id, diet_calories_id, codes) company_id, diet_calories_id, codes AS promo_codes, id,
  CAST(per_day_net_c AS DOUBLE) / 100 AS price
FROM price_series ORDER BY company_id, diet_calories_id, codes, captured_at DESC, id DESC
"""
)
def latest_prices(spark, folder):
    rows = pricing.latest_prices(price_series(load(spark, folder, "events")))
    return plain(
        rows.select(
            "company_id", "diet_calories_id", "promo_codes", "id",
            F.col("per_day_cost_with_discounts").alias("price"),
        )
    )


def _latest_view(spark, folder, unit):
    """A batch per week of captures; every seventh capture comes late, with the last batch."""
    series = price_series(load(spark, folder, "events")).withColumn(
        "_batch", F.when(F.col("id") % 7 == 0, 99).otherwise(F.weekofyear("captured_at"))
    )
    view = pricing.latest_view(spark, work_folder(spark, "latest-view"), unit)
    for (batch,) in sorted(series.select("_batch").distinct().collect()):
        view.add(series.where(F.col("_batch") == batch), batch)
    return view


LATEST = """
SELECT DISTINCT ON (company_id, diet_calories_id, codes) company_id, diet_calories_id, codes AS promo_codes, id,
  CAST(per_day_net_c AS DOUBLE) / 100 AS price
FROM price_series {} ORDER BY company_id, diet_calories_id, codes, captured_at DESC, id DESC
"""


def _latest(rows):
    return plain(rows.select(
        "company_id", "diet_calories_id", "promo_codes", "id", F.col("per_day_cost_with_discounts").alias("price")
    ))


@check(LATEST.format(""))
def latest_prices_incremental(spark, folder):
    return _latest(_latest_view(spark, folder, "week").view())


@check(LATEST.format("WHERE captured_at < TIMESTAMP '2024-01-16'"))
def latest_prices_as_of(spark, folder):
    """What was the latest price at the end of an earlier day."""
    return _latest(_latest_view(spark, folder, "day").view(until="2024-01-15"))


@check(
    """
SELECT city_id, company_id, diet_calories_id, coalesce(tier_diet_option_id, '') AS tdo, order_days,
  strftime(bucket, '%Y-%m-%d') AS bucket, CAST(total_c AS DOUBLE) / 100 AS total_cost, id
FROM cheapest
"""
)
def cheapest_incremental(spark, folder):
    """Quotes come in four batches, the last with captures of all years; three are rolled up meanwhile."""
    rows, out = star_tables(spark, folder).prices, work_folder(spark, "cheapest-view")
    year = F.year("captured_at")
    batch = F.when(F.col("id") % 10 == 0, 4).when(year < 1994, 1).when(year < 1996, 2).otherwise(3)
    fine = pricing.cheapest_view(spark, f"{out}/fine", "month", "month")
    coarse = pricing.cheapest_view(spark, f"{out}/coarse", "month", "year")
    for n in (1, 2, 3):
        fine.add(rows.where(batch == n), n)
    fine.roll_up(coarse, 0, 3)
    fine.add(rows.where(batch == 4), 4)
    best = fine.view(rolled=coarse, through=3)
    return plain(best.select(
        "city_id", "company_id", "diet_calories_id", F.coalesce("tier_diet_option_id", F.lit("")).alias("tdo"), "order_days",
        F.to_date(bucket("captured_at", "month")).alias("bucket"), "total_cost", "id",
    ))


CHANGES = """
SELECT p.id, p.company_id, p.diet_calories_id, p.codes, strftime(p.captured_at, '%Y-%m-%d %H:%M:%S.%f') AS captured_at,
  CAST(p.per_day_net_c AS DOUBLE) / 100 AS price, CAST(b.per_day_net_c AS DOUBLE) / 100 AS prev_per_day,
  round((p.per_day_net_c - b.per_day_net_c) / 100.0, 2) AS delta
FROM price_series p ASOF JOIN price_series b ON b.company_id = p.company_id
  AND b.diet_calories_id = p.diet_calories_id AND b.codes = p.codes AND p.captured_at > b.captured_at
WHERE p.per_day_net_c IS DISTINCT FROM b.per_day_net_c
"""


def changed(rows):
    return plain(
        rows.select(
            "id", "company_id", "diet_calories_id", F.array_join("promo_codes", ",").alias("codes"),
            F.date_format("captured_at", MICROS).alias("captured_at"),
            F.col("per_day_cost_with_discounts").alias("price"), "prev_per_day",
            F.round(F.col("delta").cast("double"), 2).alias("delta"),
        )
    )


@check(CHANGES)
def price_changes(spark, folder):
    return changed(pricing.price_changes(price_series(load(spark, folder, "events"))))


@check(CHANGES)
def price_changes_hot_keys(spark, folder):
    """The same in segments of an hour, so that a hot key falls into many."""
    return changed(pricing.price_changes(price_series(load(spark, folder, "events")), unit="hour"))


@check(
    """
SELECT city_id, order_days, rank, company_id, diet_calories_id, coalesce(tier_diet_option_id, '') AS tdo,
  round(total_c / 100.0 / order_days, 4) AS per_day
FROM (SELECT *, row_number() OVER (PARTITION BY city_id, order_days ORDER BY total_c, company_id,
    diet_calories_id, tier_diet_option_id NULLS FIRST, id) AS rank
  FROM prices WHERE total_c IS NOT NULL) WHERE rank <= 5
"""
)
def cheapest_five_per_city(spark, folder):
    top = snapshots.cheapest_per_city(star_tables(spark, folder).prices, 5)
    return plain(
        top.select(
            "city_id", "order_days", "rank", "company_id", "diet_calories_id",
            F.coalesce("tier_diet_option_id", F.lit("")).alias("tdo"), F.round("per_day", 4).alias("per_day"),
        )
    )


@check(
    """
SELECT company_id, diet_calories_id, coalesce(tier_diet_option_id, '') AS tdo, order_days,
  round(total_c / 100.0 / order_days, 4) AS per_day
FROM prices WHERE total_c IS NOT NULL
ORDER BY total_c / 100.0 / order_days, company_id, diet_calories_id, tier_diet_option_id NULLS FIRST LIMIT 5
"""
)
def cheapest_five(spark, folder):
    top = snapshots.cheapest_leaves(star_tables(spark, folder).prices, 5)
    return plain(
        top.select(
            "company_id", "diet_calories_id", F.coalesce("tier_diet_option_id", F.lit("")).alias("tdo"),
            "order_days", F.round("per_day", 4).alias("per_day"),
        )
    )


SIDES = {
    "a": """SELECT company_id, city_id, diet_calories_id, tier_diet_option_id, order_days, min(total_c) AS v
      FROM prices WHERE captured_at < TIMESTAMP '1998-06-01' GROUP BY ALL""",
    "b": """SELECT company_id, city_id, diet_calories_id, tier_diet_option_id, order_days, min(total_c) AS v
      FROM prices WHERE captured_at >= TIMESTAMP '1998-06-01' GROUP BY ALL""",
}


PRICE_DIFF = """
SELECT coalesce(a.company_id, b.company_id) AS company_id, coalesce(a.city_id, b.city_id) AS city_id,
  coalesce(a.diet_calories_id, b.diet_calories_id) AS diet_calories_id,
  coalesce(a.tier_diet_option_id, b.tier_diet_option_id, '') AS tdo, coalesce(a.order_days, b.order_days) AS order_days,
  CASE WHEN a.company_id IS NULL THEN 'added' WHEN b.company_id IS NULL THEN 'removed' ELSE 'changed' END AS status,
  CAST(a.v AS DOUBLE) / 100 AS total_cost_before, CAST(b.v AS DOUBLE) / 100 AS total_cost_after
FROM a FULL JOIN b ON a.company_id = b.company_id AND a.city_id = b.city_id
  AND a.diet_calories_id = b.diet_calories_id AND a.order_days = b.order_days
  AND a.tier_diet_option_id IS NOT DISTINCT FROM b.tier_diet_option_id
WHERE a.company_id IS NULL OR b.company_id IS NULL OR a.v IS DISTINCT FROM b.v
"""


@check(PRICE_DIFF, SIDES)
def price_snapshot_diff(spark, folder):
    prices = star_tables(spark, folder).prices
    keys = ["company_id", "city_id", "diet_calories_id", "tier_diet_option_id", "order_days"]
    early = F.col("captured_at") < F.lit(AS_OF).cast("timestamp")
    sides = [
        prices.where(c).groupBy(*keys).agg(F.min("total_cost").alias("total_cost")) for c in (early, ~early)
    ]
    diff = snapshots.price_diff(*sides)
    return plain(diff.withColumn("tdo", F.coalesce("tier_diet_option_id", F.lit(""))).drop("tier_diet_option_id"))


@check(PRICE_DIFF, SIDES)
def price_snapshot_diff_pruned(spark, folder):
    """The same over stored snapshots with digests per city and company."""
    prices, out = star_tables(spark, folder).prices, work_folder(spark, "price-snapshots")
    early = F.col("captured_at") < F.lit(AS_OF).cast("timestamp")
    for name, which in (("a", early), ("b", ~early)):
        side = prices.where(which).groupBy(*snapshots.PRICE_ITEM).agg(F.min("total_cost").alias("total_cost"))
        write_compared(side, f"{out}/{name}", snapshots.PRICE_LEVELS, snapshots.PRICE_ITEM, ["total_cost"])
    diff = snapshots.stored_diff(
        spark, f"{out}/a", f"{out}/b", side.schema, snapshots.PRICE_LEVELS, snapshots.PRICE_ITEM, ["total_cost"]
    )
    return plain(diff.withColumn("tdo", F.coalesce("tier_diet_option_id", F.lit(""))).drop("tier_diet_option_id"))


# -- offers -----------------------------------------------------------------

OFFERS = {
    "newest": """SELECT city_id, diet_calories_id, max({'at': captured_at, 'id': id, 'c': per_day_net_c}).c AS per_day_net_c
      FROM prices WHERE order_days = 5 GROUP BY city_id, diet_calories_id""",
    "promo": """SELECT first.code AS code, first.ends_at AS ends_at FROM (
        SELECT min({'open': ends_at IS NULL, 'ends_at': ends_at, 'code': code, 'source': source}) AS first
        FROM campaigns WHERE is_active AND coalesce(ends_at, DATE '9999-12-31') >= DATE '1998-06-01')
      WHERE first IS NOT NULL""",
    # From the leaf upwards; every step keeps what hangs on an open parent.
    "option_leaves": """SELECT leaf.company_id, leaf.diet_id, leaf.tier_id, leaf.diet_calories_id, leaf.calories,
        o.tier_diet_option_id
      FROM diet_calories leaf JOIN diet_options o USING (company_id, diet_id, tier_id, diet_option_id)
      WHERE leaf.valid_to IS NULL AND o.valid_to IS NULL""",
    "tier_leaves": """SELECT ol.*, x.name AS tier_name FROM option_leaves ol
      JOIN (FROM tiers WHERE valid_to IS NULL) x USING (company_id, diet_id, tier_id)""",
    "diet_leaves": """SELECT tl.*, x.diet_tag FROM tier_leaves tl
      JOIN (FROM diets WHERE valid_to IS NULL) x USING (company_id, diet_id)""",
    "found": """SELECT served.city_id, dl.company_id, firm.avg_score, dl.diet_id, dl.diet_tag, dl.tier_name,
        dl.tier_diet_option_id, dl.diet_calories_id, dl.calories, newest.per_day_net_c,
        concat_ws(':', 'v1', dl.company_id, dl.diet_calories_id, dl.tier_diet_option_id) AS offer_id
      FROM diet_leaves dl
      JOIN (SELECT company_id, avg_score FROM companies WHERE orders_enabled) firm USING (company_id)
      JOIN (SELECT DISTINCT company_id, city_id FROM company_cities) served USING (company_id)
      LEFT JOIN newest ON (newest.city_id, newest.diet_calories_id) = (served.city_id, dl.diet_calories_id)""",
}


@check(
    """
SELECT city_id, offer_id, company_id, avg_score, diet_tag, tier_name, calories,
  CAST(per_day_net_c AS DOUBLE) / 100 AS price_per_day, (SELECT code FROM promo) AS promo_code,
  (SELECT strftime(ends_at, '%Y-%m-%d') FROM promo) AS promo_deadline
FROM found
""",
    OFFERS,
)
def find_offers(spark, folder):
    rows = offers.find_offers(star_tables(spark, folder), as_of=AS_OF)
    return plain(
        rows.select(
            "city_id", "offer_id", "company_id", "avg_score", "diet_tag", "tier_name", "calories", "price_per_day",
            F.col("promo.code").alias("promo_code"), F.col("promo.deadline").alias("promo_deadline"),
        )
    )


def _best_offers(order: str) -> str:
    return f"""
SELECT city_id, rank, offer_id, avg_score, calories, CAST(per_day_net_c AS DOUBLE) / 100 AS price_per_day
FROM (SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY {order}, company_id, diet_id,
    tier_diet_option_id, diet_calories_id) AS rank
  FROM found WHERE calories BETWEEN 1000 AND 3000 AND per_day_net_c <= 900000 AND avg_score >= 10)
WHERE rank <= 20
"""


def _ranked(spark, folder, sort_by):
    rows = offers.find_offers(
        star_tables(spark, folder), kcal_min=1000, kcal_max=3000, max_price=9000, min_score=10,
        with_promo_only=True, as_of=AS_OF,
    )
    best = offers.ranked_offers(rows, sort_by)
    return plain(best, "city_id", "rank", "offer_id", "avg_score", "calories", "price_per_day")


@check(_best_offers("per_day_net_c ASC NULLS LAST"), OFFERS)
def cheapest_offers(spark, folder):
    return _ranked(spark, folder, "price")


@check(_best_offers("avg_score DESC NULLS LAST"), OFFERS)
def best_rated_offers(spark, folder):
    return _ranked(spark, folder, "score")


@check(
    """
SELECT f.city_id, f.offer_id, p.code AS promo_code, CAST(p.discount_c AS DOUBLE) / 100 AS promo_discount
FROM found f LEFT JOIN (SELECT DISTINCT ON (company_id) * FROM campaigns
  WHERE is_active AND company_id IS NOT NULL AND (ends_at IS NULL OR ends_at >= DATE '1998-06-01')
  ORDER BY company_id, ends_at NULLS LAST, code, source) p ON p.company_id = f.company_id
WHERE f.diet_tag = 'ECONOMY'
""",
    OFFERS,
)
def company_promo_offers(spark, folder):
    rows = offers.find_offers(
        star_tables(spark, folder), diet_tag="ECONOMY", as_of=AS_OF, promo_scope="company"
    )
    return plain(
        rows.select(
            "city_id", "offer_id", F.col("promo.code").alias("promo_code"),
            F.col("promo.discount_percent").alias("promo_discount"),
        )
    )


@check(
    """
SELECT o.offer_id, p.city_id, p.order_days AS days_count, array_to_string(p.promo_codes, ',') AS promo_applied,
  CAST(p.per_day_c AS DOUBLE) / 100 AS list_price, CAST(p.per_day_net_c AS DOUBLE) / 100 AS final_price,
  CAST(p.total_c AS DOUBLE) / 100 AS final_total, CAST(p.list_total_c AS DOUBLE) / 100 AS list_total,
  CAST(p.delivery_c AS DOUBLE) / 100 AS delivery_total, CAST(p.code_discount_c AS DOUBLE) / 100 AS promo_discount
FROM (SELECT DISTINCT company_id, diet_calories_id, tier_diet_option_id AS tdo, 'v1:' || company_id || ':' ||
    diet_calories_id || coalesce(':' || tier_diet_option_id, '') AS offer_id FROM prices) o
LEFT JOIN (SELECT DISTINCT ON (company_id, diet_calories_id, tier_diet_option_id, city_id, order_days, promo_codes) *
  FROM prices ORDER BY company_id, diet_calories_id, tier_diet_option_id, city_id, order_days, promo_codes,
    captured_at DESC, id DESC) p
  ON p.company_id = o.company_id AND p.diet_calories_id = o.diet_calories_id
  AND p.tier_diet_option_id IS NOT DISTINCT FROM o.tdo
"""
)
def quote_breakdown(spark, folder):
    t = star_tables(spark, folder)
    keys = t.prices.select(
        offer_key(
            "company_id", "diet_calories_id", "tier_diet_option_id", F.col("tier_diet_option_id").isNotNull()
        ).alias("offer_id")
    ).distinct()
    rows = pricing.quote_breakdown(t, keys)
    return plain(
        rows.select(
            "offer_id", "city_id", "days_count", "promo_applied", "per_day.list_price", "per_day.final_price",
            "totals.final_total", "totals.list_total", "totals.delivery_total", "totals.promo_discount",
        )
    )
