"""Promotions: feeds, campaigns, codes, chips and work lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from larderlog.plans import offers, promotions, state, work
from larderlog.schemas import table
from larderlog.session import work_folder
from larderlog.sources.buckets import BucketedState
from larderlog.sources.normalise import known_companies
from larderlog.sources.sinks import accounted, write_accounted
from larderlog.sources.starviews import companies, load, promo_observations, star_tables
from larderlog.sources.tables import empty_table

from .registry import AS_OF, check, plain

STAMP = "'%Y-%m-%d %H:%M:%S'"
CAMPAIGN_SQL = f"""
SELECT code, source, company_id, CAST(discount_c AS DOUBLE) / 100 AS discount_percent, title,
  strftime(deadline, '%Y-%m-%d') AS deadline, separate, strftime(valid_to, {STAMP}) AS valid_to,
  strftime(first_seen_at, {STAMP}) AS first_seen_at, strftime(last_seen_at, {STAMP}) AS last_seen_at
"""
CAMPAIGN_COLUMNS = [
    "code", "source", "company_id", "discount_percent", "title", "deadline", "separate", "valid_to",
    "first_seen_at", "last_seen_at",
]


def sightings(spark, folder):
    return promo_observations(load(spark, folder, "orders")), companies(load(spark, folder, "supplier"))


@check(
    f"""
SELECT id, code, source, company_id, city_id, CAST(discount_c AS DOUBLE) / 100 AS discount_percents, promo_text,
  strftime(deadline, '%Y-%m-%d') AS deadline FROM observations
"""
)
def promo_sightings(spark, folder):
    rows = known_companies(*sightings(spark, folder))
    return plain(
        rows, "id", "code", "source", "company_id", "city_id", "discount_percents", "promo_text", "deadline"
    )


@check(CAMPAIGN_SQL + ", is_active FROM campaigns")
def campaigns_folded(spark, folder):
    """Two batches folded one after the other equal one SQL aggregate over all sightings."""
    seen, firms = sightings(spark, folder)
    early = F.col("captured_at") < F.lit(AS_OF).cast("timestamp")
    first = state.fold_campaigns(empty_table(spark, "campaigns"), state.campaign_rows(seen.where(early), firms))
    second = state.fold_campaigns(first, state.campaign_rows(seen.where(~early), firms))
    return plain(second, *CAMPAIGN_COLUMNS, "is_active")


@check(CAMPAIGN_SQL + ", is_active FROM campaigns")
def campaigns_folded_bucketed(spark, folder):
    """A batch per year of sightings; each rewrites only the key-hash buckets it touches."""
    seen, firms = sightings(spark, folder)
    kept = BucketedState(spark, work_folder(spark, "campaign-buckets"), table("campaigns"), ["code", "source", "company_id"], 16)
    first, last = seen.agg(F.min(F.year("captured_at")), F.max(F.year("captured_at"))).first()
    for year in range(first, last + 1):
        rows = state.campaign_rows(seen.where(F.year("captured_at") == year), firms)
        kept.fold(rows, state.fold_campaigns, year)
    return plain(kept.read(), *CAMPAIGN_COLUMNS, "is_active")


@check(
    """
SELECT code, source, company_id, NOT (last_seen_at < TIMESTAMP '2001-06-01' - INTERVAL 24 HOUR
  AND coalesce(deadline, DATE '2001-06-01') < DATE '2001-06-01') AS is_active,
  strftime(deadline, '%Y-%m-%d') AS deadline FROM campaigns
"""
)
def campaigns_expired(spark, folder):
    rows = state.expire_campaigns(star_tables(spark, folder).campaigns, as_of="2001-06-01")
    return plain(rows, "code", "source", "company_id", "is_active", "deadline")


@check(
    CAMPAIGN_SQL
    + """FROM campaigns WHERE coalesce(deadline, DATE '2001-06-01') >= DATE '2001-06-01'
  AND coalesce(CAST(valid_to AS DATE), DATE '2001-06-01') >= DATE '2001-06-01'"""
)
def active_promotions(spark, folder):
    rows = promotions.active_promotions(star_tables(spark, folder).campaigns, as_of="2001-06-01")
    return plain(rows, *CAMPAIGN_COLUMNS)


@check(CAMPAIGN_SQL + "FROM campaigns WHERE is_active AND (ends_at IS NULL OR ends_at >= DATE '2001-06-01')")
def active_campaigns(spark, folder):
    rows = promotions.active_campaigns(star_tables(spark, folder).campaigns, as_of="2001-06-01")
    return plain(rows, *CAMPAIGN_COLUMNS)


USABLE = {
    "usable": """SELECT * FROM campaigns WHERE is_active AND company_id IS NOT NULL
      AND (deadline IS NULL OR deadline >= DATE '2001-06-01')
      AND (valid_to IS NULL OR valid_to >= TIMESTAMP '2001-06-01')""",
    "codes": """SELECT company_id, min(trim(code)) AS code FROM usable WHERE trim(code) <> ''
      GROUP BY company_id, lower(trim(code))""",
}


@check("SELECT company_id, code FROM codes", USABLE)
def active_promo_codes(spark, folder):
    return plain(promotions.active_promo_codes(star_tables(spark, folder).campaigns, as_of="2001-06-01"))


@check(
    "SELECT company_id, array_to_string(list_sort(list(DISTINCT code)), ',') AS codes FROM usable GROUP BY company_id",
    USABLE,
)
def promo_targets(spark, folder):
    return plain(promotions.promo_targets(star_tables(spark, folder).campaigns, as_of="2001-06-01"))


@check(
    """
SELECT company_id, count(*) FILTER (len(promo_codes) = 0
  AND captured_at > TIMESTAMP '1998-11-20' - INTERVAL 6 HOUR) AS recent FROM prices GROUP BY company_id
"""
)
def no_code_coverage(spark, folder):
    """As of the last days of the data, so that few companies have recent quotes."""
    return plain(promotions.no_code_coverage(star_tables(spark, folder).prices, now="1998-11-20"))


@check(
    """
SELECT raw_company_id AS company_id, code, CAST(arg_min(discount_c, o) FILTER (rn = 1) AS DOUBLE) / 100
    AS discount_percents,
  max(strftime(deadline, '%Y-%m-%d')) FILTER (rn = 1) AS deadline,
  max(promo_text) FILTER (rn = 1) AS promo_text,
  array_to_string(list_sort(list(DISTINCT source)), ',') AS sources
FROM (SELECT *, (feed, captured_at, id) AS o, row_number() OVER (PARTITION BY raw_company_id, code
    ORDER BY feed, captured_at, id) AS rn
  FROM observations WHERE raw_company_id IS NOT NULL AND source <> 'banner')
GROUP BY raw_company_id, code
"""
)
def promo_rollup(spark, folder):
    rows = promotions.promo_rollup(sightings(spark, folder)[0])
    return plain(rows, "company_id", "code", "discount_percents", "deadline", "promo_text", "sources")


def _in_force(*keys: str) -> str:
    """Every sighting with the five-day quote in force, by an as-of join."""
    same = " AND ".join(f"o.{k} = p.{k}" for k in keys)
    return f"""
SELECT o.id, o.code, p.id AS price_id, CAST(p.per_day_net_c AS DOUBLE) / 100 AS price_per_day,
  strftime(p.captured_at, {STAMP}) AS quoted_at
FROM observations o ASOF LEFT JOIN (
  SELECT * FROM prices WHERE order_days = 5
  QUALIFY row_number() OVER (PARTITION BY {', '.join(keys)}, captured_at ORDER BY id DESC) = 1) p
  ON {same} AND o.captured_at >= p.captured_at
"""


def _sighted_prices(spark, folder, *keys):
    seen = known_companies(*sightings(spark, folder))
    rows = offers.prices_in_force(seen, star_tables(spark, folder).prices, keys, unit="month")
    return plain(rows, "id", "code", "price_id", "price_per_day", "quoted_at")


@check(_in_force("company_id", "city_id"))
def promo_prices(spark, folder):
    """The price in force at every promotion sighting, per company and city."""
    return _sighted_prices(spark, folder, "company_id", "city_id")


@check(_in_force("city_id"))
def promo_prices_hot_keys(spark, folder):
    """A few cities hold all rows of both tables."""
    return _sighted_prices(spark, folder, "city_id")


CHIPS = {
    "chips": """SELECT DISTINCT ON (company_id, code) company_id, code, discount_c,
        CASE WHEN company_id IS NULL THEN 'global' ELSE 'company' END AS scope
      FROM campaigns ORDER BY company_id, code, ends_at NULLS LAST, source""",
}


@check("SELECT company_id, code, CAST(discount_c AS DOUBLE) / 100 AS discount_percent, scope FROM chips", CHIPS)
def promo_chips(spark, folder):
    return plain(promotions.promo_chips(star_tables(spark, folder).campaigns))


@check(
    """
SELECT p.id, p.company_id, coalesce(k.code, nullif(p.applied, ''), b.code) AS code,
  CAST(CASE WHEN p.applied <> '' THEN k.discount_c ELSE b.discount_c END AS DOUBLE) / 100 AS discount_percent
FROM (SELECT *, coalesce(promo_codes[1], '') AS applied FROM prices) p
LEFT JOIN chips k ON k.company_id = p.company_id AND k.code = p.applied
LEFT JOIN (SELECT DISTINCT ON (company_id) * FROM chips WHERE scope = 'company'
  ORDER BY company_id, coalesce(discount_c, 0) DESC, lower(code), code DESC) b ON b.company_id = p.company_id
""",
    CHIPS,
)
def primary_promo(spark, folder):
    t = star_tables(spark, folder)
    tiles = t.prices.select("id", "company_id", F.get("promo_codes", F.lit(0)).alias("applied_code"))
    rows = promotions.primary_promo(tiles, promotions.promo_chips(t.campaigns))
    return plain(rows.select("id", "company_id", "chip.code", "chip.discount_percent"))


@check(
    """
SELECT company_id, promo_codes[1] AS code, max(granted) > 0 AS works, count(*) AS quotes,
  CAST(max(granted) AS DOUBLE) / 100 AS best_discount
FROM (SELECT *, CASE WHEN CAST(company_id AS BIGINT) % 3 = 0 THEN 0 ELSE code_discount_c END AS granted FROM prices)
WHERE len(promo_codes) > 0 GROUP BY ALL
"""
)
def promo_validity(spark, folder):
    """Every third company grants nothing for its codes."""
    prices = star_tables(spark, folder).prices
    amount = "total_promo_code_discount"
    nothing = F.col("company_id").cast("bigint") % 3 == 0
    granted = F.when(nothing, F.lit(0)).otherwise(F.col(amount)).cast(prices.schema[amount].dataType)
    return plain(promotions.promo_validity(prices.withColumn(amount, granted)))


LEAVES = {
    "leaves": """SELECT company_id, diet_calories_id, diet_id, tier_id,
        (SELECT any_value(tier_diet_option_id) FROM diet_options o WHERE (o.company_id, o.diet_id, o.tier_id, o.diet_option_id)
          = (leaf.company_id, leaf.diet_id, leaf.tier_id, leaf.diet_option_id)) AS tier_diet_option_id,
        is_menu_configuration, delivery_on_saturday AS sat, delivery_on_sunday AS sun
      FROM diet_calories leaf
      JOIN (SELECT company_id, diet_id, is_menu_configuration FROM diets WHERE valid_to IS NULL) USING (company_id, diet_id)
      JOIN companies USING (company_id)
      WHERE leaf.valid_to IS NULL AND NOT EXISTS (
        FROM diet_options gone WHERE gone.valid_to IS NOT NULL AND (gone.company_id, gone.diet_id, gone.tier_id,
          gone.diet_option_id) = (leaf.company_id, leaf.diet_id, leaf.tier_id, leaf.diet_option_id))""",
}


@check(
    """SELECT company_id, diet_calories_id, diet_id, tier_id, tier_diet_option_id, is_menu_configuration,
  sat AS delivery_on_saturday, sun AS delivery_on_sunday FROM leaves""",
    LEAVES,
)
def price_leaves(spark, folder):
    return plain(work.price_leaves(star_tables(spark, folder)))


@check(
    """
SELECT l.company_id, l.diet_calories_id, l.tier_id, n AS order_days, coalesce(v.code, '') AS promo_codes,
  CASE WHEN is_menu_configuration THEN tier_diet_option_id END AS tier_diet_option_id,
  (SELECT string_agg(strftime(d, '%Y-%m-%d'), ',' ORDER BY d) FROM (
    SELECT CAST(x AS DATE) AS d FROM generate_series(DATE '2001-06-02', DATE '2001-07-10', INTERVAL 1 DAY) g(x)
    WHERE (sat OR dayofweek(x) <> 6) AND (sun OR dayofweek(x) <> 0)
    QUALIFY row_number() OVER (ORDER BY x) <= n)) AS delivery_dates
FROM (SELECT leaves.*, CAST(unnest([1, 5, 10, 20]) AS BIGINT) AS n FROM leaves) l
JOIN (SELECT company_id, code FROM codes UNION ALL SELECT company_id, NULL FROM companies) v
  ON v.company_id = l.company_id
""",
    {**USABLE, **LEAVES},
)
def quote_jobs(spark, folder):
    return plain(work.quote_jobs(star_tables(spark, folder), as_of="2001-06-01"))


ACCOUNTING = """
SELECT coalesce(j.company_id, a.company_id) AS company_id, coalesce(j.jobs, 0) AS jobs, coalesce(a.stored, 0) AS stored,
  greatest(coalesce(j.jobs, 0) - coalesce(a.stored, 0), 0) AS failed,
  coalesce(j.jobs, 0) > 0 AND coalesce(a.stored, 0) = 0 AS silent
FROM (SELECT company_id, 4 * count(*) AS jobs FROM leaves JOIN codes USING (company_id) GROUP BY company_id) j
FULL JOIN (SELECT company_id, count(*) AS stored FROM prices WHERE total_c IS NOT NULL AND len(promo_codes) > 0
  GROUP BY company_id) a ON a.company_id = j.company_id
"""


@check(ACCOUNTING, {**USABLE, **LEAVES})
def run_accounting(spark, folder):
    t = star_tables(spark, folder)
    jobs = work.quote_jobs(t, as_of="2001-06-01", with_code_only=True)
    answers = t.prices.where(F.col("total_cost").isNotNull() & (F.size("promo_codes") > 0))
    return plain(work.run_accounting(jobs, answers))


def _answered(spark, folder):
    """Answers with a code in three batches, the second of which is delivered twice."""
    t, out = star_tables(spark, folder), work_folder(spark, "answers")
    answers = t.prices.where(F.size("promo_codes") > 0)
    for batch in (0, 1, 1, 2):
        write_accounted(answers.where(F.col("id") % 3 == batch), out, batch)
    return t, out


@check(ACCOUNTING, {**USABLE, **LEAVES})
def run_accounting_observed(spark, folder):
    """From the counts that the writes left, without reading the answers again."""
    t, out = _answered(spark, folder)
    stored = accounted(spark, out).where("priced > 0").select("company_id", F.col("priced").alias("stored"))
    return plain(work.accounting_of_counts(work.quote_jobs(t, as_of="2001-06-01", with_code_only=True), stored))


@check("SELECT id % 3 AS batch_id, count(*) AS rows, count(total_c) AS priced FROM prices WHERE len(promo_codes) > 0 GROUP BY ALL")
def answer_totals(spark, folder):
    """Totals observed by the writes themselves."""
    return plain(accounted(spark, _answered(spark, folder)[1], "totals"), "batch_id", "rows", "priced")
