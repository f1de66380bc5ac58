"""SQL form of ``larderlog.sources.starviews``: the same tables as CTEs.

Money is kept in integer cents (suffix ``_c``) so that both engines round alike.
"""

from __future__ import annotations

import re

AS_OF = "DATE '1998-06-01'"
NOW = "TIMESTAMP '1998-06-01 00:00:00'"
CLOSED = "TIMESTAMP '2001-01-01 00:00:00'"


def _leaf(p: str) -> str:
    return f"""
  CAST({p} // 20 AS VARCHAR) AS company_id,
  ({p} % 20) // 4 + 1 AS diet_id,
  CASE WHEN {p} % 20 >= 16 THEN {p} ELSE {p} - {p} % 2 END + 1 AS diet_calories_id,
  CASE WHEN {p} % 20 < 16 THEN {p} % 2 + 1 END AS tier_id,
  CASE WHEN {p} % 20 < 16 THEN 1 + ({p} % 20) // 8 END AS option_key"""


VIEWS: dict[str, str] = {
    "leafparts": f"""
  SELECT *, CASE WHEN p_partkey % 20 <> 15 THEN option_key END AS diet_option_id
  FROM (SELECT part.*, {_leaf('p_partkey')} FROM part)""",
    "companies": """
  SELECT CAST(s_suppkey AS VARCHAR) AS company_id, s_name AS name, s_suppkey,
    CAST(cents // 100 AS DOUBLE) / 100 AS avg_score,
    CAST(cents % 1000 AS DOUBLE) / 100 AS feedback_value,
    cents % 5000 AS feedback_number, s_acctbal > 5000 AS awarded,
    CASE cents % 3 WHEN 0 THEN 'CHEAP' WHEN 1 THEN 'MEDIUM' ELSE 'EXPENSIVE' END AS price_category,
    s_suppkey % 2 = 0 AS delivery_on_saturday, s_suppkey % 5 = 0 AS delivery_on_sunday,
    CASE s_suppkey % 4 WHEN 1 THEN false WHEN 0 THEN NULL ELSE true END AS menu_enabled,
    CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE s_suppkey % 21 END AS menu_days_ahead,
    CASE s_suppkey % 5 WHEN 1 THEN false WHEN 2 THEN NULL ELSE true END AS orders_enabled
  FROM (SELECT *, CAST(abs(round(s_acctbal * 100)) AS BIGINT) AS cents FROM supplier)""",
    "cities": """
  SELECT CAST(n_nationkey AS BIGINT) AS city_id, n_name AS name, lower(replace(n_name, '_', '-')) AS sanitized_name,
    r_name AS province_name, n_nationkey % 6 <> 0 AS city_status,
    n_nationkey * 3 % 17 AS number_of_companies, n_nationkey % 2 = 0 AS largest_city_for_name
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""",
    "company_cities": """
  SELECT CAST(s_suppkey AS VARCHAR) AS company_id, CAST((s_suppkey + i) % 23 AS BIGINT) AS city_id,
    s_suppkey % 7 * 100 AS delivery_fee_c
  FROM supplier, (VALUES (0), (1)) v(i)""",
    "diets": f"""
  SELECT company_id, diet_id, min(p_name) AS name, max(p_name) AS description, min(p_type) AS diet_tag,
    count(*) AS diet_meal_count, diet_id < 5 AS is_menu_configuration,
    CASE WHEN (CAST(company_id AS BIGINT) + diet_id) % 11 = 0 THEN {CLOSED} END AS valid_to
  FROM leafparts GROUP BY company_id, diet_id""",
    "tiers": f"""
  SELECT company_id, diet_id, tier_id, min(p_brand) AS name, min(p_retailprice) AS min_price,
    count(*) AS meals_number,
    CASE WHEN (CAST(company_id AS BIGINT) + diet_id + tier_id) % 13 = 0 THEN {CLOSED} END AS valid_to
  FROM leafparts WHERE tier_id IS NOT NULL GROUP BY company_id, diet_id, tier_id""",
    "diet_options": f"""
  SELECT company_id, diet_id, tier_id, diet_option_id, max(p_brand) AS name,
    tier_id || '-' || diet_option_id AS tier_diet_option_id, diet_option_id = 1 AS is_default,
    CASE WHEN (CAST(company_id AS BIGINT) + diet_id * 3 + tier_id) % 17 = 0 THEN {CLOSED} END AS valid_to
  FROM leafparts WHERE diet_option_id IS NOT NULL
  GROUP BY company_id, diet_id, tier_id, diet_option_id""",
    "diet_calories": f"""
  SELECT company_id, diet_id, tier_id, diet_option_id, diet_calories_id,
    CASE WHEN p_size <> 50 THEN CAST(p_size AS BIGINT) * 100 END AS calories,
    CASE WHEN p_size % 10 = 0 AND p_size <> 50 THEN {CLOSED} END AS valid_to
  FROM leafparts""",
    "prices": f"""
  SELECT id, company_id, diet_calories_id, city_id, captured_at, tier_id || '-' || option_key AS tier_diet_option_id,
    n AS order_days, CASE WHEN coded THEN [code] ELSE CAST([] AS VARCHAR[]) END AS promo_codes,
    (2 * c + n) // (2 * n) AS per_day_c, c * (100 - d) // (100 * n) AS per_day_net_c,
    CASE WHEN l_quantity < 50 THEN c END AS total_c, c + 1000 AS list_total_c,
    l_linenumber * 100 AS delivery_c, c * x // 100 AS length_discount_c,
    CASE WHEN coded THEN c * d // 100 ELSE 0 END AS code_discount_c
  FROM (SELECT (l_orderkey * 8 + l_linenumber) * 100000 + l_partkey % 100000 AS id, {_leaf('l_partkey')},
      (l_partkey // 20 + l_linenumber % 2) % 23 AS city_id,
      CAST(CASE l_returnflag WHEN 'A' THEN 5 WHEN 'N' THEN 10 ELSE 20 END AS BIGINT) AS n,
      CAST(round(l_extendedprice * 100) AS BIGINT) AS c, CAST(round(l_discount * 100) AS BIGINT) AS d,
      CAST(round(l_tax * 100) AS BIGINT) AS x, l_linestatus = 'F' AS coded, l_quantity, l_linenumber,
      ['URGENT', 'HIGH', 'MEDIUM', 'LOW', 'LATE'][CAST(round(l_discount * 100) AS BIGINT) % 5 + 1] AS code,
      l_shipdate + to_minutes(l_orderkey % 1440) AS captured_at
    FROM lineitem)""",
    "price_series": """
  SELECT event_id AS id, ts AS captured_at, CAST(user_id AS VARCHAR) AS company_id, 0 AS city_id,
    length(event_type) AS diet_calories_id, 10 AS order_days,
    CASE WHEN k % 3 = 0 THEN '' ELSE 'K' || k % 3 END AS codes,
    CASE WHEN k % 10 <> 0 THEN c // 2000 * 2000 END AS per_day_net_c,
    CASE WHEN k % 10 <> 0 THEN c * 10 END AS total_c
  FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c,
      CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "observations": """
  SELECT o_orderkey AS id, o_orderdate + to_minutes(o_orderkey % 1440) AS captured_at,
    CASE WHEN o_orderstatus = 'F' THEN lower(substr(o_orderpriority, 3)) ELSE substr(o_orderpriority, 3) END AS code,
    CASE o_orderstatus WHEN 'O' THEN 'awarded-and-top' WHEN 'P' THEN 'banner' ELSE 'constant' END AS source,
    CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 3 ELSE 1 END AS feed,
    CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_custkey // 14 AS VARCHAR) END AS raw_company_id,
    CASE WHEN o_custkey % 7 <> 0 AND o_custkey // 14 IN (SELECT s_suppkey FROM supplier)
      THEN CAST(o_custkey // 14 AS VARCHAR) END AS company_id,
    o_custkey % 23 AS city_id,
    CASE WHEN o_orderkey % 4 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) % 4100 END AS discount_c,
    CASE WHEN o_orderkey % 5 <> 0 THEN 'promo ' || o_orderkey % 10 END AS promo_text,
    CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) + 30 END AS deadline,
    o_orderkey % 2 = 0 AS separate,
    CASE WHEN o_orderstatus = 'P' THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS valid_from,
    CASE WHEN o_orderstatus = 'P' THEN CAST(CAST(o_orderdate AS DATE) + 60 AS TIMESTAMP) END AS valid_to
  FROM orders""",
    "campaigns": """
  SELECT code, source, company_id,
    arg_max(discount_c, (captured_at, id)) FILTER (discount_c IS NOT NULL) AS discount_c,
    arg_max(promo_text, (captured_at, id)) FILTER (promo_text IS NOT NULL) AS title,
    arg_max(deadline, (captured_at, id)) FILTER (deadline IS NOT NULL) AS deadline,
    arg_max(deadline, (captured_at, id)) FILTER (deadline IS NOT NULL) + 15 AS ends_at,
    arg_max(separate, (captured_at, id)) AS separate,
    arg_max(valid_from, (captured_at, id)) FILTER (valid_from IS NOT NULL) AS valid_from,
    arg_max(valid_to, (captured_at, id)) FILTER (valid_to IS NOT NULL) AS valid_to,
    true AS is_active, min(captured_at) AS first_seen_at, max(captured_at) AS last_seen_at
  FROM observations GROUP BY code, source, company_id""",
    "dishes": f"""
  SELECT *, name || '|' || kcal || '|' || protein_g AS fingerprint
  FROM (SELECT (l_orderkey * 8 + l_linenumber) * 100000 + l_partkey % 100000 AS seq, {_leaf('l_partkey')},
      (l_partkey // 20 + l_linenumber % 2) % 23 AS city_id,
      CAST(l_shipdate AS DATE) + l_linenumber AS menu_date,
      ['Śniadanie', 'II śniadanie', 'Obiad - zupa', 'Obiad', 'Podwieczorek', 'Kolacja', 'Zupa dnia'][l_linenumber]
        AS slot_name,
      l_suppkey % 5 AS api_meal_slot_id, l_suppkey % 5 = l_orderkey % 5 AS is_default,
      CASE WHEN l_suppkey % 19 <> 0 THEN 'Dish ' || l_suppkey % 19 END AS name,
      CAST(floor(l_quantity / 10) * 100 AS BIGINT) AS kcal, l_linenumber % 2 AS protein_g,
      l_shipdate + to_minutes(l_orderkey % 1440) AS captured_at
    FROM lineitem)""",
    "meals": """
  SELECT company_id, name, arg_max(kcal, (captured_at, seq)) AS kcal,
    arg_max(protein_g, (captured_at, seq)) AS protein_g,
    min(captured_at) AS first_seen_at, max(captured_at) AS last_seen_at
  FROM dishes WHERE name IS NOT NULL GROUP BY company_id, name""",
    # One row per combination and month: the least by (unknown total, total, age, id).
    "cheapest": """
  SELECT unnest(best), bucket FROM (
    SELECT date_trunc('month', captured_at) AS bucket,
      arg_min(p, (total_c IS NULL, coalesce(total_c, 0), -epoch_us(captured_at), -id)) AS best
    FROM prices p GROUP BY bucket, city_id, order_days, company_id, diet_calories_id, coalesce(tier_diet_option_id, ''))""",
    # Months of a combination from the newest on, each with the price of the month stored before it.
    "recent": """
  SELECT *, rank() OVER newest_first AS rn, lead(eff_c) OVER newest_first AS prev_c
  FROM (SELECT *, (2 * total_c + order_days) // (2 * order_days) AS eff_c FROM cheapest)
  WINDOW newest_first AS (PARTITION BY order_days, city_id, diet_calories_id, company_id,
    coalesce(tier_diet_option_id, '') ORDER BY bucket DESC)""",
    # Open leaves under the composite id that prices use: NULL for ready diets, half-NULL leaves have none.
    "shelf": """
  SELECT company_id, diet_id, tier_id, diet_option_id, diet_calories_id, calories, diet_name, diet_tag,
    CAST(tier_id AS VARCHAR) || '-' || diet_option_id AS shelf_tdo
  FROM (SELECT * EXCLUDE (valid_to) FROM diet_calories WHERE valid_to IS NULL AND (tier_id IS NULL) = (diet_option_id IS NULL))
  JOIN (SELECT company_id, diet_id, name AS diet_name, diet_tag FROM diets WHERE valid_to IS NULL) USING (company_id, diet_id)""",
    "priced": """
  SELECT now.*, s.diet_id, s.tier_id, s.diet_option_id, s.calories, s.diet_name, s.diet_tag,
    (SELECT any_value(name) FROM tiers x WHERE (x.company_id, x.diet_id, x.tier_id) = (s.company_id, s.diet_id, s.tier_id))
      AS tier_name,
    (SELECT any_value(name) FROM diet_options x WHERE (x.company_id, x.diet_id, x.tier_id, x.diet_option_id)
      = (s.company_id, s.diet_id, s.tier_id, s.diet_option_id)) AS diet_option_name
  FROM shelf s JOIN (SELECT * FROM recent WHERE rn = 1) now
    ON (now.company_id, now.diet_calories_id) = (s.company_id, s.diet_calories_id)
    AND now.tier_diet_option_id IS NOT DISTINCT FROM s.shelf_tdo""",
}


def _needs(sql: str) -> set[str]:
    return {v for v in VIEWS if re.search(rf"\b{v}\b", sql)}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prepend the CTEs the statement uses, in dependency order."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for n in VIEWS:
            if n != name and n in _needs(VIEWS[name]):
                add(n)
        order.append(name)

    for n in VIEWS:
        if n in _needs(sql + " ".join((extra or {}).values())):
            add(n)
    parts = [f"{n} AS ({VIEWS[n]})" for n in order]
    parts += [f"{n} AS ({body})" for n, body in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql
