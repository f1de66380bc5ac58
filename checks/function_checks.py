"""Scalar functions over whole columns and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from larderlog.functions import dates, keys, lists, text
from larderlog.sources.starviews import load, star_tables

from .registry import check, plain

FIRST = "TRY_CAST(replace(nullif(regexp_extract({t}, '[0-9]+([.,][0-9]+)?'), ''), ',', '.') AS DOUBLE)"
MONEY = (
    "TRY_CAST(nullif(regexp_extract(regexp_replace(regexp_replace({t}, '^([^,]*),', '\\1.'), '[^0-9.\\-]', '', 'g'), "
    "'^-?([0-9]+\\.?[0-9]*|\\.[0-9]+)'), '') AS DOUBLE)"
)


@check(f"SELECT doc_id, {FIRST.format(t='text')} AS first_number, {MONEY.format(t='text')} AS money FROM documents")
def numbers_in_documents(spark, folder):
    docs = load(spark, folder, "documents")
    return plain(
        docs.select("doc_id", text.first_number("text").alias("first_number"), text.money("text").alias("money"))
    )




@check(
    """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity AS kcal, CAST(l_linenumber AS DOUBLE) AS protein_g,
  NULL::DOUBLE AS carbs_g, l_tax AS fat_g FROM lineitem
"""
)
def macros_of_lines(spark, folder):
    info = F.concat(
        F.lit("x "), F.col("l_quantity").cast("string"), F.lit(" KCAL • B:"), "l_linenumber",
        F.lit(" g • T: "), F.format_number("l_tax", 2), F.lit("g"),
    )
    rows = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", text.macros(info).alias("m"))
    return plain(rows.select("l_orderkey", "l_linenumber", "m.*"))


@check(
    """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice AS price, CASE WHEN l_discount > 0 THEN -l_discount ELSE 0 END
  AS change, NULL::DOUBLE AS nothing FROM lineitem
"""
)
def money_of_lines(spark, folder):
    """Polish and English spellings of an amount, and text that is none."""
    polish = F.concat(
        F.replace(F.replace(F.format_number("l_extendedprice", 2), F.lit(","), F.lit(" ")), F.lit("."), F.lit(",")),
        F.lit(" zł"),
    )
    minus = F.concat(F.when(F.col("l_discount") > 0, "-").otherwise(""), F.format_number("l_discount", 2), F.lit(" ZŁ"))
    rows = load(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", text.money(polish).alias("price"), text.money(minus).alias("change"),
        text.money(F.concat(F.lit("od "), "l_returnflag")).alias("nothing"),
    )
    return plain(rows)


TIDY = "[y FOR y IN [trim(x, ' ' || chr(9) || chr(13)) FOR x IN string_split(text, chr(10))] IF y <> '']"


@check(
    f"""
SELECT doc_id, len(list_distinct({TIDY})) AS lines, list_min({TIDY}) AS first,
  nullif(array_to_string({TIDY}, '; '), '') AS joined FROM documents
"""
)
def tidy_lists(spark, folder):
    """Names of a list trimmed, made distinct and sorted, or joined in order: lines of a document."""
    lines = F.split("text", "\n")
    rows = load(spark, folder, "documents").select(
        "doc_id",
        F.size(lists.tidy_names(lines)).alias("lines"),
        F.get(lists.tidy_names(lines), F.lit(0)).alias("first"),
        lists.name_list(lines).alias("joined"),
    )
    return plain(rows)


@check(
    """
SELECT o_orderkey, (SELECT string_agg(strftime(x, '%Y-%m-%d'), ',' ORDER BY x) FROM (
    SELECT CAST(o_orderdate AS DATE) + CAST(i AS INTEGER) AS x FROM generate_series(0, 40) g(i)
    WHERE (o_custkey % 2 = 0 OR dayofweek(CAST(o_orderdate AS DATE) + CAST(i AS INTEGER)) <> 6)
      AND (o_custkey % 3 = 0 OR dayofweek(CAST(o_orderdate AS DATE) + CAST(i AS INTEGER)) <> 0)
    QUALIFY row_number() OVER (ORDER BY i) <= o_orderkey % 20 + 1)) AS deliveries,
  strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 20 AS INTEGER), '%Y-%m-%d') AS last_day
FROM orders
"""
)
def delivery_dates(spark, folder):
    n = (F.col("o_orderkey") % 20 + 1).cast("int")
    day = F.col("o_orderdate").cast("date")
    rows = load(spark, folder, "orders").select(
        "o_orderkey",
        dates.delivery_dates(day, n, F.col("o_custkey") % 2 == 0, F.col("o_custkey") % 3 == 0).alias("deliveries"),
        F.element_at(dates.calendar_dates(day, n), -1).alias("last_day"),
    )
    return plain(rows)


@check(
    """
SELECT p_partkey, CASE WHEN p_size < 5 THEN 'v2' ELSE 'v1' END || ':' || CASE WHEN p_size = 5 THEN '' ELSE p_brand END
    || ':' || (p_partkey - 3) || CASE WHEN p_size > 40 THEN ':7-' || p_size ELSE '' END AS offer_id,
  CASE WHEN p_size >= 5 AND p_size <> 5 AND p_partkey > 3 THEN p_brand END AS company_id,
  CASE WHEN p_size >= 5 AND p_size <> 5 AND p_partkey > 3 THEN p_partkey - 3 END AS diet_calories_id,
  CASE WHEN p_size > 40 AND p_partkey > 3 THEN '7-' || p_size END AS tdo,
  CASE WHEN p_size < 5 THEN 'invalid' WHEN p_size = 5 OR p_partkey <= 3 THEN 'malformed' END AS error,
  CASE WHEN p_size < 5 OR p_size = 5 OR p_partkey <= 3 THEN false
    ELSE true END AS round_trip
FROM part
"""
)
def offer_keys(spark, folder):
    """Keys good and bad are taken apart, and good ones put together again."""
    raw = F.expr(
        "concat(CASE WHEN p_size < 5 THEN 'v2' ELSE 'v1' END, ':', CASE WHEN p_size = 5 THEN '' ELSE p_brand END, ':', "
        "p_partkey - 3, CASE WHEN p_size > 40 THEN concat(':7-', p_size) ELSE '' END)"
    )
    rows = load(spark, folder, "part").select("p_partkey", raw.alias("offer_id"))
    rows = rows.withColumn("o", keys.parse_offer_key("offer_id"))
    again = keys.offer_key("o.company_id", "o.diet_calories_id", "o.tier_diet_option_id", "o.is_menu_configuration")
    return plain(
        rows.select(
            "p_partkey", "offer_id", "o.company_id", "o.diet_calories_id",
            F.col("o.tier_diet_option_id").alias("tdo"), "o.error",
            (F.col("o.error").isNull() & (again == F.col("offer_id"))).alias("round_trip"),
        )
    )


@check(
    """
SELECT count(*) AS rows, count(DISTINCT (coalesce(name, ''), kcal, protein_g)) AS prints FROM dishes
"""
)
def fingerprints(spark, folder):
    """Fingerprints separate exactly what the fields separate."""
    mark = keys.fingerprint("name", "kcal", "protein_g", "carbs_g", "fat_g", "reviews_score", "reviews_number")
    rows = star_tables(spark, folder).dishes.select(mark.alias("f"))
    return plain(rows.agg(F.count("*").alias("rows"), F.countDistinct("f").alias("prints")))


@check(
    """
SELECT event_id, user_id || ' · ' || event_type AS line, lower(event_type) = event_type AS same,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(round(value * 100) AS BIGINT) / 100.0 / nullif(event_id % 5, 0) END
    IS NULL AS undefined
FROM events
"""
)
def labels_and_guards(spark, folder):
    total = F.when(F.col("event_id") % 7 != 0, F.col("value").cast("decimal(10,2)"))
    rows = load(spark, folder, "events").select(
        "event_id",
        text.joined_line(F.col("user_id").cast("string"), F.lit(None).cast("string"), F.lit(""), "event_type").alias("line"),
        text.same_text(F.upper("event_type"), "event_type").alias("same"),
        keys.per_day(total, F.col("event_id") % 5).isNull().alias("undefined"),
    )
    return plain(rows)
