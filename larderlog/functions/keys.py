"""Identity, fingerprints, prices and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, fold_case

# Fixed value: version tag of an offer key.
OFFER_VERSION = "v1"
# Order of the day's meals.
SLOT_ORDER = [
    "śniadanie",
    "i śniadanie",
    "ii śniadanie",
    "drugie śniadanie",
    "obiad",
    "podwieczorek",
    "przekąska",
    "kolacja",
]
# Fixed value: price changes below half a grosz are noise.
FLAT_DELTA = 0.005


def tier_option_id(tier: Column | str, option: Column | str) -> Column:
    """``"6-15"``; NULL as soon as one part is NULL."""
    return F.concat(col(tier).cast("string"), F.lit("-"), col(option).cast("string"))


def per_day(total: Column | str, days: Column | str) -> Column:
    """Price per delivery day; NULL for a zero length."""
    return (col(total) / F.nullif(col(days), F.lit(0))).cast("decimal(10,2)")


def fingerprint(name: Column | str, *numbers: Column | str) -> Column:
    """Drift fingerprint; equal exactly when the name and all numbers are equal."""
    fields = [F.coalesce(col(name), F.lit("")).alias("n")]
    fields += [col(c).cast("double").alias(f"v{i}") for i, c in enumerate(numbers)]
    return F.sha1(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def price_delta(current: Column | str, previous: Column | str) -> Column:
    """struct(kind, amount): down, up, or flat (also when a side is missing)."""
    delta = col(current).cast("double") - col(previous).cast("double")
    flat = delta.isNull() | F.isnan(delta) | (F.abs(delta) < FLAT_DELTA)
    kind = F.when(flat, "flat").when(delta < 0, "down").otherwise("up")
    return F.struct(kind.alias("kind"), F.when(~flat, F.abs(delta)).alias("amount"))


def offer_key(
    company: Column | str, leaf: Column | str, tdo: Column | str, configurable: Column | str
) -> Column:
    """``v1:company:leaf[:tdo]``; the last part only for configurable diets that have one."""
    tail = F.when(F.coalesce(col(configurable), F.lit(False)), F.nullif(col(tdo), F.lit("")))
    return F.concat_ws(
        ":", F.lit(OFFER_VERSION), col(company), col(leaf).cast("string"), tail
    )


def parse_offer_key(c: Column | str) -> Column:
    """struct(company_id, diet_calories_id, tier_diet_option_id, is_menu_configuration, error)."""
    parts = F.split(col(c), ":")
    version, company, leaf_text = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    leaf = F.when(F.trim(leaf_text).rlike(r"^\+?[0-9]+(\.0*)?$"), F.trim(leaf_text).try_cast("double"))
    leaf = leaf.cast("bigint")
    tdo = F.nullif(F.get(parts, F.lit(3)), F.lit(""))
    error = (
        F.when(col(c).isNull() | (F.size(parts) < 3) | (version != OFFER_VERSION), "invalid")
        .when((company == "") | leaf.isNull() | (leaf <= 0), "malformed")
    )
    ok = error.isNull()
    return F.struct(
        F.when(ok, company).alias("company_id"),
        F.when(ok, leaf).alias("diet_calories_id"),
        F.when(ok, tdo).alias("tier_diet_option_id"),
        F.when(ok, tdo.isNotNull()).alias("is_menu_configuration"),
        error.alias("error"),
    )


def slot_rank(slot: Column | str) -> Column:
    """Position of a meal slot in the day, from 0; unknown names come last."""
    name = fold_case(slot)
    hit = F.transform(
        F.array(*[F.lit(s) for s in SLOT_ORDER]),
        lambda s: (name == s)
        | F.startswith(name, F.concat(s, F.lit(" ")))
        | F.startswith(name, F.concat(s, F.lit("-"))),
    )
    place = F.array_position(hit, True)
    return F.when(place > 0, place - 1).otherwise(len(SLOT_ORDER)).cast("int")


def polish_order(c: Column | str) -> Column:
    """Sort key in Polish alphabetical order."""
    return F.collate(col(c), "pl")
