"""Folding a batch of normalised rows into the stored tables.

Rows carry their capture time, which stamps every change, so a fold depends on
its inputs alone and can be repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import as_date, as_time
from ..operators.folding import Policy, replace_groups, retire, upsert
from ..operators.keyed import latest_rows
from ..operators.sequence import previous_values
from ..schemas import table
from ..sources.normalise import known_companies, typed

COMPANY_ATTRIBUTES = [
    "name", "logo_url", "avg_score", "feedback_value", "feedback_number", "awarded", "price_category",
    "delivery_on_saturday", "delivery_on_sunday", "menu_enabled", "menu_days_ahead", "orders_enabled",
    "delivery_enabled",
]
DISH_ATTRIBUTES = [
    "label", "thermo", "kcal", "protein_g", "fat_g", "carbs_g", "fiber_g", "sugar_g", "saturated_fat_g",
    "salt_g", "image_url", "reviews_score", "reviews_number", "allergens", "ingredients", "fingerprint",
]
CAMPAIGN_ATTRIBUTES = [
    "discount_percent", "title", "deadline", "valid_from", "valid_to", "separate", "target", "deep_link",
    "banner_image_url",
]
HISTORY_COLUMNS = [
    "company_id", "name", "captured_at", "kcal", "protein_g", "fat_g", "carbs_g", "reviews_score",
    "reviews_number", "fingerprint",
]


def _policy(keys: list[str], overwrite: list[str], keep: list[str] = [], reopen: bool = False) -> Policy:
    fixed = {"valid_to": F.lit(None)} if reopen else {}
    return Policy(keys, [*overwrite, "updated_at"], keep, fixed)


def fold_companies(current: DataFrame, rows: DataFrame) -> DataFrame:
    """Several cities of one capture: the highest city's row stands."""
    places = ["city_id"] if "city_id" in rows.columns else []
    return upsert(current, rows, _policy(["company_id"], COMPANY_ATTRIBUTES), ["captured_at", *places])


def fold_company_cities(current: DataFrame, rows: DataFrame) -> DataFrame:
    cols = ["delivery_fee", "lowest_price_standard", "lowest_price_menu_config"]
    return upsert(current, rows, _policy(["company_id", "city_id"], cols), ["captured_at"])


def fold_cities(current: DataFrame, rows: DataFrame) -> DataFrame:
    """A known city only ever changes its name and number of companies."""
    rows = rows.withColumns({"created_at": F.col("captured_at"), "updated_at": F.col("captured_at")})
    places = [c for c in ("query", "pos") if c in rows.columns]
    return upsert(current, rows, _policy(["city_id"], ["name", "number_of_companies"]), ["captured_at", *places])


def fold_diet_tags(current: DataFrame, rows: DataFrame) -> DataFrame:
    policy = Policy(["tag_code"], ["label", "image_url"])
    return upsert(current, rows, policy, ["captured_at", "label", "image_url"])


def fold_diets(current: DataFrame, rows: DataFrame) -> DataFrame:
    """Upsert and reopen, then close what the company's payload no longer lists.

    Image, award and tag stay as first stored.
    """
    cols = [
        "name", "description", "avg_score", "feedback_value", "feedback_number", "is_menu_configuration",
        "diet_meal_count",
    ]
    keys = ["company_id", "diet_id"]
    merged = upsert(current, rows, _policy(keys, cols, reopen=True), ["captured_at", "pos"])
    return retire(merged, rows, "company_id", keys)


def fold_discounts(current: DataFrame, rows: DataFrame, diets: DataFrame) -> DataFrame:
    """Discounts of every diet in the batch are replaced, by nothing if it has none left."""
    return replace_groups(current, rows, diets, ["company_id", "diet_id"])


def fold_tiers(current: DataFrame, rows: DataFrame) -> DataFrame:
    cols = ["name", "min_price", "meals_number", "default_option_change", "tag"]
    policy = _policy(["company_id", "diet_id", "tier_id"], cols, reopen=True)
    return upsert(current, rows, policy, ["captured_at", "pos"])


def fold_options(current: DataFrame, rows: DataFrame) -> DataFrame:
    cols = ["name", "diet_option_tag", "is_default"]
    policy = _policy(["company_id", "diet_id", "tier_id", "diet_option_id"], cols, reopen=True)
    return upsert(current, rows, policy, ["captured_at", "pos"])


def fold_leaves(current: DataFrame, rows: DataFrame) -> DataFrame:
    """NULL-safe five-part key; a missing kcal keeps the stored one."""
    keys = ["company_id", "diet_id", "diet_calories_id", "tier_id", "diet_option_id"]
    policy = _policy(keys, [], ["calories"], reopen=True)
    return upsert(current, rows, policy, ["captured_at", "pos", "tier_pos", "option_pos", "leaf_pos"])


def latest_catalogue(catalogue: DataFrame) -> DataFrame:
    """Newest payload per company, for tables whose rows are replaced as a whole."""
    return latest_rows(catalogue, ["company_id"], tie=("city_id",))


def campaign_rows(observations: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """Promotion observations as campaign candidates; an empty company means global."""
    rows = observations if companies is None else known_companies(observations, companies)
    rows = rows.withColumns(
        {
            "company_id": F.nullif("company_id", F.lit("")),
            "discount_percent": F.col("discount_percents"),
            "title": F.col("promo_text"),
            "is_active": F.lit(True),
            **{c: F.col("captured_at") for c in ("first_seen_at", "last_seen_at", "created_at", "updated_at")},
        }
    )
    places = [(F.coalesce(c, F.lit(0)) if c in rows.columns else F.lit(0)).alias(c) for c in ("feed_page", "feed_pos")]
    return typed(rows, "campaigns", "captured_at", *places, F.coalesce("id", F.lit(0)).alias("id"))


def fold_campaigns(current: DataFrame, rows: DataFrame) -> DataFrame:
    """Known attributes survive unknown ones; every sighting reactivates."""
    policy = Policy(
        ["code", "source", "company_id"],
        overwrite=["last_seen_at", "updated_at"],
        keep=CAMPAIGN_ATTRIBUTES,
        fixed={"is_active": F.lit(True)},
    )
    return upsert(current, rows, policy, ["captured_at", "feed_page", "feed_pos", "id"])


def expire_campaigns(campaigns: DataFrame, as_of=None, now=None) -> DataFrame:
    """Deactivate what was last seen over 24 hours ago *and* has a deadline in the past."""
    today, moment = as_date(as_of), as_time(now if now is not None else as_of)
    stale = (
        F.col("is_active")
        & (F.col("last_seen_at") < moment - F.expr("INTERVAL 24 HOURS"))
        & (F.coalesce("deadline", today) < today)
    )
    stale = F.coalesce(stale, F.lit(False))
    return campaigns.withColumns(
        {
            "is_active": F.when(stale, F.lit(False)).otherwise(F.col("is_active")),
            "updated_at": F.when(stale, moment).otherwise(F.col("updated_at")),
        }
    )


DISH_ORDER = ["city_id", "diet_calories_id", "tier_id", "menu_date", "slot_pos", "option_pos"]


def dish_sightings(
    meals: DataFrame, dishes: DataFrame, order: list[str] = DISH_ORDER, unit: str = "day"
) -> DataFrame:
    """Named dishes of a batch with ``previous``: the fingerprint stored or seen just before.

    ``order`` breaks ties among sightings of one capture; ``unit`` cuts a dish's
    sightings for the work only.
    """
    named = dishes.where(F.col("name").isNotNull())
    types = {f.name: f.dataType for f in table("meals").fields}
    fields = [F.col(c).cast(types[c]).alias(c) for c in ["company_id", "name", *DISH_ATTRIBUTES]]
    blank = {T.LongType: 0, T.IntegerType: 0, T.StringType: "", T.DateType: "1970-01-01"}
    filled = {
        c: F.coalesce(F.col(c), F.lit(blank[type(named.schema[c].dataType)]).cast(named.schema[c].dataType))
        for c in order
    }
    batch = named.select(
        *fields, "captured_at", F.lit(1).alias("_origin"), *[v.alias(f"_{c}") for c, v in filled.items()]
    )
    stored = meals.select(
        *["company_id", "name", *DISH_ATTRIBUTES],
        F.col("last_seen_at").alias("captured_at"),
        F.lit(0).alias("_origin"),
        *[
            F.lit(blank[type(named.schema[c].dataType)]).cast(named.schema[c].dataType).alias(f"_{c}")
            for c in order
        ],
    )
    full_order = ["_origin", "captured_at", *[f"_{c}" for c in order]]
    seen = previous_values(
        batch.unionByName(stored), ["company_id", "name"], full_order, ["fingerprint"],
        [F.col("_origin"), F.date_trunc(unit, "captured_at")],
    )
    return seen.where(F.col("_origin") == 1)


def drift_events(sightings: DataFrame) -> DataFrame:
    """History rows: the new values of every sighting whose known fingerprint changed."""
    before = F.col("previous.fingerprint")
    return sightings.where(before.isNotNull() & (before != F.col("fingerprint"))).select(*HISTORY_COLUMNS)


def fold_meals(meals: DataFrame, sightings: DataFrame) -> DataFrame:
    """Next dish table; ``updated_at`` moves only on insert and drift."""
    before = F.col("previous.fingerprint")
    changed = F.col("previous").isNull() | ~before.eqNullSafe(F.col("fingerprint"))
    rows = sightings.withColumns(
        {
            "first_seen_at": F.col("captured_at"),
            "last_seen_at": F.col("captured_at"),
            "updated_at": F.when(changed, F.col("captured_at")),
        }
    )
    order = ["captured_at", *[c for c in sightings.columns if c.startswith("_") and c != "_origin"]]
    policy = Policy(
        ["company_id", "name"], overwrite=[*DISH_ATTRIBUTES, "last_seen_at"], keep=["updated_at"]
    )
    return upsert(meals, rows, policy, order)
