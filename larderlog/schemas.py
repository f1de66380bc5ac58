"""Column sets of the stored tables and shapes of the landed payloads.

Identifiers are BIGINT and natural: no serial numbers.  Money is DECIMAL(10,2).
"""

from __future__ import annotations

from pyspark.sql import types as T

STAMPS = "created_at TIMESTAMP, updated_at TIMESTAMP"
VALIDITY = "valid_from TIMESTAMP, valid_to TIMESTAMP"

TABLES: dict[str, str] = {
    "cities": "city_id BIGINT, name STRING, sanitized_name STRING, county_name STRING, "
    "municipality_name STRING, province_name STRING, city_status BOOLEAN, "
    f"number_of_companies INT, largest_city_for_name BOOLEAN, {STAMPS}",
    "companies": "company_id STRING, name STRING, logo_url STRING, avg_score DECIMAL(5,2), "
    "feedback_value DECIMAL(4,2), feedback_number INT, awarded BOOLEAN, price_category STRING, "
    "delivery_on_saturday BOOLEAN, delivery_on_sunday BOOLEAN, menu_enabled BOOLEAN, "
    f"menu_days_ahead INT, orders_enabled BOOLEAN, delivery_enabled BOOLEAN, {STAMPS}",
    "company_cities": "company_id STRING, city_id BIGINT, delivery_fee DECIMAL(10,2), "
    f"lowest_price_standard DECIMAL(10,2), lowest_price_menu_config DECIMAL(10,2), {STAMPS}",
    "diet_tags": "tag_code STRING, label STRING, description STRING, image_url STRING",
    "diets": "diet_id BIGINT, company_id STRING, name STRING, description STRING, image_url STRING, "
    "awarded BOOLEAN, avg_score DECIMAL(5,2), feedback_value DECIMAL(4,2), feedback_number INT, "
    f"diet_tag STRING, is_menu_configuration BOOLEAN, diet_meal_count INT, {STAMPS}, {VALIDITY}",
    "diet_discounts": "diet_id BIGINT, company_id STRING, discount DECIMAL(6,2), minimum_days INT, "
    "discount_type STRING",
    "tiers": "tier_id BIGINT, diet_id BIGINT, company_id STRING, name STRING, min_price DECIMAL(10,2), "
    f"meals_number INT, default_option_change BOOLEAN, tag STRING, {STAMPS}, {VALIDITY}",
    "diet_options": "diet_option_id BIGINT, tier_id BIGINT, diet_id BIGINT, company_id STRING, "
    "tier_diet_option_id STRING, name STRING, diet_option_tag STRING, is_default BOOLEAN, "
    f"{STAMPS}, {VALIDITY}",
    "diet_calories": "diet_calories_id BIGINT, diet_option_id BIGINT, tier_id BIGINT, diet_id BIGINT, "
    f"company_id STRING, calories INT, {STAMPS}, {VALIDITY}",
    "prices": "id BIGINT, diet_calories_id BIGINT, company_id STRING, city_id BIGINT, "
    "tier_diet_option_id STRING, order_days INT, promo_codes ARRAY<STRING>, "
    "per_day_cost DECIMAL(10,2), per_day_cost_with_discounts DECIMAL(10,2), "
    "total_cost DECIMAL(10,2), total_cost_without_discounts DECIMAL(10,2), "
    "total_delivery_cost DECIMAL(10,2), total_order_length_discount DECIMAL(10,2), "
    "total_promo_code_discount DECIMAL(10,2), total_delivery_discount DECIMAL(10,2), "
    "captured_at TIMESTAMP",
    "campaigns": "code STRING, source STRING, company_id STRING, title STRING, starts_at DATE, "
    "ends_at DATE, discount_percent DECIMAL(5,2), banner_image_url STRING, is_active BOOLEAN, "
    "first_seen_at TIMESTAMP, last_seen_at TIMESTAMP, deadline DATE, valid_from TIMESTAMP, "
    f"valid_to TIMESTAMP, separate BOOLEAN, deep_link STRING, target STRING, {STAMPS}",
    "promo_observations": "id BIGINT, captured_at TIMESTAMP, code STRING, source STRING, "
    "company_id STRING, city_id BIGINT, discount_percents DECIMAL(5,2), promo_text STRING, "
    "deadline DATE, separate BOOLEAN, valid_from TIMESTAMP, valid_to TIMESTAMP, raw STRING",
    "company_snapshots": "company_id STRING, avg_score DECIMAL(5,2), feedback_value DECIMAL(4,2), "
    "feedback_number INT, awarded BOOLEAN, price_category STRING, captured_at TIMESTAMP",
    "meals": "company_id STRING, name STRING, label STRING, thermo STRING, kcal DECIMAL(7,2), "
    "protein_g DECIMAL(7,2), fat_g DECIMAL(7,2), carbs_g DECIMAL(7,2), fiber_g DECIMAL(7,2), "
    "sugar_g DECIMAL(7,2), saturated_fat_g DECIMAL(7,2), salt_g DECIMAL(7,2), image_url STRING, "
    "reviews_score DECIMAL(5,2), reviews_number INT, allergens ARRAY<STRING>, ingredients STRING, "
    "fingerprint STRING, first_seen_at TIMESTAMP, last_seen_at TIMESTAMP, updated_at TIMESTAMP",
    "meals_history": "company_id STRING, name STRING, captured_at TIMESTAMP, kcal DECIMAL(7,2), "
    "protein_g DECIMAL(7,2), fat_g DECIMAL(7,2), carbs_g DECIMAL(7,2), reviews_score DECIMAL(5,2), "
    "reviews_number INT, fingerprint STRING",
    "daily_menu": "id BIGINT, captured_at TIMESTAMP, company_id STRING, city_id BIGINT, "
    "diet_calories_id BIGINT, tier_id BIGINT, menu_date DATE, slot_name STRING, meal_name STRING, "
    "api_meal_slot_id BIGINT, is_default BOOLEAN",
}

PROMO = (
    "STRUCT<promoText STRING, promoDeadline DATE, code STRING, discountPercents DOUBLE, separate BOOLEAN>"
)
OPTION = (
    "STRUCT<dietOptionId BIGINT, tierDietOptionId STRING, name STRING, dietOptionTag STRING, "
    "defaultOption BOOLEAN, dietCalories ARRAY<STRUCT<dietCaloriesId BIGINT, calories INT>>>"
)
# Ingest keys the landing step adds to a raw response.
REQUEST = "company_id STRING, city_id BIGINT, captured_at TIMESTAMP"

PAYLOADS: dict[str, str] = {
    "catalogue": f"{REQUEST}, companyHeader STRUCT<name STRING, logoUrl STRING, rateValue DOUBLE, "
    f"feedbackValue DOUBLE, feedbackNumber INT, awarded BOOLEAN, activePromotionInfo {PROMO}>, "
    "companyParams STRUCT<deliveryOnSaturday BOOLEAN, deliveryOnSunday BOOLEAN>, "
    "menuSettings STRUCT<menuEnabled BOOLEAN, menuDaysAhead INT>, "
    "companyDiets ARRAY<STRUCT<dietId BIGINT, name STRING, description STRING, imageUrl STRING, "
    "awarded BOOLEAN, avgScore DOUBLE, feedbackValue DOUBLE, feedbackNumber INT, dietTag STRING, "
    "isMenuConfiguration BOOLEAN, dietMealCount INT, "
    "discounts ARRAY<STRUCT<discount DOUBLE, minimumDays INT, discountType STRING>>, "
    f"dietOptions ARRAY<{OPTION}>, dietTiers ARRAY<STRUCT<tierId BIGINT, name STRING, "
    "minPrice STRING, mealsNumber INT, defaultOptionChange BOOLEAN, tag STRING, "
    f"dietOptions ARRAY<{OPTION}>>>>>",
    "city_card": f"{REQUEST}, dietPriceInfo ARRAY<STRUCT<dietId BIGINT, discountPrice STRING, "
    "defaultPrice STRING, dietCaloriesIds ARRAY<BIGINT>, dietPriceInCompanyPromotion BOOLEAN>>, "
    "companyPriceCategory STRING, companySettings STRUCT<ordersEnabled BOOLEAN, "
    "deliveryEnabled BOOLEAN>, citySearchResult STRUCT<cityId BIGINT, deliveryFee DOUBLE>, "
    "lowestPrice STRUCT<standard STRING, menuConfiguration STRING>",
    "listing": f"{REQUEST}, currentPage INT, totalPages INT, totalElements INT, "
    "searchData ARRAY<STRUCT<name STRING, fullName STRING, rate DOUBLE, numberOfRates INT, "
    f"awarded BOOLEAN, priceCategory STRING, activePromotionInfo {PROMO}>>",
    "quote": f"{REQUEST}, diet_calories_id BIGINT, tier_diet_option_id STRING, order_days INT, "
    "promo_codes ARRAY<STRING>, cart STRUCT<totalCostToPay DOUBLE, totalCostWithoutDiscounts DOUBLE, "
    "totalDeliveryCost DOUBLE, totalOrderLengthDiscount DOUBLE, totalPromoCodeDiscount DOUBLE, "
    "totalDeliveriesOnDateDiscount DOUBLE>, items ARRAY<STRUCT<perDayDietCost DOUBLE, "
    "perDayDietWithDiscountsCost DOUBLE>>",
    "menu": f"{REQUEST}, diet_calories_id BIGINT, tier_id BIGINT, date DATE, calories INT, "
    "meals ARRAY<STRUCT<name STRING, baseDietCaloriesMealId BIGINT, options ARRAY<STRUCT<"
    "dietCaloriesMealId BIGINT, name STRING, label STRING, info STRING, thermo STRING, "
    "reviewsNumber INT, reviewsScore DOUBLE, details STRUCT<name STRING, imageUrl STRING, "
    "calories STRING, protein STRING, carbohydrate STRING, fat STRING, saturatedFattyAcids STRING, "
    "sugar STRING, salt STRING, dietaryFiber STRING, thermo STRING, "
    # Allergen objects carry the company's and the service's own name; a map
    # avoids pinning the latter's field name.
    "allergensWithExcluded ARRAY<MAP<STRING, STRING>>, ingredients ARRAY<STRUCT<name STRING>>>>>>>",
    "banner": f"{REQUEST}, name STRING, code STRING, url STRING, validFrom TIMESTAMP, "
    "validTo TIMESTAMP, deepLink STRING, target STRING, priority INT, type STRING",
    "recommended": f"{REQUEST}, companyData STRUCT<companyId STRING>, activePromotion {PROMO}",
    "tag_dictionary": "captured_at TIMESTAMP, tags MAP<STRING, STRUCT<dietTagId STRING, name STRING, "
    "imageUrl STRING>>",
    "city_search": f"captured_at TIMESTAMP, query STRING, cities ARRAY<STRUCT<cityId BIGINT, "
    "name STRING, sanitizedName STRING, countyName STRING, municipalityName STRING, "
    "provinceName STRING, cityStatus BOOLEAN, numberOfCompanies INT, largestCityForName BOOLEAN>>",
}

REJECT_COLUMN = "_corrupt_record"


def table(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def payload(name: str) -> T.StructType:
    return T.StructType.fromDDL(PAYLOADS[name])
