"""Work lists of the next capture run, and the books of the last one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_date, delivery_dates
from ..sources.tables import Tables
from .arguments import ORDER_LENGTHS
from .promotions import active_promo_codes

OPTION = ["company_id", "diet_id", "tier_id", "diet_option_id"]


def price_leaves(t: Tables, company: str | None = None) -> DataFrame:
    """Live leaves to quote; a leaf whose option is closed is left out."""
    leaves = t.diet_calories.where(F.col("valid_to").isNull())
    if company is not None:
        leaves = leaves.where(F.col("company_id") == company)
    options = t.diet_options.select(*OPTION, "tier_diet_option_id", F.col("valid_to").alias("_option_closed"))
    diets = t.diets.where(F.col("valid_to").isNull()).select("company_id", "diet_id", "is_menu_configuration")
    companies = t.companies.select("company_id", "delivery_on_saturday", "delivery_on_sunday")
    return (
        leaves.join(options, OPTION, "left")
        .where(F.col("diet_option_id").isNull() | F.col("_option_closed").isNull())
        .join(diets, ["company_id", "diet_id"])
        .join(companies, "company_id")
        .select(
            "company_id", "diet_calories_id", "diet_id", "tier_id", "tier_diet_option_id",
            "is_menu_configuration", "delivery_on_saturday", "delivery_on_sunday",
        )
    )


def quote_jobs(
    t: Tables, as_of=None, now=None, company: str | None = None, with_code_only: bool = False
) -> DataFrame:
    """Every quote of a run: leaf x order length x (no code, or one code of the company).

    Codes meet leaves by an equi join on the company; ``with_code_only`` is the
    backfill that skips the quotes without code.
    """
    leaves = price_leaves(t, company)
    coded = leaves.join(
        active_promo_codes(t.campaigns, as_of, now, company).withColumnRenamed("code", "_code"), "company_id"
    ).withColumn("promo_codes", F.array("_code")).drop("_code")
    variants = coded
    if not with_code_only:
        variants = coded.unionByName(leaves.withColumn("promo_codes", F.array().cast("array<string>")))
    lengths = F.array(*[F.lit(n) for n in ORDER_LENGTHS])
    start = F.date_add(as_date(as_of), 1)
    return (
        variants.withColumn("order_days", F.explode(lengths))
        .withColumn(
            "delivery_dates",
            delivery_dates(start, F.col("order_days"), F.col("delivery_on_saturday"), F.col("delivery_on_sunday")),
        )
        .select(
            "company_id", "diet_calories_id", "tier_id",
            F.when(
                F.coalesce("is_menu_configuration", F.lit(False)), F.nullif("tier_diet_option_id", F.lit(""))
            ).alias("tier_diet_option_id"),
            "order_days", "promo_codes", "delivery_dates",
        )
    )


def run_accounting(jobs: DataFrame, answers: DataFrame) -> DataFrame:
    """Per company: jobs planned, rows stored, failed jobs, and whether nothing came back."""
    return accounting_of_counts(jobs, answers.groupBy("company_id").agg(F.count(F.lit(1)).alias("stored")))


def accounting_of_counts(jobs: DataFrame, stored: DataFrame) -> DataFrame:
    """``run_accounting`` from counts (company_id, stored) that the writes left, several per company if need be."""
    sides = jobs.groupBy("company_id").agg(F.count(F.lit(1)).alias("jobs")).unionByName(
        stored.select("company_id", "stored"), allowMissingColumns=True
    )
    totals = sides.groupBy("company_id").agg(
        F.coalesce(F.sum("jobs"), F.lit(0)).alias("jobs"), F.coalesce(F.sum("stored"), F.lit(0)).alias("stored")
    )
    return totals.withColumn(
        "failed", F.greatest(F.col("jobs") - F.col("stored"), F.lit(0))
    ).withColumn("silent", (F.col("jobs") > 0) & (F.col("stored") == 0))


def silent_companies(accounting: DataFrame) -> DataFrame:
    return accounting.where("silent")
