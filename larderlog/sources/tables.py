"""The stored tables as one object of lazily read DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from ..schemas import TABLES, table


@dataclass
class Tables:
    """Every attribute is a DataFrame with the columns of ``schemas.TABLES``."""

    cities: DataFrame | None = None
    companies: DataFrame | None = None
    company_cities: DataFrame | None = None
    diet_tags: DataFrame | None = None
    diets: DataFrame | None = None
    diet_discounts: DataFrame | None = None
    tiers: DataFrame | None = None
    diet_options: DataFrame | None = None
    diet_calories: DataFrame | None = None
    prices: DataFrame | None = None
    campaigns: DataFrame | None = None
    promo_observations: DataFrame | None = None
    company_snapshots: DataFrame | None = None
    meals: DataFrame | None = None
    meals_history: DataFrame | None = None
    daily_menu: DataFrame | None = None

    def register(self) -> None:
        """Make every present table a temporary view for ``spark.sql``."""
        for f in fields(self):
            df = getattr(self, f.name)
            if df is not None:
                df.createOrReplaceTempView(f.name)


def read_tables(spark: SparkSession, root: str, names: list[str] | None = None) -> Tables:
    return Tables(
        **{n: spark.read.schema(table(n)).parquet(f"{root}/{n}") for n in names or list(TABLES)}
    )


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], table(name))


def empty_tables(spark: SparkSession) -> Tables:
    return Tables(**{n: empty_table(spark, n) for n in TABLES})
