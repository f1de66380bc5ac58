"""Registry of queries with the SQL each must equal, and output shaping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = "1998-06-01"
SECONDS = "yyyy-MM-dd HH:mm:ss"
MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def check(sql: str | None = None, extra: dict[str, str] | None = None, name: str | None = None):
    """Register a query; ``sql`` may use the CTEs of ``views``."""
    def keep(fn: Query) -> Query:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = with_views(sql, extra)
        return fn

    return keep


def _plain(f: T.StructField) -> Column:
    c, t = F.col(f"`{f.name}`"), f.dataType
    if isinstance(t, (T.DecimalType, T.FloatType)):
        c = c.cast("double")
    elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
        c = c.cast("bigint")
    elif isinstance(t, T.DateType):
        c = F.date_format(c, "yyyy-MM-dd")
    elif isinstance(t, T.TimestampType):
        c = F.date_format(c, SECONDS)
    elif isinstance(t, T.ArrayType):
        c = F.array_join(c.cast("array<string>"), ",")
    return c.alias(f.name)


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles, longs, strings and booleans only, so both engines print alike."""
    df = df.select(*columns) if columns else df
    return df.select(*[_plain(f) for f in df.schema.fields])
