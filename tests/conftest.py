from __future__ import annotations

import sys
from datetime import date, datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession  # noqa: E402

from larderlog.schemas import table  # noqa: E402
from larderlog.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


def day(text: str) -> date:
    return date.fromisoformat(text)


@pytest.fixture
def make(spark):
    """Rows of a stored table from dicts; columns left out are NULL."""
    from pyspark.sql import functions as F

    def build(name: str, *rows: dict, **extra: str):
        schema = table(name)
        ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields]
        ddl += [f"`{c}` {t}" for c, t in extra.items()]
        names = [f.name for f in schema.fields] + list(extra)
        # Money as float literals, everything else as it is.
        loose = ", ".join(
            d if "decimal" not in d.lower() else d.split("` ")[0] + "` double" for d in ddl
        )
        df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], loose)
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields], *extra)

    return build


def rows(df, *columns):
    """Rows as plain tuples with floats for decimals."""
    from decimal import Decimal

    df = df.select(*columns) if columns else df
    return [tuple(float(v) if isinstance(v, Decimal) else v for v in r) for r in df.collect()]
