"""What the operators of this subpackage share: tables, words, written intermediates, spread joins."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator, Sequence
from typing import TypeVar

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_folder

#: White space of every contract here: space and the controls 0x09 to 0x0D.
SPACE, WHITE = r"[\x20\x09-\x0D]", " \t\n\v\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS_PER_SHINGLE = 5

Batch = TypeVar("Batch", pd.DataFrame, pa.RecordBatch)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(c: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def text_key(c: str | Column = "text") -> Column:
    """SHA-256 of the text, null as empty."""
    return F.unhex(F.sha2(text_of(c).cast("binary"), 256))


def lowered(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of a non-null text, in order; empty array without any."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def settled(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    The lineage ends at files every executor can read, so a lost executor costs
    the tasks it ran and no recomputation of earlier stages.
    """
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_rows(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """At most so many rows at a time: what a task makes of texts is larger than they are."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at:at + rows]


_remembered: dict[str, object] = {}


def remembered(key: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps between its batches, made when it is missing; see ``lean``."""
    if key not in _remembered:
        _remembered[key] = make()
    return _remembered[key]


def _forget(keeps: str | None) -> None:
    for key in _remembered.keys() - {keeps}:
        del _remembered[key]


def lean(run: Callable[[Iterator[Batch]], Iterator[Batch]], keeps: str | None = None) -> Callable[[Iterator[Batch]], Iterator[Batch]]:
    """``run`` without memory of other tasks: Python workers outlive their tasks and serve every operator in turn.

    When a task begins and when it ends, all that is ``remembered`` goes, but what it ``keeps`` for later
    tasks of its kind; freed memory is handed back to the system.
    """
    @functools.wraps(run)
    def task(batches: Iterator[Batch]) -> Iterator[Batch]:
        _forget(keeps)
        try:
            yield from run(batches)
        finally:
            _forget(keeps)
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed blocks otherwise
            if trim is not None:
                trim(0)

    return task


def spread_join(
    rows: DataFrame, facts: DataFrame, keys: Sequence[str], salt_by: Sequence[str], how: str = "left", salts: int = 16
) -> DataFrame:
    """Join many rows to one fact per key where one key may hold a third of the rows.

    Rows of a key are dealt to ``salts`` partitions by a hash of ``salt_by``; each
    fact is repeated once per salt.  Keys compare NULL-safely.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    names = {k: f"_fact_{i}" for i, k in enumerate(keys)}
    facts = facts.select(
        *[F.col(k).alias(names[k]) for k in keys],
        *[c for c in facts.columns if c not in keys],
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_fact_salt"),
    )
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()] + [F.col("_salt") == F.col("_fact_salt")]
    return salted.join(facts, functools.reduce(Column.__and__, same), how).drop("_salt", "_fact_salt", *names.values())


def warm_join(
    rows: DataFrame, facts: DataFrame, keys: Sequence[str], salt_by: Sequence[str], how: str = "left", hot: int = 1000, salts: int = 16
) -> DataFrame:
    """As ``spread_join``, for wide facts: only facts of keys with more than ``hot`` rows are repeated.

    ``rows`` are counted by key first, so they should be narrow and cheap to read.
    """
    names = {k: f"_hot_{i}" for i, k in enumerate(keys)}
    counts = rows.groupBy(*[F.col(k).alias(n) for k, n in names.items()]).agg(F.count(F.lit(1)).alias("_n"))
    crowded = settled(counts.where(F.col("_n") > hot).select(*names.values()), "hot-keys")
    facts = facts.withColumnsRenamed({k: f"_fact_{i}" for i, k in enumerate(keys)})
    same = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_fact_{i}")) for i, k in enumerate(keys)])
    drop = [f"_fact_{i}" for i in range(len(keys))]
    if crowded.isEmpty():
        return rows.join(facts, same, how).drop(*drop)
    # One of so many rows at most is a key here, and a row of it is as wide as the key.
    is_hot = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    fact_hot = functools.reduce(Column.__and__, [F.col(f"_fact_{i}").eqNullSafe(F.col(n)) for i, n in enumerate(names.values())])
    salted = rows.join(crowded.withColumn("_crowded", F.lit(True)), is_hot, "left")
    salted = salted.withColumn("_salt", F.when(F.col("_crowded"), F.pmod(F.xxhash64(*salt_by), F.lit(salts))).otherwise(0).cast("int"))
    repeated = facts.join(crowded.withColumn("_crowded", F.lit(True)), fact_hot, "left").withColumn(
        "_fact_salt", F.explode(F.when(F.col("_crowded"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    ).drop(*names.values(), "_crowded")
    joined = salted.drop(*names.values(), "_crowded").join(repeated, same & (F.col("_salt") == F.col("_fact_salt")), how)
    return joined.drop("_salt", "_fact_salt", *drop)
