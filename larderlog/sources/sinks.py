"""Where results go: append-only observations, replaced state, snapshot documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import bucket
from ..operators.compare import partition_digests
from ..operators.joins import same_key_join
from ..operators.keyed import dealt
from ..session import work_folder

# Columns that cluster the files of an observation table inside a date.
CLUSTERING = {
    "prices": ["company_id", "diet_calories_id", "captured_at"],
    "daily_menu": ["company_id", "menu_date", "diet_calories_id"],
    "promo_observations": ["code", "company_id"],
    "company_snapshots": ["company_id"],
    "meals_history": ["company_id", "name"],
}


def append_observations(
    df: DataFrame,
    path: str,
    table: str,
    at: str = "captured_at",
    unit: str = "day",
    max_rows: int = 20_000_000,
) -> None:
    """Append, partitioned by capture date (the first day of its ``unit``).

    The rebalance hint gives one well-sized set of files per date and splits a
    date that holds most of the rows; sorting inside the files makes the
    row-group statistics of the lookup keys selective.
    """
    dated = df.withColumn("capture_date", F.to_date(bucket(at, unit)))
    cols = [c for c in CLUSTERING.get(table, []) if c in df.columns]
    dated = dated.hint("rebalance", "capture_date").sortWithinPartitions("capture_date", *cols)
    (
        dated.write.mode("append")
        .option("maxRecordsPerFile", max_rows)
        .partitionBy("capture_date")
        .parquet(path)
    )


def write_state(df: DataFrame, root: str, version: int) -> str:
    """Write the next state as its own version; plain Parquet has no MERGE.

    Writing a version again (a retried batch) replaces it.  Its number is noted
    in ``versions`` once its rows are written: a version without note does not
    count.
    """
    root = root.rstrip("/")
    path = f"{root}/version={version}"
    df.write.mode("overwrite").parquet(path)
    note = df.sparkSession.range(1).select(F.lit(version).cast("long").alias("version"))
    note.write.mode("overwrite").parquet(f"{root}/versions/{version}")
    return path


def state_versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions under ``root``."""
    try:
        notes = spark.read.schema("version long").parquet(f"{root.rstrip('/')}/versions/*")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return sorted(r["version"] for r in notes.distinct().collect())


def read_state(spark: SparkSession, root: str, schema, before: int | None = None) -> DataFrame:
    """Newest committed version (older than ``before``, if given) or an empty table."""
    usable = [v for v in state_versions(spark, root) if before is None or v < before]
    if not usable:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/version={usable[-1]}")


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    Folds mention their input several times, so chaining them without writing
    the state in between multiplies the plan.
    """
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_accounted(rows: DataFrame, root: str, batch_id: int, by: Sequence[str] = ("company_id",)) -> dict[str, int]:
    """Write a batch with its accounting; gives its totals.

    Totals (``rows``, ``priced``) are observed while the rows are written, nothing
    is read again for them.  Counts per ``by`` are one aggregate over the columns it needs of what was written.
    A batch that is run again replaces its rows and its accounting.
    """
    root, seen = root.rstrip("/"), Observation()
    observed = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count("total_cost").alias("priced"))
    observed.write.mode("overwrite").parquet(f"{root}/rows/batch_id={batch_id}")
    totals = {k: int(v) for k, v in seen.get.items()}
    spark = rows.sparkSession
    note = spark.createDataFrame([(totals["rows"], totals["priced"])], "rows BIGINT, priced BIGINT")
    written = spark.read.schema(rows.schema).parquet(f"{root}/rows/batch_id={batch_id}")
    counts = written.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count("total_cost").alias("priced"))
    counts.write.mode("overwrite").parquet(f"{root}/counts/batch_id={batch_id}")
    note.coalesce(1).write.mode("overwrite").parquet(f"{root}/totals/batch_id={batch_id}")
    return totals


def accounted(spark: SparkSession, root: str, what: str = "counts") -> DataFrame:
    """``counts`` per key and batch, or the ``totals`` per batch."""
    return spark.read.parquet(f"{root.rstrip('/')}/{what}")


def snapshot_documents(
    catalogue: DataFrame,
    leaves: DataFrame,
    menus: DataFrame | None = None,
    promos: DataFrame | None = None,
    listing: DataFrame | None = None,
    card: DataFrame | None = None,
    prices: DataFrame | None = None,
) -> DataFrame:
    """One nested document per (city, company, run): header, summary, card, leaves with quotes, menus, promotions.

    A run is the capture time that all its parts carry.  Each part is collected
    per company and run, which the catalogue bounds; the city as a whole is a
    set of documents, never one row.  ``listing`` and ``card`` are one row per
    company and run; of ``prices`` each leaf gets its quotes of the run.
    """
    keys = ["city_id", "company_id", "captured_at"]

    def nested(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))

    if prices is not None:
        leaf = ["diet_calories_id", "tier_diet_option_id"]
        rest = [c for c in prices.columns if c not in (*keys, *leaf)]
        quotes = prices.groupBy(*keys, *leaf).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("quotes"))
        leaves = same_key_join(leaves, quotes, [*keys, *leaf], "left")
    out = catalogue.select(*keys, "companyHeader", "companyParams", "menuSettings")
    for df, name in ((leaves, "leaves"), (menus, "menus"), (promos, "promotions")):
        if df is not None:
            out = out.join(nested(df, name), keys, "left")
    for df, name in ((listing, "summary"), (card, "card")):
        if df is not None:
            whole = F.struct(*[c for c in df.columns if c not in keys]).alias(name)
            out = out.join(df.select(*keys, whole), keys, "left")
    return out.withColumn("snapshot_date", F.to_date("captured_at")).withColumnRenamed("captured_at", "snapshot_timestamp")


def write_snapshot(documents: DataFrame, path: str) -> None:
    """JSON lines partitioned by city and date; a rerun of a date replaces that date."""
    (
        documents.hint("rebalance", "city_id", "snapshot_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("city_id", "snapshot_date")
        .json(path)
    )


def write_compared(
    rows: DataFrame,
    path: str,
    levels: Sequence[Sequence[str]],
    keys: Sequence[str],
    values: Sequence[str],
    merge: Mapping[str, Column] | None = None,
) -> None:
    """Write one snapshot with the digests by which ``plans.snapshots.stored_diff`` prunes.

    Rows are partitioned by the columns of the first level and sorted by those
    of the last inside the files; digests are one narrow row per partition of the last level.

    ``merge`` names an aggregate per value, which can be applied to its own results:
    rows that share a key are merged, in the shuffle that clusters them.
    """
    path = path.rstrip("/")
    coarse, fine = list(levels[0]), list(levels[-1])
    columns = list(dict.fromkeys([*keys, *values]))

    def merged(some: DataFrame, *more: str) -> DataFrame:
        return some.groupBy(*more, *keys).agg(*[merge[v].alias(v) for v in values]).select(*columns)

    if merge is None:
        clustered = rows.select(*columns).hint("rebalance", *coarse)
    else:
        clustered = merged(dealt(rows.select(*columns), coarse, keys, merged), "_part")
    clustered = clustered.sortWithinPartitions(*coarse, *fine)
    clustered.write.mode("overwrite").partitionBy(*coarse).parquet(f"{path}/rows")
    written = read_compared(rows.sparkSession, path, rows.select(*dict.fromkeys([*keys, *values])).schema)
    partition_digests(written, fine, keys, values).write.mode("overwrite").parquet(f"{path}/digests")


def read_compared(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/rows")
