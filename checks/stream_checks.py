"""Streams run to completion over the tables and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from larderlog.plans import state
from larderlog.schemas import REJECT_COLUMN, table
from larderlog.session import work_folder
from larderlog.sources import normalise
from larderlog.sources.buckets import BucketedState
from larderlog.sources.payloads import stream_payload
from larderlog.sources.sinks import read_state
from larderlog.sources.starviews import companies, load, price_series, promo_observations
from larderlog.streaming import ingest, keyed, prices

from . import payload_texts as texts
from .catering_checks import CHANGES, changed
from .payload_checks import QUOTED
from .promotion_checks import CAMPAIGN_COLUMNS, CAMPAIGN_SQL
from .registry import check, plain


def stream(spark, folder, name):
    """A table as a file stream."""
    schema = load(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def land_text(lines, path):
    """Payloads land compressed; files stay small, as one of them is read by one task."""
    lines.write.option("compression", "gzip").option("maxRecordsPerFile", 250_000).text(path)


@check(
    """
SELECT strftime(date_trunc('day', captured_at), '%Y-%m-%d') AS day, company_id, diet_calories_id,
  CAST(total_c AS DOUBLE) / 100 AS total_cost, id
FROM (SELECT DISTINCT ON (company_id, diet_calories_id, date_trunc('day', captured_at)) * FROM price_series
  ORDER BY company_id, diet_calories_id, date_trunc('day', captured_at), total_c ASC NULLS LAST, captured_at DESC, id DESC)
"""
)
def daily_cheapest_stream(spark, folder):
    rows = prices.daily_cheapest(price_series(stream(spark, folder, "events")), delay="40 days")
    out = work_folder(spark, "daily-cheapest")
    prices.write_updates(rows, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    days = prices.read_updates(spark, f"{out}/rows", ["day", *prices.COMBO])
    return plain(days.select(F.to_date("day").alias("day"), "company_id", "diet_calories_id", "total_cost", "id"))


@check(CHANGES)
def price_change_stream(spark, folder):
    """Captures arrive in no order, in three micro-batches of eight files."""
    out = work_folder(spark, "price-changes")
    series = price_series(load(spark, folder, "events"))
    series.repartition(24, F.xxhash64("id")).write.parquet(f"{out}/landed")
    quotes = spark.readStream.schema(series.schema).option("maxFilesPerTrigger", 8).parquet(f"{out}/landed")
    prices.change_stream(
        quotes, f"{out}/events", f"{out}/state", f"{out}/checkpoint", lateness="400 days"
    ).awaitTermination()
    return changed(prices.read_changes(spark, f"{out}/events"))


@check(CHANGES)
def price_change_keyed_stream(spark, folder):
    """The same by state per leaf; every delivery of up to eight files arrives an hour after the one before."""
    out = work_folder(spark, "keyed-changes")
    series = price_series(load(spark, folder, "events"))
    for hour in range(3):
        part = series.where(F.pmod(F.xxhash64("id"), F.lit(3)) == hour)
        part = part.withColumn("landed_at", F.expr(f"TIMESTAMP '2024-03-01 0{hour}:00:00'"))
        part.repartition(8, "id").write.mode("append").parquet(f"{out}/landed")
    quotes = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 8).parquet(f"{out}/landed")
    told = keyed.keyed_changes(quotes, "landed_at", lateness="400 days")
    keyed.write_keyed_changes(told, f"{out}/changes", f"{out}/checkpoint").awaitTermination()
    return changed(keyed.read_keyed_changes(spark, f"{out}/changes"))


@check(
    """
SELECT 'not json ' || o_orderkey AS raw, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL
"""
)
def stream_rejects(spark, folder):
    """Unreadable payloads of a stream keep their raw text."""
    out = work_folder(spark, "rejects")
    key = F.col("o_orderkey")
    good = F.to_json(F.struct(key.cast("string").alias("company_id"), F.col("o_orderdate").alias("captured_at")))
    land_text(load(spark, folder, "orders").select(
        F.when(key % 3 == 0, F.concat(F.lit("not json "), key.cast("string"))).otherwise(good).alias("value")
    ), f"{out}/landed")
    ingest.append_stream(
        stream_payload(spark, "quote", f"{out}/landed"), normalise.price_rows, f"{out}/prices", f"{out}/checkpoint",
        unit="year",
    ).awaitTermination()
    bad = spark.read.parquet(f"{out}/prices-rejects").withColumnRenamed(REJECT_COLUMN, "raw")
    return plain(bad.groupBy("raw").agg(F.count(F.lit(1)).alias("n")))


@check(CAMPAIGN_SQL + "FROM campaigns")
def campaign_stream(spark, folder):
    firms = companies(load(spark, folder, "supplier"))
    out = work_folder(spark, "campaigns")
    seen = promo_observations(stream(spark, folder, "orders"))
    ingest.fold_stream(
        seen,
        lambda current, batch: state.fold_campaigns(current, state.campaign_rows(batch, firms)),
        table("campaigns"),
        f"{out}/state",
        f"{out}/checkpoint",
    ).awaitTermination()
    return plain(read_state(spark, f"{out}/state", table("campaigns")), *CAMPAIGN_COLUMNS)


@check(CAMPAIGN_SQL + "FROM campaigns")
def campaign_bucket_stream(spark, folder):
    """Sightings land in eight files, one micro-batch each; at most two versions of a bucket can be read."""
    firms = companies(load(spark, folder, "supplier"))
    out = work_folder(spark, "campaign-buckets")
    landed = load(spark, folder, "orders")
    landed.repartition(8, "o_orderpriority", "o_orderstatus").write.parquet(f"{out}/landed")
    orders = spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/landed")
    kept = BucketedState(spark, f"{out}/state", table("campaigns"), ["code", "source", "company_id"], buckets=16, keep=2)
    ingest.bucketed_fold_stream(
        promo_observations(orders), state.fold_campaigns, kept, f"{out}/checkpoint",
        lambda batch: state.campaign_rows(batch, firms),
    ).awaitTermination()
    return plain(kept.read(), *CAMPAIGN_COLUMNS)


@check(
    f"""
SELECT CAST(l_partkey // 20 AS VARCHAR) AS company_id, l_partkey AS diet_calories_id, l_extendedprice AS total_cost,
  strftime(date_trunc('year', l_shipdate), '%Y-%m-%d') AS capture_date FROM lineitem WHERE {QUOTED}
"""
)
def quote_ingest_stream(spark, folder):
    out = work_folder(spark, "quotes")
    land_text(texts.quotes(spark, folder).withColumnRenamed("payload", "value"), f"{out}/landed")
    ingest.append_stream(
        stream_payload(spark, "quote", f"{out}/landed"), normalise.price_rows, f"{out}/prices", f"{out}/checkpoint",
        unit="year",
    ).awaitTermination()
    rows = spark.read.parquet(f"{out}/prices")
    return plain(rows.select("company_id", "diet_calories_id", "total_cost", F.to_date("capture_date").alias("capture_date")))


@check(
    """
SELECT company_id, diet_calories_id, codes, count(*) AS n FROM price_series GROUP BY ALL
"""
)
def redelivery_stream(spark, folder):
    """Every capture delivered twice is kept once."""
    twice = stream(spark, folder, "events").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    once = ingest.without_redelivery(price_series(twice), ["company_id", "diet_calories_id", "promo_codes"], delay="40 days")
    out = work_folder(spark, "redelivery")
    once.writeStream.format("parquet").option("path", f"{out}/rows").option(
        "checkpointLocation", f"{out}/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return plain(
        rows.groupBy("company_id", "diet_calories_id", F.array_join("promo_codes", ",").alias("codes")).agg(
            F.count("*").alias("n")
        )
    )
