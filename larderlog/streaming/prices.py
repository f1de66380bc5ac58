"""Daily cheapest prices and price changes over a stream of quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.keyed import top_rows
from ..operators.sequence import strictly_earlier
from ..plans.pricing import QUOTED
from ..schemas import table
from ..sources.sinks import read_state, write_state

COMBO = ["city_id", "company_id", "diet_calories_id", "tier_diet_option_id", "order_days"]
CHANGE_STATE = [*QUOTED, "captured_at", "id", "per_day_cost_with_discounts"]


def daily_cheapest(quotes: DataFrame, delay: str = "2 days") -> DataFrame:
    """Tumbling day window per combo: lowest total, latest capture among equals.

    Rows later than the watermark are dropped; the batch form takes any lateness.
    """
    rank = F.struct(
        F.col("total_cost").isNull().alias("n"),
        F.col("total_cost").alias("t"),
        (-F.unix_micros("captured_at")).alias("c"),
        (-F.col("id")).alias("i"),
    )
    return (
        quotes.withWatermark("captured_at", delay)
        .groupBy(F.window("captured_at", "1 day"), *COMBO)
        .agg(F.min_by(F.struct("total_cost", "captured_at", "id", "promo_codes"), rank).alias("best"))
        .select(F.col("window.start").alias("day"), *COMBO, "best.*")
    )


def write_updates(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write every changed result row with its batch number; ``read_updates`` keeps the last."""
    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        rows.writeStream.outputMode("update")
        .foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_updates(spark, path: str, keys: list[str]) -> DataFrame:
    return top_rows(spark.read.parquet(path), keys, [F.desc("batch_id")]).drop("batch_id")


def change_stream(
    quotes: DataFrame, events: str, state: str, checkpoint: str, lateness: str = "2 days", unit: str = "day"
) -> StreamingQuery:
    """Price changes as they arrive; ``read_changes`` of ``events`` equals the batch query.

    The state holds, per combo, all captures within ``lateness`` of its newest
    one and the instant before them.  A capture that slips in between two others
    gives out its successor once more, also as "no change any more".  Captures
    older than that are written to ``events`` with ``-late`` and change nothing.
    Batches are idempotent: versions and event folders carry the batch number.
    """
    fields = {f.name: f for f in table("prices").fields}
    schema = type(table("prices"))([fields[c] for c in CHANGE_STATE])
    value, at = "per_day_cost_with_discounts", F.col("captured_at")
    late_path = f"{events.rstrip('/')}-late"

    def step(batch: DataFrame, batch_id: int) -> None:
        stored = read_state(batch.sparkSession, state, schema, before=batch_id).withColumn("_new", F.lit(False))
        new = batch.select(*CHANGE_STATE).dropna(subset=[*QUOTED, "captured_at"]).withColumn("_new", F.lit(True))
        newest = stored.groupBy(*QUOTED).agg((F.max("captured_at") - F.expr(f"INTERVAL {lateness}")).alias("_floor"))
        new = new.join(newest, QUOTED, "left")
        is_late = F.coalesce(at < F.col("_floor"), F.lit(False))
        new.where(is_late).select(*CHANGE_STATE).write.mode("overwrite").parquet(f"{late_path}/batch_id={batch_id}")
        new = new.where(~is_late).drop("_floor")

        both = stored.unionByName(new)
        seen = strictly_earlier(both, QUOTED, "captured_at", "id", [value], "_before", unit)
        touched = new.groupBy(*QUOTED).agg(F.min("captured_at").alias("_first"))
        before = F.col("_before")[value]
        changed = F.col("_before").isNotNull() & ~F.col(value).eqNullSafe(before)
        told = seen.join(touched, QUOTED).withColumn("changed", changed)
        told = told.where(F.when(F.col("_new"), F.col("changed")).otherwise(at > F.col("_first")))
        told.select(
            *CHANGE_STATE, before.alias("prev_per_day"), (F.col(value) - before).alias("delta"), "changed"
        ).write.mode("overwrite").parquet(f"{events}/batch_id={batch_id}")

        floors = both.groupBy(*QUOTED).agg((F.max("captured_at") - F.expr(f"INTERVAL {lateness}")).alias("_floor"))
        kept = both.join(floors, QUOTED)
        older = top_rows(kept.where(at < F.col("_floor")), QUOTED, [F.desc("captured_at"), F.desc("id")])
        kept = kept.where(at >= F.col("_floor")).unionByName(older).select(*CHANGE_STATE)
        write_state(kept, state, batch_id)

    return (
        quotes.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_changes(spark, events: str) -> DataFrame:
    """The changes that stand after all batches."""
    last = read_updates(spark, events, [*QUOTED, "captured_at", "id"])
    return last.where("changed").drop("changed")
