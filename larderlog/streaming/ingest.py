"""Streams into observation tables and into folded state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.dates import bucket
from ..sources.buckets import BucketedState
from ..sources.payloads import split_rejects
from ..sources.sinks import read_state, write_state


def append_stream(
    payloads: DataFrame,
    normalise: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    unit: str = "day",
    rejects: str | None = None,
) -> StreamingQuery:
    """Normalise landed payloads and append them by capture date, then stop.

    ``capture_date`` is the first day of the capture's ``unit``: a backfill over
    years is better partitioned by month or year than into thousands of small
    folders.  Unreadable payloads go to ``rejects`` (``path`` with ``-rejects``)
    with their raw text.  Both are partitioned by micro-batch too, and a batch
    that is run again replaces its own partitions, so every file counts once.
    """
    def write(rows: DataFrame, to: str, batch_id: int, *by: str) -> None:
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(*by, "batch_id").parquet(to)

    def step(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_rejects(batch)
        rows = normalise(good).withColumn("capture_date", F.to_date(bucket("captured_at", unit)))
        # One well-sized set of files per date, whatever the number of tasks.
        write(rows.hint("rebalance", "capture_date"), path, batch_id, "capture_date")
        write(bad, rejects or f"{path.rstrip('/')}-rejects", batch_id)

    return (
        payloads.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def fold_stream(
    rows: DataFrame,
    fold: Callable[[DataFrame, DataFrame], DataFrame],
    schema,
    state: str,
    checkpoint: str,
) -> StreamingQuery:
    """Fold every micro-batch into a versioned state table.

    Batch ``n`` reads the newest version below ``n`` and writes version ``n``,
    so a batch that is run again after a failure gives the same state.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        current = read_state(batch.sparkSession, state, schema, before=batch_id)
        write_state(fold(current, batch), state, batch_id)

    return (
        rows.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def bucketed_fold_stream(
    rows: DataFrame,
    fold: Callable[[DataFrame, DataFrame], DataFrame],
    state: BucketedState,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch,
) -> StreamingQuery:
    """Fold every micro-batch into a bucketed state; a batch costs the buckets it touches.

    ``prepare`` normalises a batch before its keys are hashed.  A batch that is
    run again after a failure gives the same version.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        state.fold(prepare(batch), fold, batch_id)

    return (
        rows.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def without_redelivery(rows: DataFrame, keys: list[str], at: str = "captured_at", delay: str = "2 days") -> DataFrame:
    """Drop observations delivered again within the watermark delay."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark([*keys, at])
