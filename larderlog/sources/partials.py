"""Views over appended observations, kept as mergeable partial results per capture date.

A partial holds, of the rows that one batch brought for one capture date, the
best row per key.  "Best" is the first in a total order, so partials merge in any
order and any number of times: a view over the whole history is the best of the
partials' rows.  Appending reads only the batch; a capture that comes late adds a
partial to its old date; a batch that is run again replaces its own partials::

    capture_date=<d>/batch_id=<n>/

The days of many batches roll up into coarser partials (months, say), so a view
reads a few large ones and the batches since.  As merging twice changes nothing, a roll-up needs no
lock: what it has merged may be read beside it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import bucket
from ..operators.keyed import dealt, top_rows


@dataclass(frozen=True)
class BestRows:
    """The first row per key in ``order``, of all rows ever added.

    ``order`` must be total within a key.  ``unit`` is the length of time that
    shares a partial: results are the same for any.
    """

    spark: SparkSession
    root: str
    schema: T.StructType
    keys: Sequence[Column | str]
    order: Sequence[Column]
    at: str = "captured_at"
    unit: str = "day"

    def best(self, rows: DataFrame) -> DataFrame:
        """At most one row per key and map task is shuffled."""
        return top_rows(rows, self.keys, self.order)

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Write the partials of a batch; its rows without a capture time go to a partition of their own.

        Rows are shuffled once, for the choice per key and for the files; of crowded keys at most one row per key and map task.
        """
        dated = rows.select(*self.schema.fieldNames()).withColumn("capture_date", F.to_date(bucket(self.at, self.unit)))
        keys = ["capture_date", *self.keys]
        spread = dealt(dated, ["capture_date"], keys, lambda some: top_rows(some, keys, self.order))
        self._write(top_rows(spread, ["_part", *keys], self.order).drop("_part"), batch_id)

    def _write(self, partials: DataFrame, batch_id: int) -> None:
        (
            partials.withColumn("batch_id", F.lit(batch_id).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "zstd")
            .partitionBy("capture_date", "batch_id")
            .parquet(self.root)
        )

    def partials(self) -> DataFrame:
        """All partial rows with their date and batch; empty without any."""
        full = T.StructType([*self.schema.fields, T.StructField("capture_date", T.DateType()), T.StructField("batch_id", T.LongType())])
        try:
            return self.spark.read.schema(full).parquet(self.root)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], full)
            raise

    def roll_up(self, coarse: BestRows, after: int, through: int) -> None:
        """Add the partials of the batches after ``after`` and up to ``through`` to a coarser table."""
        rows = self.partials().where((F.col("batch_id") > after) & (F.col("batch_id") <= through))
        coarse.add(rows, through)

    def view(self, until=None, rolled: BestRows | None = None, through: int = -1) -> DataFrame:
        """Best row per key over the whole history, or over the capture dates up to ``until``.

        Dates are partitions, so an earlier instant reads only its own past.
        With ``rolled``, the roll-up of the batches up to ``through``, only later batches are read here.
        """
        rows = self.partials()
        if rolled is not None:
            rows = rows.where(F.col("batch_id") > through).unionByName(rolled.partials())
        if until is not None:
            if rolled is not None:  # a coarser partial has lost what stood before its last rows
                raise ValueError("an earlier instant is answered by the finer partials alone")
            rows = rows.where(F.col("capture_date") <= F.lit(until).cast("date"))
        return self.best(rows).select(*self.schema.fieldNames())
