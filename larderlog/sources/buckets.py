"""State in key-hash buckets: a fold reads and writes only the buckets its batch touches.

Layout under the root::

    data/bucket=<b>/slot=<s>/   rows of one bucket, as some version wrote them
    manifest/slot=<m>/          of one version: its buckets with slot, rows and number of rewrites

A version is the set of (bucket, slot) its manifest names.  A bucket that a
batch touches goes to its next slot, every other one is carried over by the
manifest alone.  Slots form a ring of ``keep`` + 1 places per bucket, and so do the
manifests: Spark's own partition overwrite removes what is superseded, so at
most that many versions of a bucket stay on disk, and each of the last ``keep``
versions can be read.

A version counts once its manifest is there, which is written last.  A batch
that is run again starts from the same older version and writes the same slots, so it
gives the same state.  There is one writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "version BIGINT, seq BIGINT, bucket INT, bucket_slot INT, bucket_rows BIGINT, rewrites BIGINT"
WRITTEN = "_version"


@dataclass(frozen=True)
class Entry:
    """Where a version has the rows of one bucket."""

    slot: int
    rows: int
    rewrites: int


@dataclass(frozen=True)
class Manifest:
    """One version: its place in the order of versions and its buckets."""

    version: int
    seq: int
    entries: dict[int, Entry]


NOTHING = Manifest(-1, 0, {})


@dataclass(frozen=True)
class BucketedState:
    """A state table dealt by the hash of its ``by`` columns, all of which belong to its key.

    The number of buckets is part of the layout: a state keeps the one it was begun with.
    """

    spark: SparkSession
    root: str
    schema: T.StructType
    by: Sequence[str]
    buckets: int = 64
    keep: int = 3

    def _path(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    def bucket_of(self) -> Column:
        """Bucket of a row; columns are cast first, so a batch lands where the state is."""
        keys = [F.col(c).cast(self.schema[c].dataType) for c in self.by]
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def _manifests(self) -> list[Manifest]:
        """Newest last; at most ``keep`` + 1 of ``buckets`` rows each."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(self._path("manifest", "slot=*")).collect()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        found: dict[int, Manifest] = {}
        for r in rows:
            own = found.setdefault(r["version"], Manifest(r["version"], r["seq"], {}))
            if r["bucket"] is not None:  # an empty state has a manifest too
                own.entries[r["bucket"]] = Entry(r["bucket_slot"], r["bucket_rows"], r["rewrites"])
        return [found[v] for v in sorted(found)]

    def versions(self) -> list[int]:
        """The versions that can be read, oldest first."""
        return [m.version for m in self._manifests()[-self.keep:]]

    def _newest(self, before: int | None) -> Manifest:
        known = self._manifests()
        older = [m for m in known[-self.keep:] if before is None or m.version < before]
        if older:
            return older[-1]
        if known and known[0].seq > 1:
            raise ValueError(f"no version before {before} is kept any more")
        return NOTHING

    def _rows(self, entries: dict[int, Entry]) -> DataFrame:
        paths = [self._path("data", f"bucket={b}", f"slot={e.slot}") for b, e in sorted(entries.items()) if e.rows]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, before: int | None = None) -> DataFrame:
        """The newest version (older than ``before``, if given); empty without any."""
        return self._rows(self._newest(before).entries)

    def fold(self, batch: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], version: int) -> list[int]:
        """Write ``version`` = the newest older version with ``batch`` folded in; gives the buckets it touched.

        ``step(current, batch)`` gets the rows of the touched buckets and
        returns their next rows; it may not change ``by`` columns.
        """
        before = self._newest(version)
        entries = dict(before.entries)
        marked = batch.withColumn("_bucket", self.bucket_of()).persist()
        try:
            touched = sorted(r["_bucket"] for r in marked.select("_bucket").distinct().collect())
            if touched:
                current = self._rows({b: e for b, e in entries.items() if b in touched})
                entries |= self._write(step(current, marked.drop("_bucket")), touched, entries, version)
        finally:
            marked.unpersist()
        self._note(Manifest(version, before.seq + 1, entries))
        return touched

    def _write(self, rows: DataFrame, touched: list[int], before: dict[int, Entry], version: int) -> dict[int, Entry]:
        rewrites = {b: before[b].rewrites + 1 if b in before else 1 for b in touched}
        slots = {b: n % (self.keep + 1) for b, n in rewrites.items()}
        place = F.create_map(*[F.lit(x) for pair in slots.items() for x in pair])
        strayed = F.raise_error(F.lit(f"the fold changed a column of {list(self.by)}")).cast("int")
        named = rows.select(*self.schema.fieldNames()).withColumn("bucket", self.bucket_of())
        named = named.withColumn("slot", F.coalesce(place[F.col("bucket")], strayed)).withColumn(WRITTEN, F.lit(version))
        # A bucket with most of the rows is split, small ones are merged into a file each.
        (
            named.hint("rebalance", "bucket")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket", "slot")
            .parquet(self._path("data"))
        )
        # A bucket without rows any more was not written, and its slot may hold an older version.
        there = self.spark.read.schema(f"bucket INT, slot INT, {WRITTEN} BIGINT").parquet(self._path("data"))
        there = there.where(F.col("bucket").isin(touched) & (F.col("slot") == place[F.col("bucket")]) & (F.col(WRITTEN) == version))
        counts = {r["bucket"]: r["n"] for r in there.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {b: Entry(slots[b], counts.get(b, 0), rewrites[b]) for b in touched}

    def _note(self, manifest: Manifest) -> None:
        head = (manifest.version, manifest.seq)
        rows = [(*head, b, e.slot, e.rows, e.rewrites) for b, e in sorted(manifest.entries.items())]
        note = self.spark.createDataFrame(rows or [(*head, None, None, None, None)], MANIFEST).coalesce(1)
        note.write.mode("overwrite").parquet(self._path("manifest", f"slot={manifest.seq % (self.keep + 1)}"))
