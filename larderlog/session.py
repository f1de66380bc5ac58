"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Day buckets depend on the time zone; skewed joins and oversized or tiny
# shuffle partitions are left to adaptive execution.  Batches for Python workers
# are bounded by bytes, as one text may be as long as ten thousand others.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8388608",
}

# Used only where the session names no shared folder.
_local_root: list[str] = []


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder in the shared directory named by ``spark.checkpoint.dir``.

    Only in local mode, where all tasks share one machine, a temporary folder
    stands in for an absent setting; on a cluster its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local_root:
            _local_root.append(tempfile.mkdtemp(prefix="larderlog-"))
        root = _local_root[0]
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
