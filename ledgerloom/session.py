"""Session helpers shared by batch and streaming jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the jobs rely on. All are runtime settings, so they can be applied
# to a session somebody else created.
_RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A shuffle starts with 200 partitions, whatever the session's own number, and small ones are
    # joined up to this size, so what a task sorts stays bounded. Beyond 200, writers sort, too.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "200",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(16 << 20),
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join is split even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # What a Python task holds at once: rows of files or long texts travel in small batches.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    # Many small files share a task; the default counts each as 4 MB.
    "spark.sql.files.openCostInBytes": str(64 << 10),
    # Repeated JSON keys keep the last value, as in Python.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


# Folders of local sessions that name none, by application.
_LOCAL_ROOTS: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in _RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and cut points of the lineage.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, where
    driver and executors share one machine, may fall back to a new folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is not None:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[application] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_ROOTS[application]


def new_work_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
