"""Writers of result tables."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(rows: DataFrame, path: str, partition_by: tuple[str, ...] = (),
                mode: str = "append") -> None:
    """Parquet, for tables that later stages restart from."""
    rows.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_json(rows: DataFrame, path: str, partition_by: tuple[str, ...] = (),
               mode: str = "append") -> None:
    """JSON lines with explicit nulls, as callers receive them."""
    rows.write.mode(mode).option("ignoreNullFields", False).partitionBy(*partition_by).json(path)


def _mounted(spark: SparkSession, path: str) -> str | None:
    """``path`` as tasks may open it, or null if only Spark's file systems reach it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.makeQualified(folder).toUri().getPath() if files.getUri().getScheme() == "file" else None


def _saving(root: str, key: str):
    """Writes ``(name, content)`` rows below ``root``, in a folder per task that shows when all its files are written."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        whole = f"{root}/part-{task.partitionId():05d}"
        # Readers pass over names with an underscore.
        own = f"{root}/_part-{task.partitionId():05d}-{task.taskAttemptId()}"
        made = 0
        for batch in batches:
            os.makedirs(own, exist_ok=True)
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                name = "null" if name is None else quote(name, safe="")
                with open(f"{own}/{made:08d}-{key}={name}", "wb") as file:
                    if value.is_valid:
                        file.write(value.as_buffer())
                    file.write(b"\n")
                made += 1
        if made:
            try:
                os.rename(own, whole)
            except OSError:
                # Another attempt was first.
                if not os.path.isdir(whole):
                    raise
                shutil.rmtree(own)
        yield pa.RecordBatch.from_arrays([pa.array([made])], names=["made"])

    return save


def write_files(rows: DataFrame, path: str, key: str, content: str) -> None:
    """One file per row with ``key=<value>`` in its path, for tools that want files. ``path`` must not exist.

    ``content`` may be text or bytes; a line end follows it. On a mounted folder
    the tasks write the files themselves: a repeated task adds none, one that
    died shows none. Elsewhere Spark's writer makes a folder per file.
    """
    root = _mounted(rows.sparkSession, path)
    if root is None:
        rows.select(key, F.col(content).cast("string").alias("value")).write.partitionBy(key).text(path)
        return
    os.makedirs(root)
    named = rows.select(F.col(key).cast("string"), F.col(content).cast("binary"))
    named.mapInArrow(_saving(root, key), "made long").agg(F.sum("made")).collect()


def split_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows and failed rows. Nothing is raised inside a job."""
    return rows.filter(F.col("error").isNull()), rows.filter(F.col("error").isNotNull())


def complete_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished ``batch=n`` folders below ``path``, by its file system's own listing."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")) or []
    return sorted(int(f.getPath().getParent().getName().removeprefix("batch=")) for f in found)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder that a job has written and replaced."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
