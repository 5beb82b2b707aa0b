"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.session import new_work_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a written table below the shared folder.

    Later reads start from its files, so a lost executor costs no more than the
    tasks it was running.
    """
    spark = df.sparkSession
    path = new_work_path(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def set_aside(docs: DataFrame, reserved: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of a reserved name renamed, and the names to give back."""
    names = {c.lower() for c in docs.columns}
    moved = {}
    for column in docs.columns:
        if column.lower() in {r.lower() for r in reserved}:
            other = f"_aside_{column}"
            while other.lower() in names:
                other = f"_{other}"
            names.add(other.lower())
            moved[column] = other
    return docs.withColumnsRenamed(moved), {other: column for column, other in moved.items()}


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``max_bytes`` each, one row at least."""
    for batch in batches:
        rows = batch.num_rows
        if rows == 0:
            continue
        step = max(1, int(rows * max_bytes / max(1, batch.nbytes)))
        for start in range(0, rows, step):
            yield batch.slice(start, min(step, rows - start))


def quoted(name: str) -> str:
    return "`" + re.sub("`", "``", name) + "`"
