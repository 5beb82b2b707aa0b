"""Uploaded files as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.limits import DEFAULT, Limits

# The schema of Spark's binary file source.
_FILE_SQL = "path string, modificationTime timestamp, length bigint, content binary"


def read_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """All files below a folder. Names and extensions play no role."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)


def stream_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """The same table as a stream of newly arriving files."""
    return (
        spark.readStream.format("binaryFile")
        .schema(_FILE_SQL)
        .option("recursiveFileLookup", True)
        .load(folder)
    )


def split_by_size(uploads: DataFrame, limits: Limits = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Files within the size limit, and the oversize ones without content.

    ``length`` is pushed into the scan, so an oversize file is never opened.
    """
    oversize = F.col("length") > limits.max_upload_bytes
    return uploads.filter(~oversize), uploads.filter(oversize).drop("content")
