"""Compacted texts within the limits, ready for the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.errors import (
    EXTRACTION_FAILED,
    TEXT_TOO_LONG,
    TEXT_TOO_SHORT,
    error,
)
from ledgerloom.functions.text import compact, token_estimate
from ledgerloom.limits import DEFAULT, Limits
from ledgerloom.operators.pages import compacted_document_text
from ledgerloom.operators.settle import settle


def text_error(length: Column, limits: Limits = DEFAULT) -> Column:
    """Error of a compacted text by its length, null when it is usable."""
    too_short = length < limits.min_text_chars
    too_long = token_estimate(length) > limits.max_input_tokens
    return F.when(too_short, error(422, EXTRACTION_FAILED, TEXT_TOO_SHORT)).when(
        too_long, error(422, EXTRACTION_FAILED, TEXT_TOO_LONG)
    )


def _limited(documents: DataFrame, limits: Limits) -> DataFrame:
    """Replaces ``_compacted`` by the stored text and its facts, or an error."""
    length = F.length("_compacted")
    failure = text_error(length, limits)
    if "error" in documents.columns:
        failure = F.coalesce(F.col("error"), failure)
    ok = F.col("error").isNull()
    checked = documents.withColumns({"error": failure, "_length": length})
    return checked.withColumns(
        {
            "character_stored": F.when(ok, F.col("_compacted")),
            "character_count": F.when(ok, F.col("_length")),
            "estimated_tokens": F.when(ok, token_estimate(F.col("_length"))),
        }
    ).drop("_compacted", "_length")


def prepare_texts(documents: DataFrame, text: str = "text",
                  limits: Limits = DEFAULT) -> DataFrame:
    """Compacts whole document texts."""
    compacted = documents.withColumn("_compacted", compact(F.col(text)))
    return _limited(settle(compacted, "_compacted"), limits)


def prepare_pages(doc_pages: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Page texts to ``prepared_text`` in one shuffle."""
    documents = compacted_document_text(doc_pages, limits)
    return _limited(documents.withColumnRenamed("text", "_compacted"), limits)
