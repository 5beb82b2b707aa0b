"""Errors as data: a nullable struct, never an exception inside a job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR_SQL = "struct<status:int,code:string,detail:string>"

# Error codes and messages of the service contract.
EXTRACTION_FAILED = "document_extraction_failed"
MODEL_ERROR = "ollama_service_error"
INVALID_REQUEST = "invalid_request"
TEXT_TOO_SHORT = "Extracted document text is insufficient"
TEXT_TOO_LONG = "Compacted invoice text exceeds the configured input-token ceiling"
NO_READABLE_TEXT = "PaddleOCR returned no readable text"
INVALID_INVOICE_ID = "invoice_id must contain between 1 and 100 characters"


def error(status: int | Column, code: str | Column, detail: str | Column) -> Column:
    def as_column(value):
        return value if isinstance(value, Column) else F.lit(value)

    return F.struct(
        as_column(status).cast("int").alias("status"),
        as_column(code).alias("code"),
        as_column(detail).alias("detail"),
    )


def no_error() -> Column:
    return F.lit(None).cast(ERROR_SQL)


def error_source(code: Column, status: Column) -> Column:
    return (
        F.when(code.startswith("ollama_"), F.lit("ollama"))
        .when(code.startswith("ocr_") | code.startswith("document_extraction"), F.lit("ocr"))
        .when((status >= 400) & (status < 500), F.lit("client"))
        .otherwise(F.lit("server"))
    )


def is_retryable(status: Column) -> Column:
    return status.isin(429, 502, 503, 504)


def validation_detail(problems: Column) -> Column:
    """``a.b: message; c: message`` from an array of (loc array, msg) structs."""
    texts = F.transform(
        problems, lambda p: F.concat(F.array_join(p["loc"], "."), F.lit(": "), p["msg"])
    )
    return F.when(F.size(problems) > 0, F.array_join(texts, "; ")).otherwise(
        F.lit("The request is invalid")
    )
