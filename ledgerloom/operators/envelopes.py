"""Response records: success, completion, preparation and error envelopes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.errors import (
    INVALID_INVOICE_ID,
    error,
    error_source,
    is_retryable,
)
from ledgerloom.functions.identifiers import is_valid_invoice_id
from ledgerloom.functions.money import to_json_number
from ledgerloom.functions.text import strip
from ledgerloom.schemas import COUNTRIES, RecordSchema


def _json_rows(schema: RecordSchema) -> Callable[[Column], Column]:
    return lambda row: json_record(row, schema)


def json_record(record: Column, schema: RecordSchema) -> Column:
    """A record with its money as JSON numbers."""
    fields = []
    for name in schema.order:
        value = record[name]
        if name in schema.lists:
            value = F.transform(value, _json_rows(schema.lists[name]))
        elif name in schema.money:
            value = to_json_number(value)
        fields.append(value.alias(name))
    return F.struct(*fields)


def success_envelopes(invoices: DataFrame, country: str) -> DataFrame:
    """One envelope per invoice without an error.

    Needs ``request_id, character_stored, data, token_usage, total_pages`` and
    for the UAE ``validation``.
    """
    metadata = F.struct(
        F.greatest(F.coalesce("total_pages", F.lit(1)), F.lit(1)).alias("total_pages"),
        F.length("character_stored").alias("character_count"),
        F.lit("stop").alias("finish_reason"),
        F.coalesce("token_usage.model", F.lit("gemma")).alias("model_name"),
        F.lit("ollama").alias("model_provider"),
    )
    usage = F.struct(
        *[
            F.col(f"token_usage.{n}").alias(n)
            for n in (
                "input_tokens",
                "output_tokens",
                "thoughts_tokens",
                "total_tokens",
                "execution_time_ms",
            )
        ]
    )
    columns = [
        "doc_key",
        F.lit(True).alias("success"),
        "request_id",
        "character_stored",
        json_record(F.col("data"), COUNTRIES[country]).alias("data"),
        usage.alias("token_usage"),
    ]
    if country == "uae":
        columns.append("validation")
    return invoices.filter(F.col("error").isNull()).select(*columns, metadata.alias("metadata"))


def completion_envelopes(callers: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Envelopes with the caller's ``invoice_id``, stripped but otherwise unchanged."""
    valid = callers.filter(is_valid_invoice_id(F.col("invoice_id"))).select(
        "doc_key", strip(F.col("invoice_id")).alias("invoice_id")
    )
    return valid.join(envelopes, "doc_key")


def invalid_callers(callers: DataFrame) -> DataFrame:
    return callers.filter(~is_valid_invoice_id(F.col("invoice_id"))).withColumn(
        "error", error(400, "invalid_invoice_id", INVALID_INVOICE_ID)
    )


def preparation_envelopes(prepared: DataFrame) -> DataFrame:
    return prepared.filter(F.col("error").isNull()).select(
        F.lit(True).alias("success"),
        "request_id",
        "character_stored",
        F.greatest("total_pages", F.lit(1)).alias("total_pages"),
        "character_count",
    )


def error_rows(rows: DataFrame) -> DataFrame:
    """Rows of the ``errors`` table from rows with an ``error`` struct.

    Needs ``occurred_at``, ``seq`` and ``request_id``.
    """
    code, status = F.col("error.code"), F.col("error.status")
    unexpected = code == "internal_error"
    return rows.filter(F.col("error").isNotNull()).select(
        "occurred_at",
        "seq",
        "request_id",
        F.when(unexpected, F.lit("api_server")).otherwise(error_source(code, status)).alias("source"),
        code.alias("code"),
        status.alias("http_status"),
        (~unexpected & is_retryable(status)).alias("retryable"),
        F.col("error.detail").alias("detail"),
    )


def error_envelopes(errors: DataFrame) -> DataFrame:
    return errors.select(
        F.lit(False).alias("success"),
        "request_id",
        F.struct("code", "detail", "source", "retryable").alias("error"),
    )
