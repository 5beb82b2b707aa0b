"""Identifiers: tax numbers, currencies, request IDs and batch job names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import is_blank, strip

JOB_PREFIX = "batches/"


def is_trn(column: Column) -> Column:
    """Exactly 15 digits of any script around which blanks may stand."""
    return strip(column).rlike(r"\A\p{Nd}{15}\z")


def is_currency(column: Column) -> Column:
    return column.rlike(r"\A[A-Z]{3}\z")


def pan_from_gstin(pan: Column, gstin: Column) -> Column:
    """PAN, taken from characters 3-12 of a 15-character GSTIN when absent."""
    clean = strip(gstin)
    derived = F.upper(F.substring(clean, 3, 10))
    return F.when(is_blank(pan) & (F.length(clean) == 15), derived).otherwise(pan)


def has_safe_shape(column: Column) -> Column:
    return F.coalesce(column.rlike(r"\A[A-Za-z0-9._\-]{1,100}\z"), F.lit(False))


def request_id(column: Column) -> Column:
    """A safe caller ID is kept, any other replaced by a new UUID.

    The UUID changes when the plan runs again: write the result before reuse.
    """
    return F.when(has_safe_shape(column), column).otherwise(F.uuid())


def job_key(column: Column) -> Column:
    """Job name without surrounding blanks and without one leading prefix."""
    return F.regexp_replace(strip(column), rf"\A{JOB_PREFIX}", "")


def requested_job_key(column: Column) -> Column:
    """Key of a requested name. A job answers to its name with and without the
    prefix, and a name that misses is tried once more without its prefix.
    """
    return F.regexp_replace(strip(column), rf"\A({JOB_PREFIX}){{1,2}}", "")


def job_name(submitted_at: Column, payload: Column) -> Column:
    """``batches/loc_<date>_<time>_<8 hex digits>``.

    The digits come from the payload, so a re-run gives the same name.
    """
    return F.concat(
        F.lit(f"{JOB_PREFIX}loc_"),
        F.date_format(submitted_at, "yyyyMMdd_HHmmss"),
        F.lit("_"),
        F.substring(F.sha2(payload, 256), 1, 8),
    )


def is_valid_invoice_id(column: Column) -> Column:
    """1 to 100 characters, both as given and after stripping."""
    raw, clean = F.length(column), F.length(strip(column))
    return F.coalesce(raw.between(1, 100) & clean.between(1, 100), F.lit(False))
