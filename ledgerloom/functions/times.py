"""Durations and timestamps as reported to callers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _micros(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp"))


def elapsed_seconds(start: Column, now: Column) -> Column:
    """Seconds since ``start``, never negative, three decimals."""
    micros = F.greatest(F.lit(0), _micros(now) - _micros(start))
    return F.floor((micros + 500) / 1000) / F.lit(1000.0)


def duration_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds, halves to the even neighbour."""
    micros = (_micros(end) - _micros(start)).cast("decimal(20,0)")
    return F.bround(micros / F.lit(1000).cast("decimal(5,0)"), 0).cast("bigint")


def iso_timestamp(column: Column) -> Column:
    """UTC ISO text; the fraction is left out when it is zero."""
    whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(column, "SSSSSS")
    return F.concat(
        whole,
        F.when(fraction == "000000", F.lit("")).otherwise(F.concat(F.lit("."), fraction)),
        F.lit("+00:00"),
    )
