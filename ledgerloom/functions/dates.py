"""Validity and normalisation of date texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_iso_date(column: Column) -> Column:
    """True for ``2026-01-15``, ``20260115`` and ISO weeks such as ``2026-W03-1``.

    Null counts as not valid. Years run from 0001 to 9999.
    """
    year = F.substring(column, 1, 4)
    year_ok = year != "0000"
    calendar = (
        F.when(column.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(column, "yyyy-MM-dd"))
        .when(column.rlike(r"\A[0-9]{8}\z"), F.try_to_date(column, "yyyyMMdd"))
        .isNotNull()
    )

    week_shape = r"\A[0-9]{4}(?:-W[0-9]{2}(?:-[1-7])?|W[0-9]{2}[1-7]?)\z"
    week = F.regexp_extract(column, r"W([0-9]{2})", 1).try_cast("int")
    weekday = F.coalesce(
        F.nullif(F.regexp_extract(column, r"W[0-9]{2}-?([1-7])\z", 1), F.lit("")).try_cast("int"),
        F.lit(1),
    )
    # 28 December always lies in the last ISO week of its year.
    last_week = F.weekofyear(F.try_to_date(F.concat(year, F.lit("-12-28")), "yyyy-MM-dd"))
    inside_range = ~((year == "9999") & (week == 52) & (weekday > 5))
    iso_week = column.rlike(week_shape) & week.between(1, last_week) & inside_range

    return F.coalesce(year_ok & (calendar | iso_week), F.lit(False))


# Date spellings that are rewritten as YYYY-MM-DD.
PRINTED_DATE_FORMATS = [
    "yyyy-MM-dd",
    "dd-MM-yyyy",
    "dd/MM/yyyy",
    "dd.MM.yyyy",
    "MMMM d, yyyy",
    "d MMMM yyyy",
    "d. MMMM yyyy",
    "d-MMM-yyyy",
]
# What a text of each part of a spelling looks like at most.
_PART_SHAPES = {"y": r"[+]?[0-9]+", "M": r"[\p{L}0-9.]+", "d": r"[0-9]+"}


def _shape(spelling: str) -> str:
    """A pattern that every text of the spelling matches."""
    parts = re.findall(r"y+|M+|d+|[^yMd]", spelling)
    return r"\A" + "".join(_PART_SHAPES.get(p[0], re.escape(p)) for p in parts) + r"\z"


def normalise_printed_date(column: Column) -> Column:
    """A printed date as YYYY-MM-DD, null when no spelling fits.

    Only spellings whose shape fits are tried: each failing try costs an
    exception, far more than a pattern.
    """
    parsed = F.coalesce(
        *[F.when(column.rlike(_shape(f)), F.try_to_date(column, f)) for f in PRINTED_DATE_FORMATS]
    )
    return F.date_format(parsed, "yyyy-MM-dd")
