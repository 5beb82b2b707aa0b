"""Amounts read from free text and from JSON values."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

MONEY = DecimalType(24, 8)
MONEY_SQL = "decimal(24,8)"

# Decimal digits of all scripts, paired with 0-9.
_SCRIPT_DIGITS = "".join(
    chr(p) for p in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(p)) == "Nd"
)
_ASCII_DIGITS = "".join(str(unicodedata.decimal(c)) for c in _SCRIPT_DIGITS)


def clean_money(column: Column) -> Column:
    """Digits, dots and minus signs of a text, read as a number.

    A text that is no number after that gives its first number; a text without
    digits gives null. Parentheses do not negate and ``Rs. 500`` is 0.500.
    """
    ascii_text = F.when(
        column.rlike(r"[^\x00-\x7f]"),
        F.translate(column, _SCRIPT_DIGITS, _ASCII_DIGITS),
    ).otherwise(column)
    kept = F.regexp_replace(ascii_text, r"[^0-9.\-]", "")
    first = F.nullif(F.regexp_extract(kept, r"-?[0-9]+(?:\.[0-9]+)?", 0), F.lit(""))
    return F.coalesce(kept.try_cast(MONEY), first.try_cast(MONEY))


def zero() -> Column:
    return F.lit(0).cast(MONEY)


def sum_of(items: Column, field: str) -> Column:
    """Sum of a money field over an array of structs, nulls skipped."""
    wide = DecimalType(38, 8)
    total = F.aggregate(
        items,
        F.lit(0).cast(wide),
        lambda acc, item: (acc + F.coalesce(item[field], zero())).cast(wide),
    )
    return total.try_cast(MONEY)


def to_json_number(column: Column) -> Column:
    """Money leaves the pipeline as a floating-point number."""
    return column.cast("double")
