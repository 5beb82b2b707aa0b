"""Costly columns computed once per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(rows: DataFrame, *columns: str) -> DataFrame:
    """The same rows; filters on ``columns`` stay above their computation.

    The optimizer moves a filter below the projection it reads, which computes
    the column a second time inside the filter, and again for every column
    that one is built from. It does not move filters below a generator, so the
    columns pass through one that yields exactly one row per row.
    """
    others = [c for c in rows.columns if c not in columns]
    return rows.select(*others, F.inline_outer(F.array(F.struct(*columns)))).select(*rows.columns)
