"""Nested lists as tables, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.errors import INVALID_REQUEST, error, no_error
from ledgerloom.operators.groups import split_by_size


def flatten(invoices: DataFrame, key: str, rows: str, keep_empty: bool = True) -> DataFrame:
    """One row per list element with its 1-based position.

    ``keep_empty`` keeps invoices without elements as one row of nulls.
    """
    explode = F.posexplode_outer if keep_empty else F.posexplode
    exploded = invoices.select(key, explode(rows).alias("_pos", "_row"))
    return exploded.select(key, (F.col("_pos") + 1).alias("position"), "_row.*")


def nest(items: DataFrame, key: str, rows: str, max_items: int) -> DataFrame:
    """One row per key: its list in the order of ``position``, ``n_items`` and ``error``.

    A list becomes a single value. A key with more than ``max_items`` elements
    has no list but an error with its true count; its elements never meet.
    """
    fields = [c for c in items.columns if c not in (key, "position")]
    small, large = split_by_size(items, [key], max_items)
    gathered = small.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("position", *fields))).alias("_rows")
    )
    ordered = F.transform("_rows", lambda r: F.struct(*[r[f].alias(f) for f in fields]))
    nested = gathered.select(
        key,
        F.size("_rows").cast("bigint").alias("n_items"),
        ordered.alias(rows),
        no_error().alias("error"),
    )
    detail = F.concat(
        F.lit(f"List has more than {max_items} elements: "), F.col("n_rows").cast("string")
    )
    rejected = large.select(
        key,
        F.col("n_rows").alias("n_items"),
        F.lit(None).cast(nested.schema[rows].dataType).alias(rows),
        error(413, INVALID_REQUEST, detail).alias("error"),
    )
    return nested.unionByName(rejected)
