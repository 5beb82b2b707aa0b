"""Groups that may be gathered, told apart from those that are too large."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_by_size(rows: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """All rows of the groups with up to ``limit`` rows, and the larger groups.

    The second table holds the keys with ``n_rows``, the true count. Only partial
    counts are shuffled to find them, and a large group leaves as a whole before
    anything is gathered. Null keys form a group like any other.
    """
    large = (
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > limit)
    )
    names = {k: f"_large_{k}" for k in keys}
    other = large.select(*[F.col(k).alias(n) for k, n in names.items()])
    same = F.lit(True)
    for key, name in names.items():
        same = same & rows[key].eqNullSafe(other[name])
    return rows.join(other, same, "left_anti"), large
