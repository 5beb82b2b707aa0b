"""Positions and running sums over groups of any size.

No task holds a whole group: rows lie in range partitions, each partition is
summed on its own, and what lies before it comes from one total per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import new_work_path


def in_ranges(rows: DataFrame, columns: list, purpose: str = "ranges") -> DataFrame:
    """``rows`` in range partitions by ``columns``, as a written table.

    ``_part`` is the number of the range; ``_tie`` orders equal rows, so even
    a single value that fills the table is split.
    """
    spark = rows.sparkSession
    path = new_work_path(spark, purpose)
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*columns, "_tie")
    ranged = ranged.withColumn("_part", F.spark_partition_id())
    ranged.write.parquet(path)
    return spark.read.schema(ranged.schema).parquet(path)


def _before_range(totals: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Per range and key, the sums of all earlier ranges; ranges with nothing before them are left out."""
    if keys:
        earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        sums = totals.select("_part", *keys, *[F.sum(n).over(earlier).alias(n) for n in names])
        return sums.filter(F.coalesce(*[F.col(n) for n in names]).isNotNull())
    # One entry per range: as many as the job has partitions.
    entries = totals.agg(F.sort_array(F.collect_list(F.struct("_part", *names))).alias("_all"))
    own = entries.select("_all", F.posexplode("_all").alias("_at", "_own")).filter("_at > 0")

    def sum_before(name: str) -> Column:
        kind = totals.schema[name].dataType
        add = lambda total, entry: (total + entry[name]).cast(kind)
        return F.aggregate(F.slice("_all", 1, F.col("_at")), F.lit(0).cast(kind), add).alias(name)

    return own.select(F.col("_own._part").alias("_part"), *[sum_before(n) for n in names])


def running(rows: DataFrame, keys: list[str], order: list, sums: dict[str, Column],
            purpose: str = "running") -> DataFrame:
    """``rows`` with sums from the first row of their key up to their own.

    ``order`` may hold names and sort expressions; rows that tie follow each
    other in any order. Null keys form a group like any other. Values must not be null.
    """
    names = {n: f"_v{i}" for i, n in enumerate(sums)}
    parted = in_ranges(rows.withColumns({names[n]: v for n, v in sums.items()}), [*keys, *order], purpose)
    totals = parted.groupBy("_part", *keys).agg(*[F.sum(v).alias(v) for v in names.values()])
    before = _before_range(totals, keys, list(names.values()))
    renamed = {c: f"_b{i}" for i, c in enumerate([*keys, "_part", *names.values()])}
    before = before.withColumnsRenamed(renamed)
    here = Window.partitionBy("_part", *keys).orderBy(*order, "_tie")
    here = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = parted.withColumns({f"_l{v}": F.sum(v).over(here) for v in names.values()})
    same = F.lit(True)
    for column in (*keys, "_part"):
        same = same & local[column].eqNullSafe(before[renamed[column]])
    joined = local.join(before, same, "left")
    return joined.select(
        *[F.col(c) for c in rows.columns],
        *[(F.col(f"_l{v}") + F.coalesce(renamed[v], F.lit(0))).alias(n) for n, v in names.items()],
    )


def numbered(rows: DataFrame, keys: list[str], order: list, name: str = "position",
             purpose: str = "numbered") -> DataFrame:
    """``rows`` with their position in their key, from 1."""
    return running(rows, keys, order, {name: F.lit(1).cast("bigint")}, purpose)
