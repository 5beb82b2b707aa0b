"""Positions and running sums against plain loops."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.scans import numbered, running

ROWS = "key string, at long, value long"


def drawn(n, hot):
    rng = random.Random(n)
    keys = ["a"] * hot + [None, "b", "c"]
    return [(rng.choice(keys), rng.choice([None, *range(n // 3 + 1)]), rng.randint(-5, 5)) for _ in range(n)]


@pytest.mark.parametrize(("n", "hot"), [(0, 1), (1, 1), (300, 1), (300, 30)])
def test_numbers_run_through_each_key(spark, n, hot):
    rows = drawn(n, hot)
    got = numbered(spark.createDataFrame(rows, ROWS).repartition(7), ["key"], ["at", "value"]).collect()
    first = lambda r: (r[0] is not None, r[0] or "")
    within = lambda r: (r[1] is not None, r[1] or 0, r[2])
    want = []
    for key, own in groupby(sorted(rows, key=first), key=lambda r: r[0]):
        want += [(key, at, value, k) for k, (_, at, value) in enumerate(sorted(own, key=within), 1)]
    assert sorted(map(tuple, got), key=lambda r: (first(r), r[3])) == sorted(want, key=lambda r: (first(r), r[3]))


def test_sums_without_a_key_have_no_window_over_all_rows(spark):
    rows = [(k, k % 7 - 3) for k in range(1000)]
    frame = spark.createDataFrame(rows, "at long, value long").repartition(9)
    summed = running(frame, [], ["at"], {"total": F.col("value"), "n": F.lit(1).cast("long")})
    total, want = 0, []
    for at, value in rows:
        total += value
        want.append((at, value, total, at + 1))
    assert sorted(map(tuple, summed.collect())) == want
    plan = summed._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan
    for line in plan.splitlines():
        assert "Window [" not in line or "_part" in line


def test_one_value_in_all_rows_is_split(spark):
    frame = spark.range(5000).select(F.lit("x").alias("key"), F.lit(1).cast("long").alias("at")).repartition(8)
    got = numbered(frame, ["key"], ["at"])
    assert sorted(r.position for r in got.collect()) == list(range(1, 5001))
