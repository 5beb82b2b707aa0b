"""Every registered query against its SQL oracle on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from ledgerloom.plans.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    return value


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    frame = entry_point.queries()[name](spark, SF_DIR)
    found = ordered(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = duck.execute(entry_point.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert {n: TYPES[t] for n, t in frame.dtypes} == {c[0]: str(c[1]) for c in cursor.description}
    assert found == ordered(columns, cursor.fetchall())
    assert found


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(QUERIES) <= set(entry_point.oracle_sql()) <= set(entry_point.queries())


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["batch_status", "batch_lookup", "india_reconcile", "uae_validate", "processing_snapshot",
                                  "completion_join", "ocr_layout", "label_fields_uae", "prepared_text"])
def test_plans_hold_no_product_of_rows(spark, name):
    plan = plan_of(entry_point.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_one_shuffle_prepares_texts(spark):
    plan = plan_of(entry_point.queries()["prepared_text"](spark, SF_DIR))
    assert plan.count("Exchange hashpartitioning") == 1


def test_scans_read_needed_columns_only(spark):
    plan = plan_of(entry_point.queries()["clean_money_texts"](spark, SF_DIR))
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
