"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from evwarden.queries import ORACLES, QUERIES
from tools_compare import TABLES, compare


@pytest.fixture(scope="module")
def con(sf):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    text, same = compare(spark, con, sf, name)
    assert same, text


def test_entry(spark):
    assert entry.entry(spark).columns == ["start_id", "end_id", "value"]


def test_plans_reach_the_scan(spark, sf):
    """The type filter is pushed to Parquet and only the named columns are read."""
    plan = entry.queries()["seq_neg_full"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "In(event_type, [error,purchase,signup])" in plan
    schema = plan[plan.index("ReadSchema") :].splitlines()[0]
    assert "props" not in schema
    assert plan.count("Exchange") == 1
