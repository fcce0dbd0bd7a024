"""Each query with an SQL twin gives the same rows in DuckDB (smallest tables),
and every other one runs."""

import duckdb
import pytest

from check_oracle import TABLES, compare
from conftest import SF
from telluria.checks import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    report = compare(spark, con, SF, name, QUERIES[name], SQL[name])
    assert report.startswith("OK"), report


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_a_twin_runs(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows
