"""Every registered query against its DuckDB oracle (the driver's correctness gate)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import TABLES, compare  # noqa: E402

SF = os.environ.get("GRIDCUBE_TEST_SF", "/root/testdata/sf0.001")
ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["S", "M", "L", "Y", "X", "target", "tas", "prcp"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = con.execute(ORACLE[name]).df()
    assert compare(got, want).startswith("ok"), compare(got, want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


@pytest.mark.parametrize("name", ["standardize", "cf_time", "add_target_daily", "error_rate_gate",
                                  "convert_calendar", "month_abbrev", "read_cube"])
def test_results_do_not_depend_on_session_time_zone(spark, con, name):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = QUERIES[name](spark, SF).toPandas()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    want = con.execute(ORACLE[name]).df()
    assert compare(got, want).startswith("ok"), compare(got, want)
