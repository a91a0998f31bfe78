"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest

from tests.conftest import SF
from oddsloom.plans import all_oracles, all_queries
from oddsloom.views import RAW_TABLES
from tools.compare import norm

QUERIES, ORACLES = all_queries(), all_oracles()
# fits of many models: run with the full comparison tool, not on every test run
SLOW = {"classifier_grid", "season_purged_backtest", "production_fit_comparison", "learning_leak_test", "w_xi_grid"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got = norm(QUERIES[name](spark, SF).toPandas())
    want = norm(duck.execute(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert got.equals(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
