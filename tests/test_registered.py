"""Every registered query against its SQL on the smallest tables."""

import pytest

from workload.check import compare, connect
from workload.oracles import oracle_sql
from workload.queries import REGISTRY

ROWS_ONLY = {
    "anomaly_fitted_trend",
    "forecast_network",
    "forecast_smoothing",
    "forecast_sarima",
    "forecast_fourier_trend",
    "forecast_lag_linear",
    "forecast_lag_forest",
    "forecast_lag_gbt",
    "forecast_auto_order",
}


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql_or_is_known_not_to():
    assert set(REGISTRY) - set(oracle_sql()) == ROWS_ONLY
    assert set(oracle_sql()) <= set(REGISTRY)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, connection, sf_dir, name):
    outcome = compare(spark, connection, name, sf_dir)
    assert not outcome.startswith("FAIL"), outcome


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.queries().keys() >= entry.oracle_sql().keys()
