import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from spendframe import build_session  # noqa: E402
from helpers import days_from, months_from  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("spendframe-tests", master="local[4]", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def series(spark):
    """A one-series table from dates and values."""

    def build(dates, values, **extra):
        rows = list(zip(dates, map(float, values), *extra.values()))
        types = "".join(f", {name} string" for name in extra)
        return spark.createDataFrame(rows, f"PeriodStart date, Cost double{types}")

    return build


@pytest.fixture
def flat_ten(series):
    return series(days_from("2025-01-01", 10), [100] * 10)


@pytest.fixture
def daily_30(series):
    return series(days_from("2025-01-01", 30), [10 + 2 * i for i in range(30)])


@pytest.fixture
def monthly_30(series):
    return series(months_from("2024-01-01", 30), [100 + 10 * i for i in range(30)])
