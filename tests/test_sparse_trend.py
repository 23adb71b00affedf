"""Trends with few bends: optimality, exact zeros, batches, and what they forecast."""

import numpy as np
import pytest
from helpers import NAMES, days_from
from pyspark.sql import functions as F

from spendframe.operators.forecast import ForecastOptions, forecast_rows, models
from spendframe.operators.forecast import sparse_trend as st


def bent(n=500, seed=0, at=250, slope=0.5):
    t = np.arange(n, dtype=float)
    return 100 + 0.1 * t + slope * np.maximum(t - at, 0) + np.random.default_rng(seed).normal(size=n), 19_000 + t


@pytest.mark.parametrize("settings", [st.Settings(), st.Settings(yearly=False), st.Settings(weekly=True, changepoint_scale=0.5), st.Settings(season_scale=np.inf)])
def test_every_bend_obeys_its_condition(settings):
    series = [bent(n, seed=n, at=n // 2) for n in (60, 200, 500, 501)]
    for (v, days), trend in zip(series, st.fit([v for v, _ in series], [d for _, d in series], settings)):
        assert st.worst(v, days, trend, settings) < 1e-6
        assert trend.variance == pytest.approx(np.mean((v - trend.at(days, settings)) ** 2) / trend.scale**2, rel=1e-4)


def test_most_bends_are_zero_and_the_true_one_is_found():
    v, days = bent()
    trend = st.fit([v], [days], st.Settings(yearly=False))[0]
    assert (trend.bent == 0).sum() >= 18
    place = (trend.bends * np.abs(trend.bent)).sum() / np.abs(trend.bent).sum()
    assert place == pytest.approx(0.5, abs=0.03)
    ahead = trend.at(days[-1] + np.arange(1, 31), st.Settings(yearly=False))
    assert ahead == pytest.approx(100 + 0.1 * (499 + np.arange(1, 31)) + 0.5 * (249 + np.arange(1, 31)), rel=0.02)


def test_no_other_point_is_lower():
    rng = np.random.default_rng(3)
    settings = st.Settings(yearly=False)
    v, days = bent(120, seed=5)
    trend = st.fit([v], [days], settings)[0]
    x = st.design(days, trend.first, trend.span, trend.bends, settings)

    def cost(b):
        return 0.5 * np.sum((v / trend.scale - x @ b) ** 2) + trend.limit * np.abs(b[2:]).sum()

    low = cost(trend.coefficients)
    assert all(cost(trend.coefficients + rng.normal(scale=s, size=len(trend.coefficients))) >= low for s in (1e-4, 1e-2, 0.3) for _ in range(200))


def test_lasso_of_orthogonal_columns_is_a_soft_threshold():
    right = np.array([[3.0, -0.4, 1.0, -2.0]])
    got = st.lasso(np.eye(4)[None] * 2, right, np.array([0.5]))
    assert got[0] == pytest.approx([1.25, 0.0, 0.25, -0.75]) and got[0, 1] == 0.0
    assert st.lasso(np.zeros((2, 0, 0)), np.zeros((2, 0)), np.ones(2)).shape == (2, 0)
    same = np.ones((1, 2, 2))  # two equal columns: singular, yet a minimum
    b = st.lasso(same, np.array([[2.0, 2.0]]), np.array([0.5]))
    assert b.sum() == pytest.approx(1.5)


def test_a_batch_gives_what_each_series_gives_alone():
    settings = st.Settings()
    series = [bent(n, seed=n) for n in (10, 26, 27, 28, 400)] + [(np.full(30, 7.0), 19_000 + np.arange(30.0)), (np.array([2.0]), np.array([5.0]))]
    together = st.fit([v for v, _ in series], [d for _, d in series], settings)
    for (v, days), trend in zip(series, together):
        assert trend.at(days, settings) == pytest.approx(st.fit([v], [days], settings)[0].at(days, settings), abs=1e-6)


def test_table_of_models_and_forecasts(spark, series):
    v, _ = bent(300)
    df = series(days_from("2023-01-01", 300), v)
    model = models.trend_models(df, st.Settings(yearly=False), **NAMES).first()
    assert len(model.bends) == 25 and model.worst_subgradient < 1e-6
    rows = forecast_rows(df, ForecastOptions(methods=("prophet",), yearly=False), **NAMES).orderBy("step").collect()
    assert [r.prophet for r in rows[:3]] == pytest.approx([100 + 0.1 * t + 0.5 * (t - 250) for t in (300, 301, 302)], rel=0.05)
    assert spark.createDataFrame([([],), ([1.0, None],)], "v array<double>").select(
        st.trend_column(F.col("v"), F.expr("transform(v, x -> 1.0D)"), F.expr("array(1.0D)"), st.Settings()).alias("x")
    ).where("x IS NOT NULL").count() == 0


def test_arma_models_name_every_coefficient(spark, series):
    x = np.random.default_rng(1).normal(size=100).cumsum()
    model = models.arma_models(series(days_from("2025-01-01", 100), x), (1, 1, 0), (0, 0, 1, 7), **NAMES).first()
    assert len(model.ar) == 1 and model.seasonal_ar == [] and model.ma == [] and len(model.seasonal_ma) == 1
    assert model.margin > -1e-6 and model.variance > 0 and model.mean == 0.0
