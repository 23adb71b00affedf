"""Fitted smoothing against plain recursions, and theta with a season."""

import numpy as np
import pytest
from helpers import NAMES, months_from
from pyspark.sql import functions as F

from spendframe.operators.forecast import ForecastOptions, forecast_rows, models
from spendframe.operators.forecast import smoothing as sm


def seasonal(n=72, seed=0, slope=0.5, noise=1.0):
    t = np.arange(n)
    return 100 + slope * t + 8 * np.sin(2 * np.pi * t / 12) + noise * np.random.default_rng(seed).normal(size=n)


def recursion(v, first, alpha, beta, gamma, damping, period):
    """Errors and last states, written out."""
    level, trend, season, errors = first[0], first[1], list(first[2:]), []
    for k, value in enumerate(v):
        said = level + damping * trend + (season[k % period] if period > 1 else 0)
        errors.append(value - said)
        level, trend = level + damping * trend + alpha * errors[-1], damping * trend + beta * errors[-1]
        if period > 1:
            season[k % period] += gamma * errors[-1]
    return np.array(errors), level, trend, season


SHAPES = [sm.Shape(), sm.Shape(damped=True), sm.Shape(1), sm.Shape(1, damped=True), sm.Shape(4)]


@pytest.mark.parametrize("shape", SHAPES, ids=str)
def test_errors_and_forecasts_are_those_of_the_recursion(shape):
    values = np.stack([seasonal(seed=k) for k in range(3)])
    found = sm.fit(values, shape)
    future = sm.ahead(values, found, shape, 30)
    for k, v in enumerate(values):
        alpha, beta, gamma, damping = (float(w[k]) for w in found.weights)
        errors, level, trend, season = recursion(v, found.first[k], alpha, beta, gamma, damping, shape.period)
        assert found.error[k] == pytest.approx(np.mean(errors**2))
        want = [level + trend * sum(damping**i for i in range(1, h + 1)) + (season[(len(v) + h - 1) % shape.period] if shape.period > 1 else 0) for h in range(1, 31)]
        assert future[k] == pytest.approx(want)


@pytest.mark.parametrize("shape", SHAPES, ids=str)
def test_no_worse_than_fixed_weights_or_moved_ones(shape):
    values = np.stack([seasonal(seed=k, noise=3.0) for k in range(6)] + [np.random.default_rng(9).normal(size=72).cumsum()])
    found = sm.fit(values, shape)
    assert (found.error <= found.fixed_error * (1 + 1e-9)).all()
    spread = values.std(axis=1)
    plain = (values - values.mean(axis=1, keepdims=True)) / spread[:, None]
    for step in (0.9, 1.1):
        moved = (np.minimum(found.weights[0] * step, 1.0), found.weights[1] * min(step, 1.0), found.weights[2] * min(step, 1.0), found.weights[3])
        squares = sm.starts(plain, moved, shape, sm.guess(plain, shape))[1] / values.shape[1] * spread**2
        assert (squares >= found.error * (1 - 5e-3)).all()  # a weight near its bound is flat


def test_starting_states_are_the_best_ones():
    shape, values = sm.Shape(4), np.stack([seasonal(40, seed=k) for k in range(2)])
    weights = tuple(np.full(2, w) for w in (0.4, 0.1, 0.2, 1.0))
    first, squares = sm.starts(values, weights, shape, sm.guess(values, shape))
    rng = np.random.default_rng(0)
    for _ in range(100):
        errors, _ = sm.run(values.T[..., None], (first + rng.normal(scale=0.1, size=first.shape))[:, None], weights, shape)
        assert ((errors[..., 0] ** 2).sum(axis=0) >= squares * (1 - 1e-5)).all()


def test_a_clear_season_is_continued():
    values = seasonal(84, noise=0.1)[None]
    got = sm.ahead(values[:, :72], sm.fit(values[:, :72], sm.Shape()), sm.Shape(), 12)
    assert got == pytest.approx(values[:, 72:], abs=1.0)


def test_column_takes_series_of_any_length(spark):
    rows = [([],), ([1.0],), ([1.0, 2.0],), ([3.0] * 30,), (seasonal(30).tolist(),), (seasonal(30, seed=1).tolist(),), ([1.0, None, 2.0],)]
    frame = spark.createDataFrame(rows, "v array<double>")
    got = frame.select("v", sm.forecast_column(F.col("v"), F.lit(5), sm.Shape()).alias("x"), sm.model_column(F.col("v"), sm.Shape()).alias("m")).collect()
    assert [r.x is None for r in got] == [True, True, False, False, False, False, True]
    assert got[3].x == pytest.approx([3.0] * 5, abs=1e-6) and got[0].m.alpha is None
    alone = sm.ahead(np.array([rows[5][0]]), sm.fit(np.array([rows[5][0]]), sm.Shape()), sm.Shape(), 5)[0]
    assert got[5].x == pytest.approx(alone, abs=1e-5)


def test_the_test_of_a_season():
    assert sm.has_season(seasonal(slope=0.0), 12) and not sm.has_season(np.random.default_rng(1).normal(size=72), 12)
    assert not sm.has_season(seasonal(20, slope=0.0), 12) and not sm.has_season(np.full(60, 2.0), 12) and not sm.has_season(seasonal(), 1)


def test_theta_with_a_season():
    t = np.arange(72)
    factors = 1 + 0.3 * np.sin(2 * np.pi * np.arange(12) / 12)
    v = (50 + t / 10) * factors[t % 12]
    got = sm.seasonal_theta(v, 24, 2.0, 12)
    after = np.arange(72, 96)
    assert got == pytest.approx((50 + after / 10) * factors[after % 12], rel=0.02)
    flat = np.array([1.0, -2.0] * 30)  # factors need positive values
    assert np.isfinite(sm.seasonal_theta(flat, 3, 2.0, 2)).all() and sm.season_factors(flat, 2) is None
    assert sm.seasonal_theta(np.array([4.0]), 2, 2.0, 12).tolist() == [4.0, 4.0]


def test_names_of_the_lag_models(series):
    df = series(months_from("2019-01-01", 72), seasonal(slope=0.0))
    for name in ("exponential_smoothing", "theta"):
        rows = forecast_rows(df, ForecastOptions(methods=("theta",), darts_algorithm=name), **NAMES).orderBy("step").collect()
        assert [r.darts for r in rows] == pytest.approx(seasonal(84, slope=0.0, noise=0.0)[72:], rel=0.06)
    model = models.smoothing_models(df, **NAMES).first()
    assert len(model.first) == 14 and model.error <= model.fixed_error
