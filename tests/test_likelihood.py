"""Exact likelihoods against dense Gaussian ones, and orders found for made series."""

import itertools

import numpy as np
import pytest
from helpers import NAMES, days_from, months_from
from pyspark.sql import functions as F

from spendframe.operators.forecast import ForecastOptions, auto_order, forecast_rows
from spendframe.operators.forecast import likelihood as ll
from spendframe.operators.forecast.search import minimize, start_points


def made(n, phi=(), theta=(), seed=0, burn=300):
    """An ARMA series; coefficients by lag."""
    noise = np.random.default_rng(seed).normal(size=n + burn)
    x = np.zeros(n + burn)
    for t in range(len(x)):
        x[t] = noise[t] + sum(c * x[t - k] for k, c in enumerate(phi, 1) if t >= k) + sum(c * noise[t - k] for k, c in enumerate(theta, 1) if t >= k)
    return x[burn:]


def dense(x, phi, theta, mean, variance):
    """Log-likelihood from the whole covariance matrix, autocovariances as sums over 4,000 responses."""
    psi = np.zeros(4000)
    psi[0] = 1
    for k in range(1, len(psi)):
        psi[k] = (theta[k - 1] if k <= len(theta) else 0) + sum(phi[j] * psi[k - 1 - j] for j in range(min(len(phi), k)))
    n = len(x)
    gamma = np.array([psi[: len(psi) - k] @ psi[k:] for k in range(n)]) * variance
    cov = gamma[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    rest = x - mean
    return -0.5 * (n * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + rest @ np.linalg.solve(cov, rest))


ORDERS = [
    ll.Order(1, 0, 0), ll.Order(0, 0, 1), ll.Order(2, 0, 1), ll.Order(0, 1, 2), ll.Order(1, 1, 1),
    ll.Order(1, 0, 0, 1, 0, 0, 4), ll.Order(1, 1, 1, 1, 1, 1, 4), ll.Order(0, 0, 1, 0, 0, 1, 3), ll.Order(1, 1, 0, drift=True),
]


def parts(found, order, k):
    p, sp, q, sq = (t[:, [k]] for t in found.tables)
    return ll.multiply(p, sp, order.s, -1)[:, 0], ll.multiply(q, sq, order.s, 1)[:, 0], found.mean[k], found.variance[k]


@pytest.mark.parametrize("order", ORDERS, ids=str)
def test_filter_gives_the_dense_likelihood(order):
    series = [made(n, (0.5,), (0.3,), seed=n) + 4 for n in (90, 61, 40)]
    data = np.zeros((90, 3))
    for k, x in enumerate(series):
        data[: len(x), k] = x
    lengths = np.array([90, 61, 40])
    points = np.random.default_rng(1).uniform(-1, 1, (3, order.parameters))
    p, sp, q, sq = ll.unfold(points, order)
    phi, theta = ll.multiply(p, sp, order.s, -1), ll.multiply(q, sq, order.s, 1)
    logs, vv, vu, uu, _, _ = ll.run_filter(data, lengths, phi, theta, order.has_mean)
    mean = vu / uu if order.has_mean else np.zeros(3)
    variance = (vv - mean * vu) / lengths
    for k, x in enumerate(series):
        got = -0.5 * (lengths[k] * (np.log(2 * np.pi * variance[k]) + 1) + logs[k])
        assert got == pytest.approx(dense(x, phi[:, k], theta[:, k], mean[k], variance[k]), abs=1e-6)


@pytest.mark.parametrize("order", ORDERS, ids=str)
def test_no_moved_parameter_has_a_higher_likelihood(order):
    x = made(120, (0.4, 0, 0, 0.3, -0.12), (0.3, 0, 0.4, 0.12), seed=7)
    found = ll.fit([x], order)
    tables = found.tables
    assert found.loglik[0] == pytest.approx(dense(x, *parts(found, order, 0)), abs=1e-5)
    for step in (1e-3, -1e-3, 0.05, -0.05):
        for table, row in ((t, i) for t in range(4) for i in range(len(tables[t]))):
            moved = [t.copy() for t in tables]
            moved[table][row, 0] += step
            phi, theta = ll.multiply(moved[0], moved[1], order.s, -1)[:, 0], ll.multiply(moved[2], moved[3], order.s, 1)[:, 0]
            if all(np.abs(np.roots([*-c[::-1], 1])).min() > 1.001 for c in (phi, -theta) if len(c)):
                assert dense(x, phi, theta, found.mean[0], found.variance[0]) <= found.loglik[0] + 1e-7


def test_first_order_equals_its_closed_form():
    for seed in range(5):
        x = made(60, (0.6,), seed=seed)
        found = ll.fit([x], ll.Order(1, 1, 0))  # of differences, so without a mean
        a, b, c, n = x @ x, x[1:] @ x[:-1], x[1:-1] @ x[1:-1], len(x)
        # d/dphi of the concentrated likelihood is a cubic
        cubic = [(n - 1) * c, -(n - 2) * b, -(n * c + a), n * b]
        roots = [r.real for r in np.roots(cubic) if abs(r.imag) < 1e-9 and abs(r.real) < 1]
        assert found.tables[0][0, 0] == pytest.approx(roots[0], abs=1e-7) and len(roots) == 1


def test_a_seasonal_product_has_no_free_lag():
    own, seasonal = np.array([[0.5]]), np.array([[0.4]])
    assert ll.multiply(own, seasonal, 4, -1)[:, 0] == pytest.approx([0.5, 0, 0, 0.4, -0.2])
    assert ll.multiply(own, seasonal, 4, 1)[:, 0] == pytest.approx([0.5, 0, 0, 0.4, 0.2])
    x = made(4000, (0.5, 0, 0, 0.3, -0.15), seed=3)
    found = ll.fit([x], ll.Order(1, 0, 0, 1, 0, 0, 4))
    assert [found.tables[0][0, 0], found.tables[1][0, 0]] == pytest.approx([0.5, 0.3], abs=0.05)


def test_forecasts_are_conditional_means():
    order = ll.Order(1, 0, 1)
    x = made(50, (0.7,), (0.4,), seed=11) + 3
    found = ll.fit([x], order)
    phi, theta, mean, variance = parts(found, order, 0)
    n, h = len(x), 5
    psi = np.zeros(3000)
    psi[:2] = 1, phi[0] + theta[0]
    for k in range(2, len(psi)):
        psi[k] = phi[0] * psi[k - 1]
    gamma = np.array([psi[: len(psi) - k] @ psi[k:] for k in range(n + h)])
    lag = lambda a, b: gamma[np.abs(np.subtract.outer(a, b))]
    want = mean + lag(np.arange(n, n + h), np.arange(n)) @ np.linalg.solve(lag(np.arange(n), np.arange(n)), x - mean)
    assert ll.ahead(found, h)[:, 0] == pytest.approx(want, abs=1e-8)


def test_undo_inverts_difference():
    x = np.random.default_rng(1).normal(size=60).cumsum()
    for gaps in ([], [1], [1, 1], [12], [1, 12], [1, 1, 7]):
        whole, levels = ll.difference(x, gaps)[-1], ll.difference(x[:40], gaps)
        assert ll.undo(levels, gaps, whole[len(levels[-1]) :]) == pytest.approx(x[40:])


def test_series_of_any_length_in_one_batch():
    values = [np.array([]), np.arange(3.0), np.full(30, 5.0), made(200, (0.5,)), np.arange(40.0), np.array([1.0, np.nan] * 20), made(25, (0.5,), seed=4)]
    alone = [ll.forecasts([v], [10], ll.Order(1, 1, 1))[0] for v in values]
    together = ll.forecasts(values, [10] * len(values), ll.Order(1, 1, 1))
    for one, other in zip(alone, together):
        assert (one is None) == (other is None)
        if one is not None:
            assert one == pytest.approx(other, abs=1e-6)
    assert [f is None for f in together] == [True, True, False, False, False, True, False]
    assert together[2] == pytest.approx(np.full(10, 5.0))


def test_minimize_finds_many_minima_at_once():
    goal = np.random.default_rng(2).normal(size=(40, 3))

    def bowl(rows, points):
        z = points - goal[rows]
        return z[:, 0] ** 2 + 10 * (z[:, 1] - z[:, 0] ** 2) ** 2 + np.exp(z[:, 2]) - z[:, 2]

    points, values = minimize(bowl, 40, start_points(3))
    assert points == pytest.approx(goal, abs=1e-4) and values == pytest.approx(np.ones(40))
    assert len(start_points(5)) == 64 and start_points(0).shape == (1, 0)


# -- automatic order --------------------------------------------------------------------------


def test_differences_of_made_series():
    assert auto_order.differences(made(300, (0.3,), seed=1), 2, 1) == (0, 0)
    assert auto_order.differences(made(300, seed=2).cumsum(), 2, 1) == (1, 0)
    assert auto_order.differences(made(300, seed=3).cumsum().cumsum(), 2, 1) == (2, 0)
    season = np.tile(20 * np.sin(np.arange(12)), 15)
    assert auto_order.differences(season + made(180, seed=4), 2, 12) == (0, 1)
    assert auto_order.seasonal_strength(made(180, seed=5), 12) < 0.64
    assert auto_order.kpss(np.full(20, 3.0)) == 0.0


def test_chosen_orders_and_their_scores(spark):
    rows = [("ar", made(400, (0.6, -0.3), seed=1).tolist()), ("ma", made(400, (), (0.8,), seed=2).tolist()), ("walk", made(400, seed=3).cumsum().tolist()), (None, made(9, seed=4).tolist()), ("none", [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "name string, v array<double>")
    scored = auto_order.orders(frame, series_cols=["name"], values="v").collect()
    best = {}
    for r in scored:
        if r.aicc is not None and (r.name not in best or r.aicc < best[r.name].aicc):
            best[r.name] = r
    assert best["ar"].order.p >= 1 and best["ar"].order.d == 0 and best["walk"].order.d == 1
    assert best["ma"].order.q >= 1 and "none" not in best
    for r in best.values():  # the score again, from the dense likelihood
        order = ll.Order(*r.order[:6], 1, r.order.drift)
        x = ll.difference(np.array(dict(rows)[r.name]), order.gaps)[-1]
        found, free = ll.fit([x], order), order.parameters + order.has_mean + 1
        want = -2 * dense(x, *parts(found, order, 0)) + 2 * free + 2 * free * (free + 1) / (len(x) - free - 1)
        assert r.aicc == pytest.approx(want, abs=1e-4)


def test_candidates_are_dealt_and_the_layout_does_not_matter(spark, series):
    values = made(80, (0.6,), seed=6) + np.arange(80)
    options = ForecastOptions(methods=(), darts_algorithm="auto_arima", auto_seasonal_periods=7)
    df = series(days_from("2025-01-01", 80), values)
    found = [[r.darts for r in forecast_rows(d, options, **NAMES).orderBy("step").collect()] for d in (df, df.repartition(5))]
    assert found[0] == pytest.approx(found[1], abs=1e-6) and len(found[0]) == 365
    plan = auto_order.orders(spark.createDataFrame([("a", [1.0] * 20)], "n string, v array<double>"), series_cols=["n"], values="v")
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(n") == 1


def test_series_with_and_without_a_name(spark, series):
    values = np.concatenate([made(60, (0.5,), seed=k) + 50 for k in range(2)])
    dates = days_from("2025-01-01", 60) * 2
    df = series(dates, values, service=["a"] * 60 + [None] * 60)
    options = ForecastOptions(methods=("arima", "sarima"), darts_algorithm="auto_arima", sarima_seasonal_order=(1, 0, 0, 7))
    rows = forecast_rows(df, options, series_cols=["service"], **NAMES).where("step <= 3").orderBy("service", "step").collect()
    assert [r.service for r in rows] == [None] * 3 + ["a"] * 3
    assert all(r.arima is not None and r.sarima is not None and r.darts is not None for r in rows)


def test_exact_and_least_squares_agree_on_long_series(series):
    df = series(months_from("1950-01-01", 600), made(600, (0.6,), seed=9).cumsum() + 100)
    found = {}
    for name in ("likelihood", "least_squares"):
        rows = forecast_rows(df, ForecastOptions(methods=("arima",), arima_order=(1, 1, 0), arma_estimator=name), **NAMES)
        found[name] = [r.arima for r in rows.orderBy("step").collect()]
    assert found["likelihood"] == pytest.approx(found["least_squares"], abs=0.05)
    with pytest.raises(ValueError):
        ForecastOptions(arma_estimator="guess")


def test_start_points_hold_zero_and_both_signs():
    for count in (1, 2, 3):
        points = start_points(count)
        assert len(points) == 3**count and not points[0].any()
        assert {tuple(np.sign(p)) for p in points} == set(itertools.product((-1.0, 0.0, 1.0), repeat=count))
