"""The trained network: gradients against differences, held-out error, batches, odd series."""

import numpy as np
import pytest
from helpers import NAMES, days_from
from pyspark.sql import functions as F

from spendframe.operators.forecast import ForecastOptions, forecast_rows
from spendframe.operators.forecast import network as nw

SHAPE = nw.Shape(lags=3, hidden=2, hinges=2, yearly=False, weekly=True)


def weekly(n=400, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    rest = np.zeros(n)
    for k in range(1, n):
        rest[k] = 0.7 * rest[k - 1] + rng.normal()
    return 100 + 0.05 * t + 10 * np.sin(2 * np.pi * t / 7 + seed) + 2 * rest, 19_000.0 + t


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    y, days = rng.normal(size=(2, 25)), np.tile(19_000.0 + np.arange(25), (2, 1))
    x = np.stack([nw.features(d, d[0], 24.0, SHAPE) for d in days])
    w = {name: v + rng.normal(scale=0.3, size=v.shape) for name, v in nw.start(x, y, SHAPE).items()}
    _, gradient = nw.loss_and_gradient(x, y, w, SHAPE)
    for name, values in w.items():
        for at in np.ndindex(*values.shape):
            moved = []
            for step in (1e-6, -1e-6):
                other = {k: v.copy() for k, v in w.items()}
                other[name][at] += step
                moved.append(nw.loss_and_gradient(x, y, other, SHAPE)[0][at[0]])
            assert gradient[name][at] == pytest.approx((moved[0] - moved[1]) / 2e-6, abs=1e-6), (name, at)


def test_training_lowers_the_loss():
    y, days = weekly(200)
    y = ((y - y.mean()) / y.std())[None]
    x = nw.features(days, days[0], 199.0, SHAPE)[None]
    before, _ = nw.loss_and_gradient(x, y, nw.start(x, y, SHAPE), SHAPE)
    w, low = nw.train(x, y, SHAPE)
    assert low[0] < 0.7 * before[0] and nw.loss_and_gradient(x, y, w, SHAPE)[0] == pytest.approx(low)


def test_held_out_error_is_below_the_seasonal_naive():
    shape, series = nw.Shape(yearly=False, weekly=True), [weekly(400, seed=k) for k in range(6)]
    values, days = np.stack([v for v, _ in series]), np.stack([d for _, d in series])
    got = nw.forecast(values[:, :-56], days[:, :-56], days[:, -56:], shape)
    naive = np.tile(values[:, -63:-56], (1, 8))
    errors = np.abs(got - values[:, -56:]).mean(axis=1), np.abs(naive - values[:, -56:]).mean(axis=1)
    assert (errors[0] < errors[1]).sum() >= 5 and errors[0].mean() < 0.75 * errors[1].mean()


def test_a_series_does_not_depend_on_its_block():
    series = [weekly(90, seed=k) for k in range(4)]
    values, days = np.stack([v for v, _ in series]), np.stack([d for _, d in series])
    future = days[:, -1:] + np.arange(1, 11)
    whole = nw.forecast(values, days, future, SHAPE)
    for k in range(4):
        assert nw.forecast(values[[k]], days[[k]], future[[k]], SHAPE)[0] == pytest.approx(whole[k], abs=1e-9)


def test_column_takes_series_of_any_length(spark):
    rows = [([],), ([1.0] * 3,), ([1.0, 2.0, 3.0, 4.0],), ([5.0] * 20,), ([float(k % 7) for k in range(60)],), ([1.0, None, 2.0, 4.0, 5.0],)]
    frame = spark.createDataFrame(rows, "v array<double>").repartition(1)
    days = F.transform("v", lambda v, k: (k + 19_000).cast("double"))
    future = F.sequence(F.lit(20_000), F.lit(20_004)).cast("array<double>")
    got = {len(r.v): r.x for r in frame.select("v", nw.forecast_column(F.col("v"), days, future, SHAPE).alias("x")).collect()}
    assert got[0] is None and got[3] is None and got[5] is None and len(got[4]) == 5
    assert got[20] == pytest.approx([5.0] * 5, abs=1e-6)


def test_forecast_column_of_the_report(series):
    v, _ = weekly(120)
    options = ForecastOptions(methods=("neural_prophet", "prophet"), yearly=False, weekly=True, ensemble=True)
    rows = forecast_rows(series(days_from("2025-01-01", 120), v), options, **NAMES).orderBy("step").collect()
    assert len(rows) == 365 and all(r.neural_prophet is not None for r in rows)
    assert rows[0].ensemble == pytest.approx((rows[0].neural_prophet + rows[0].prophet) / 2)
    with pytest.raises(ValueError):
        ForecastOptions(network_lags=0)
