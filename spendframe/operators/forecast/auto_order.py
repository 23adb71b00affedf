"""The order of an ARIMA model, found for each series.

Differences first: a seasonal one where the season is strong (share of the variance of season and rest
that the season explains), then plain ones as long as the KPSS statistic rejects a level.  Candidates
for the other orders are rows, (series, order), dealt by Spark over all tasks, so a few long series
use as many tasks as many short ones; after one difference each order also comes with a drift.  Each is fitted by exact maximum likelihood; the lowest AICc wins,
of equal ones the smaller model.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.operators.forecast import likelihood
from spendframe.operators.forecast.likelihood import Order

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORECAST = "_auto_forecast"
#: The 5 % point of the KPSS statistic for a level, and the strength from which a season is differenced.
KPSS_LIMIT, STRONG = 0.463, 0.64
PARTS = ("p", "d", "q", "sp", "sd", "sq")


def _orders(column: pd.DataFrame, period: int) -> list[Order | None]:
    rows = column[[*PARTS, "drift"]].itertuples(index=False)
    return [None if pd.isna(row.p) else Order(*(int(v) for v in row[:6]), period, bool(row.drift)) for row in rows]


def kpss(x: np.ndarray) -> float:
    """The KPSS statistic of a level, with Bartlett weights over 3 sqrt(n) / 13 lags."""
    rest = x - x.mean()
    n = len(x)
    lags = int(3 * np.sqrt(n) / 13)
    long_run = rest @ rest / n
    for k in range(1, lags + 1):
        long_run += 2 * (1 - k / (lags + 1)) * (rest[k:] @ rest[:-k]) / n
    return float((np.cumsum(rest) ** 2).sum() / (n * n * long_run)) if long_run > 1e-12 * max(1.0, float(x @ x) / n) else 0.0


def seasonal_strength(x: np.ndarray, period: int) -> float:
    """1 - var(rest) / var(season + rest) of a classical decomposition; 0 for less than two full seasons."""
    if period < 2 or len(x) < 2 * period + 1:
        return 0.0
    weights = np.full(period + 1 - period % 2, 1.0 / period)
    if period % 2 == 0:
        weights[[0, -1]] /= 2
    half = len(weights) // 2
    trend = np.convolve(x, weights, "valid")
    bare = x[half : half + len(trend)] - trend
    phase = (np.arange(len(bare)) + half) % period
    season = np.array([bare[phase == k].mean() for k in range(period)])
    season -= season.mean()
    rest = bare - season[phase]
    spread = np.var(rest + season[phase])
    return float(max(0.0, 1 - np.var(rest) / spread)) if spread > 0 else 0.0


def differences(x: np.ndarray, most: int, period: int) -> tuple[int, int]:
    """(plain, seasonal) differences that make a series level."""
    seasonal = int(seasonal_strength(x, period) > STRONG)
    if seasonal:
        x = x[period:] - x[:-period]
    plain = 0
    while plain < most and len(x) > 3 and np.ptp(x) > 0 and kpss(x) > KPSS_LIMIT:
        x, plain = np.diff(x), plain + 1
    return plain, seasonal


def _differences_column(values: Column, most: int, period: int) -> Column:
    def run(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([differences(np.asarray(v, dtype=float), most, period) for v in column], columns=["d", "sd"])

    return F.pandas_udf(run, "d int, sd int")(values)


def _score_column(values: Column, order: Column, period: int) -> Column:
    """AICc of each row's order on its values; null where the series can't bear it."""

    def run(column: pd.Series, orders: pd.DataFrame) -> pd.Series:
        arrays = [np.asarray(v, dtype=float) for v in column]
        out = np.full(len(arrays), np.nan)
        models = _orders(orders, period)
        with np.errstate(all="ignore"):
            for model in set(models):
                rows = [k for k, own in enumerate(models) if own == model]
                free = model.parameters + model.has_mean + 1
                for index, levels, found in likelihood.fitted([arrays[k] for k in rows], model):
                    for at, k in enumerate(index):
                        spare = len(levels[at][-1]) - free - 1
                        if spare > 0:
                            out[rows[k]] = -2 * found.loglik[at] + 2 * free + 2 * free * (free + 1) / spare
        return pd.Series(np.where(np.isfinite(out), out, np.nan))

    return F.nullif(F.pandas_udf(run, "double")(values, order), F.lit(float("nan")))


def _forecast_column(values: Column, steps: Column, order: Column, period: int) -> Column:
    def run(column: pd.Series, horizon: pd.Series, orders: pd.DataFrame) -> pd.Series:
        arrays = [np.asarray(v, dtype=float) for v in column]
        out: list = [None] * len(arrays)
        groups: dict[Order, list[int]] = {}
        for k, model in enumerate(_orders(orders, period)):
            if model is not None:
                groups.setdefault(model, []).append(k)
        for model, rows in groups.items():
            found = likelihood.forecasts([arrays[k] for k in rows], [int(horizon[k]) for k in rows], model)
            for k, forecast in zip(rows, found):
                out[k] = forecast
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<double>")(values, steps, order)


def orders(
    table: DataFrame, *, series_cols: Sequence[str], values: str, max_order: int = 2, max_differences: int = 2, period: int = 1
) -> DataFrame:
    """One row per series and candidate: ``order`` as struct(p, d, q, sp, sd, sq, drift), and its ``aicc``.

    ``table`` has a row per series with its values, oldest first, as an array."""
    seasonal = range(2) if period > 1 else range(1)
    grid = list(itertools.product(range(max_order + 1), range(max_order + 1), seasonal, seasonal, (False, True)))
    known = table.select(*series_cols, values).withColumn("_d", _differences_column(F.col(values), max_differences, period))
    kinds = F.array(
        *[F.struct(*[F.lit(n).alias(name) for n, name in zip(row, ("p", "q", "sp", "sq", "drift"))]) for row in grid]
    )
    rows = known.select(*series_cols, values, "_d", F.explode(kinds).alias("_k")).where("NOT _k.drift OR _d.d + _d.sd = 1")
    own = F.struct("_k.p", "_d.d", "_k.q", "_k.sp", "_d.sd", "_k.sq", "_k.drift")
    # dealt by series and order: the model with the most parameters is not one task's alone
    dealt = rows.select(*series_cols, values, own.alias("order")).repartition(*series_cols, "order")
    return dealt.withColumn("aicc", _score_column(F.col(values), F.col("order"), period))


def choose(
    fitted: DataFrame, *, series_cols: Sequence[str], values: str, steps: str, max_order: int, max_differences: int, period: int
) -> DataFrame:
    """``fitted`` with the forecasts of each series' best order."""
    settings = {"max_order": max_order, "max_differences": max_differences, "period": period}
    scored = orders(fitted, series_cols=series_cols, values=values, **settings).where("aicc IS NOT NULL")
    size = sum(F.col(f"order.{part}") for part in ("p", "q", "sp", "sq")) + F.col("order.drift").cast("int")
    keys = list(series_cols) or ["_all"]
    if not series_cols:  # one series: both sides have one row
        scored, fitted = scored.withColumn("_all", F.lit(0)), fitted.withColumn("_all", F.lit(0))
    best = scored.groupBy(*keys).agg(F.min_by("order", F.struct("aicc", size, "order")).alias("_order"))
    best = best.select(*[F.col(c).alias(f"_best_{c}") for c in keys], "_order")
    joined = fitted.join(best, [F.col(f"_best_{c}").eqNullSafe(F.col(c)) for c in keys], "left").drop("_all", *[f"_best_{c}" for c in keys])
    return joined.withColumn(FORECAST, _forecast_column(F.col(values), F.col(steps), F.col("_order"), period)).drop("_order")
