"""Exponential smoothing with fitted weights: level, trend (damped or not) and additive season.

    value = level + damping * trend + season + error
    level, trend and season move by alpha, beta and gamma times the error

Given weights and damping, errors are linear in the states that a series starts from, so those have
a closed form: the recursion runs once for the series and once for each starting state, and a small
least-squares problem gives the best start.  Only weights and damping are searched for, for all
series of a block at once.

``seasonal_theta`` is the theta method on a series whose season has been taken out: an
autocorrelation test says whether there is one, classical decomposition takes it out, and forecasts
get it back.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from spendframe.operators.forecast.search import minimize, start_points

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELLS = 8_000_000
#: How firmly starting states are held to a first guess, where a series says little about them.
HOLD = 1e-4
#: Weights and damping that a fit is held against.
FIXED = (0.3, 0.1, 0.1, 1.0)
#: Fixed value: the two-sided 10 % point of the normal distribution, for the test of a season.
SEASON_TEST = 1.645


@dataclass(frozen=True)
class Shape:
    """``period`` 1: no season.  ``damped``: the trend dies out."""

    period: int = 12
    trend: bool = True
    damped: bool = False

    @property
    def weights(self) -> int:
        return 1 + self.trend + (self.period > 1) + (self.trend and self.damped)

    @property
    def states(self) -> int:
        return 1 + self.trend + (self.period if self.period > 1 else 0)

    def fitting(self, count: int) -> Shape:
        """The shape a series of ``count`` values can bear: a season needs two of them, a trend four values."""
        return Shape(self.period if count >= 2 * self.period + 2 else 1, self.trend and count >= 4, self.damped)


def unfold(points: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """alpha, beta, gamma and damping, each (N,), at the search's points: beta at most alpha, gamma at most 1 - alpha."""
    share = 1.0 / (1.0 + np.exp(-3.0 * points))
    none, one = np.zeros(len(points)), np.ones(len(points))
    alpha, at = share[:, 0], 1
    beta, gamma, damping = none, none, one
    if shape.trend:
        beta, at = alpha * share[:, at], at + 1
    if shape.period > 1:
        gamma, at = (1.0 - alpha) * share[:, at], at + 1
    if shape.trend and shape.damped:
        damping = 0.8 + 0.198 * share[:, at]
    return alpha, beta, gamma, damping


def run(values: np.ndarray, first: np.ndarray, weights, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(errors (T, N, C), states after the last value (N, C, states)) of the recursion.

    ``values`` (T, N, C): the series in C versions; ``first`` (N, C, states): what each starts from."""
    alpha, beta, gamma, damping = (w[:, None] for w in weights)
    level = first[..., 0].copy()
    trend = first[..., 1].copy() if shape.trend else np.zeros_like(level)
    season = first[..., 1 + shape.trend :].copy()
    errors = np.empty_like(values)
    for t in range(len(values)):
        drift = damping * trend
        said = level + drift
        if shape.period > 1:
            said = said + season[..., t % shape.period]
        error = values[t] - said
        errors[t] = error
        level = level + drift + alpha * error
        if shape.trend:
            trend = drift + beta * error
        if shape.period > 1:
            season[..., t % shape.period] += gamma * error
    parts = [level[..., None]] + ([trend[..., None]] if shape.trend else []) + [season]
    return errors, np.concatenate(parts, axis=-1)


def guess(values: np.ndarray, shape: Shape) -> np.ndarray:
    """(N, states) to start from: a line through the first seasons and what is left by phase."""
    n, count = values.shape
    head = values[:, : max(min(count, 2 * shape.period if shape.period > 1 else 10), 2)]
    t = np.arange(head.shape[1]) - (head.shape[1] - 1) / 2
    slope = head @ t / max(t @ t, 1e-12) if shape.trend else np.zeros(n)
    level = head.mean(axis=1) + slope * (-1 - (head.shape[1] - 1) / 2)
    parts = [level[:, None]] + ([slope[:, None]] if shape.trend else [])
    if shape.period > 1:
        rest = head - (level[:, None] + slope[:, None] * (1 + np.arange(head.shape[1])))
        parts.append(np.stack([rest[:, k :: shape.period].mean(axis=1) for k in range(shape.period)], axis=1))
    return np.concatenate(parts, axis=1)


def starts(values: np.ndarray, weights, shape: Shape, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best starting states (N, states), squared errors (N,)) for given weights."""
    n, count = values.shape
    versions = shape.states + 1
    data = np.zeros((count, n, versions))
    data[..., 0] = values.T
    first = np.zeros((n, versions, shape.states))
    first[:, 1:] = -np.eye(shape.states)  # minus a unit state: errors are then what that state adds
    errors, _ = run(data, first, weights, shape)
    own, parts = errors[..., 0], errors[..., 1:]
    # errors = own - parts @ start, held to the guess where they don't tell
    gram = np.einsum("tni,tnj->nij", parts, parts) + HOLD * np.eye(shape.states)
    right = np.einsum("tni,tn->ni", parts, own) + HOLD * held
    best = np.linalg.solve(gram, right[..., None])[..., 0]
    left = own - np.einsum("tni,ni->tn", parts, best)
    return best, (left**2).sum(axis=0)


@dataclass
class Fit:
    """Weights, starting states and the mean squared error of one step, a row a series."""

    weights: tuple[np.ndarray, ...]
    first: np.ndarray
    error: np.ndarray
    fixed_error: np.ndarray  # with the weights FIXED, from the best start for them


def fit(values: np.ndarray, shape: Shape) -> Fit:
    """Fits series (N, T) of equal length."""
    middle, spread = values.mean(axis=1, keepdims=True), values.std(axis=1, keepdims=True)
    spread = np.where(spread > 0, spread, 1.0)
    plain = (values - middle) / spread
    held = guess(plain, shape)

    def objective(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        return np.log(starts(plain[rows], unfold(points, shape), shape, held[rows])[1] / values.shape[1] + 1e-12)

    points, _ = minimize(objective, len(values), start_points(shape.weights, most=27), rounds=40)
    weights = unfold(points, shape)
    first, squares = starts(plain, weights, shape, held)
    first *= spread
    first[:, 0] += middle[:, 0]
    fixed = [np.full(len(values), w) for w in FIXED]
    fixed = [fixed[0], fixed[1] * shape.trend, fixed[2] * (shape.period > 1), fixed[3]]
    unit = spread[:, 0] ** 2 / values.shape[1]
    return Fit(weights, first, squares * unit, starts(plain, fixed, shape, held)[1] * unit)


def ahead(values: np.ndarray, found: Fit, shape: Shape, steps: int) -> np.ndarray:
    """(N, steps) forecasts: the last states carried on without errors."""
    _, last = run(values.T[..., None], found.first[:, None], found.weights, shape)
    last, damping = last[:, 0], found.weights[3]
    out = np.repeat(last[:, [0]], steps, axis=1)
    if shape.trend:
        powers = damping[:, None] ** np.arange(1, steps + 1)
        out = out + last[:, [1]] * np.cumsum(powers, axis=1)
    if shape.period > 1:
        season = last[:, 1 + shape.trend :]
        out = out + season[:, (values.shape[1] + np.arange(steps)) % shape.period]
    return out


def _alike(column: pd.Series, shape: Shape):
    """(rows, series (N, T), shape) of series of equal length, in blocks of bounded size."""
    groups: dict[int, list[int]] = {}
    for k, v in enumerate(column):
        if len(v) >= 2 and np.isfinite(np.asarray(v, dtype=float)).all():
            groups.setdefault(len(v), []).append(k)
    for count, rows in groups.items():
        own = shape.fitting(count)
        most = max(CELLS // (count * (own.states + 1) * 27), 1)
        for part in (rows[at : at + most] for at in range(0, len(rows), most)):
            yield part, np.stack([np.asarray(column[k], dtype=float) for k in part]), own


def forecast_column(values: Column, steps: Column, shape: Shape) -> Column:
    """Array of forecasts of each row's array of values; null for fewer than two values."""

    def run_batch(column: pd.Series, horizon: pd.Series) -> pd.Series:
        out: list = [None] * len(column)
        for rows, series, own in _alike(column, shape):
            future = ahead(series, fit(series, own), own, int(max(horizon[k] for k in rows)))
            for k, found in zip(rows, future):
                out[k] = found[: int(horizon[k])] if np.isfinite(found).all() else None
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run_batch, "array<double>")(values, steps)


MODEL = "alpha double, beta double, gamma double, damping double, first array<double>, error double, fixed_error double"


def model_column(values: Column, shape: Shape) -> Column:
    """Weights, starting states (level, trend, season) and mean squared error of one step."""

    def run_batch(column: pd.Series) -> pd.DataFrame:
        out: list[tuple] = [(None,) * 7] * len(column)
        for rows, series, own in _alike(column, shape):
            found = fit(series, own)
            for at, k in enumerate(rows):
                out[k] = (*(float(w[at]) for w in found.weights), found.first[at], float(found.error[at]), float(found.fixed_error[at]))
        return pd.DataFrame(out, columns=[part.split()[0] for part in MODEL.split(", ")])

    return F.pandas_udf(run_batch, MODEL)(values)


# -- theta with a season ----------------------------------------------------------------------


def has_season(v: np.ndarray, period: int) -> bool:
    """Whether the autocorrelation at one period is larger than chance gives, after Bartlett."""
    if period < 2 or len(v) < 2 * period + 1:
        return False
    rest = v - v.mean()
    total = rest @ rest
    if total <= 1e-12 * max(1.0, float(v @ v)):
        return False
    acf = np.array([rest[k:] @ rest[: len(rest) - k] for k in range(1, period + 1)]) / total
    return bool(abs(acf[-1]) > SEASON_TEST * np.sqrt((1 + 2 * (acf[:-1] ** 2).sum()) / len(v)))


def season_factors(v: np.ndarray, period: int) -> np.ndarray | None:
    """Multiplicative factors by phase, of mean one, from a centred moving average; None where it nears zero."""
    weights = np.full(period + 1 - period % 2, 1.0 / period)
    if period % 2 == 0:
        weights[[0, -1]] /= 2
    half = len(weights) // 2
    trend = np.convolve(v, weights, "valid")
    if (np.abs(trend) < 1e-9).any() or (v <= 0).any():
        return None
    ratio = v[half : half + len(trend)] / trend
    phase = (np.arange(len(ratio)) + half) % period
    factors = np.array([ratio[phase == k].mean() for k in range(period)])
    return factors / factors.mean()


def seasonal_theta(v: np.ndarray, steps: int, theta: float, period: int) -> np.ndarray:
    """The theta method on the series without its season, and the season put back."""
    factors = season_factors(v, period) if has_season(v, period) else None
    plain = v / factors[np.arange(len(v)) % period] if factors is not None else v
    past = np.arange(len(v)) - (len(v) - 1.0)
    center = past.mean()
    slope = (past - center) @ (plain - plain.mean()) / ((past - center) @ (past - center)) if len(v) > 1 else 0.0
    line = plain.mean() - slope * center
    last = theta * (plain[-1] - line) + line
    before = theta * (plain[-2] - (line - slope)) + line - slope if len(v) > 1 else last
    out = line + slope * np.arange(1, steps + 1) + (2 * last - before - line)
    return out * factors[(len(v) + np.arange(steps)) % period] if factors is not None else out


def seasonal_theta_column(values: Column, steps: Column, theta: float, period: int) -> Column:
    def run_batch(column: pd.Series, horizon: pd.Series) -> pd.Series:
        found = [seasonal_theta(np.asarray(v, dtype=float), int(h), theta, period) if len(v) else None for v, h in zip(column, horizon)]
        return pd.Series([f if f is not None and np.isfinite(f).all() else None for f in found], dtype=object)

    return F.pandas_udf(run_batch, "array<double>")(values, steps)
