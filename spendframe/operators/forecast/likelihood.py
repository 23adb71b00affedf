"""Seasonal ARIMA by exact maximum likelihood, for all series of a batch at once.

The likelihood of the differenced series comes from a Kalman filter in which the covariance changes by
a matrix of rank one each step, so a step costs the number of lags and not its square; when that
change has died out the filter is a plain recursion.  The filter starts from the stationary
covariance.  Variance, and the mean of a series that is not differenced, have closed forms given the
rest and are not searched for.

Parameters are searched for as partial autocorrelations, which keeps every polynomial stationary or
invertible; the plain and the seasonal polynomial are multiplied, so lag s + 1 has the product of
their coefficients and none of its own.
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

#: The largest partial autocorrelation, and cells of a block of series (rows times values times trial points).
LIMIT = 0.9999
CELLS = 4_000_000
STEADY = 1e-14
#: How far a parameter (as searched for) is moved to see whether the likelihood falls.
NUDGE = 1e-3


@dataclass(frozen=True)
class Order:
    """(p, d, q) and (P, D, Q) at period ``s``.  ``drift``: differences have a mean, which is the series' slope."""

    p: int
    d: int
    q: int
    sp: int = 0
    sd: int = 0
    sq: int = 0
    s: int = 1
    drift: bool = False

    @classmethod
    def of(cls, order, seasonal=(0, 0, 0, 1)) -> Order:
        return cls(*order, *seasonal)

    @property
    def gaps(self) -> list[int]:
        return [1] * self.d + [self.s] * self.sd

    @property
    def sizes(self) -> tuple[int, int, int, int]:
        return self.p, self.sp, self.q, self.sq

    @property
    def parameters(self) -> int:
        return sum(self.sizes)

    @property
    def has_mean(self) -> bool:
        return not self.gaps or self.drift

    def enough(self, count: int) -> bool:
        """Whether so many differenced values can bear the model: more than its parameters, mean and variance."""
        return count > self.parameters + self.has_mean + 1


def coefficients(partials: np.ndarray) -> np.ndarray:
    """Coefficients of stationary autoregressions, (order, N), from their partial autocorrelations."""
    out = np.zeros_like(partials)
    for k in range(len(partials)):
        out[:k] = out[:k] - partials[k] * out[:k][::-1]
        out[k] = partials[k]
    return out


def unfold(points: np.ndarray, order: Order) -> list[np.ndarray]:
    """The four coefficient tables (order, N) at the search's points (N, parameters): p, P, q, Q."""
    partials = LIMIT * np.sin(points.T)  # bounds are reached at finite points, where the search ends as fast as inside
    ends = np.cumsum([0, *order.sizes])
    parts = [coefficients(partials[a:b]) for a, b in zip(ends[:-1], ends[1:])]
    return [parts[0], parts[1], -parts[2], -parts[3]]


def multiply(own: np.ndarray, seasonal: np.ndarray, s: int, sign: int) -> np.ndarray:
    """Coefficients by lag of (1 + sign * own)(1 + sign * seasonal at multiples of s), times sign."""
    lags, count = len(own) + s * len(seasonal), own.shape[1]
    out = np.zeros((lags, count))
    out[: len(own)] = own
    for j in range(len(seasonal)):
        out[s * (j + 1) - 1] += seasonal[j]
        for i in range(len(own)):
            out[s * (j + 1) + i] += sign * own[i] * seasonal[j]
    return out


def _start(phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Stationary covariances (r, N) of the state with the value, for a variance of one."""
    r, count = phi.shape
    psi = np.zeros((r + 1, count))  # theta[0] is one; psi are the responses to a shock
    psi[0] = 1.0
    for k in range(1, r + 1):
        psi[k] = theta[k] if k < len(theta) else 0.0
        for j in range(1, k + 1):
            psi[k] += phi[j - 1] * psi[k - j]
    lags = np.arange(r + 1)
    left = np.zeros((count, r + 1, r + 1))
    left[:, lags, lags] = 1.0
    for k in lags:
        for j in range(1, r + 1):
            left[:, k, abs(k - j)] -= phi[j - 1]
    right = np.stack([sum(theta[j] * psi[j - k] for j in range(k, len(theta))) if k < len(theta) else np.zeros(count) for k in lags], 1)
    try:
        gamma = np.linalg.solve(left, right[:, :, None])[:, :, 0].T
    except np.linalg.LinAlgError:
        gamma = np.full((r + 1, count), np.nan)
    out = np.zeros((r, count))
    for i in range(1, r + 1):
        for j in range(i, r + 1):
            out[i - 1] += phi[j - 1] * gamma[j - i + 1]
        for j in range(i - 1, r):
            out[i - 1] += theta[j] * psi[j - i + 1]
    return out


def _move(state: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """The state one step on: its first element spreads by ``phi``, the others move up."""
    new = phi * state[0]
    new[:-1] += state[1:]
    return new


def run_filter(data: np.ndarray, lengths: np.ndarray, phi: np.ndarray, theta: np.ndarray, mean: bool):
    """Sums of the filter over series in the columns of ``data`` (longest first), each ``lengths`` long.

    Returns (sum of log F, sum of v v / F, v u / F, u u / F, state, state of a constant one) where v are
    the errors of one step, u those of a series of ones, and F their variances; all for a variance of one."""
    r = max(len(phi), len(theta) + 1, 1)
    count = data.shape[1]
    phi = np.vstack([phi, np.zeros((r - len(phi), count))])
    theta = np.vstack([np.ones(count), theta, np.zeros((r - 1 - len(theta), count))])
    cov = _start(phi, theta)
    variance = cov[0].copy()  # F
    change = _move(cov, phi)  # the covariance grows by change * scale * change' from step to step
    gain = change / variance
    scale = -1.0 / variance
    state, unit = np.zeros((r, count)), np.zeros((r, count))
    logs, vv, vu, uu = np.zeros((4, count))
    alive = (lengths[None, :] > np.arange(len(data))[:, None]).sum(axis=1)
    steady = False
    for t in range(len(data)):
        on = slice(0, int(alive[t]))
        f = variance[on]
        v = data[t, on] - state[0, on]
        vv[on] += v * v / f
        if not steady:
            logs[on] += np.log(f)
        state[:, on] = _move(state[:, on], phi[:, on]) + gain[:, on] * v
        if mean:
            u = 1.0 - unit[0, on]
            vu[on] += v * u / f
            uu[on] += u * u / f
            unit[:, on] = _move(unit[:, on], phi[:, on]) + gain[:, on] * u
        if steady:
            continue
        # variance, gain and change of the next step
        head = change[0, on].copy()
        weight = scale[on] * head
        new = f + weight * head
        moved = _move(change[:, on], phi[:, on])
        gain[:, on] = (gain[:, on] * f + moved * weight) / new
        scale[on] = scale[on] + weight * weight / f
        change[:, on] = moved - gain[:, on] * head
        variance[on] = new
        if t % 8 == 7 and (np.abs(scale[on]) * (change[:, on] ** 2).max(axis=0)).max(initial=0.0) < STEADY:
            steady = True
            logs += np.log(variance) * np.maximum(lengths - t - 1, 0)
    return logs, vv, vu, uu, state, unit


@dataclass
class Fit:
    """What the search found, one column a series: the four coefficient tables, mean, variance, log-likelihood and state.

    ``margin`` is how much of the log-likelihood the best of all small moves of one parameter loses; below
    zero, the search has not ended at a maximum."""

    tables: list[np.ndarray]
    mean: np.ndarray
    variance: np.ndarray
    loglik: np.ndarray
    phi: np.ndarray
    state: np.ndarray
    margin: np.ndarray


def difference(x: np.ndarray, gaps: list[int]) -> list[np.ndarray]:
    """The series after 0, 1, 2, ... of the given differences."""
    levels = [x]
    for gap in gaps:
        levels.append(levels[-1][gap:] - levels[-1][:-gap])
    return levels


def undo(levels: list[np.ndarray], gaps: list[int], ahead: np.ndarray) -> np.ndarray:
    """A forecast of the differenced series as one of the series itself: running sums at each gap."""
    for level, gap in zip(reversed(levels[:-1]), reversed(gaps)):
        rows = -(-len(ahead) // gap)
        padded = np.concatenate([ahead, np.zeros(rows * gap - len(ahead))]).reshape(rows, gap)
        ahead = (level[-gap:] + np.cumsum(padded, axis=0)).ravel()[: len(ahead)]
    return ahead


def fit(series: list[np.ndarray], order: Order) -> Fit:
    """Exact maximum likelihood of differenced series, longest first, each long enough for the model."""
    lengths = np.array([len(x) for x in series])
    center = np.array([x.mean() if order.has_mean else 0.0 for x in series])
    spread = np.array([np.sqrt(np.mean((x - c) ** 2)) for x, c in zip(series, center)])
    spread = np.where(spread > 0, spread, 1.0)
    data = np.zeros((int(lengths.max()), len(series)))
    for k, x in enumerate(series):
        data[: len(x), k] = (x - center[k]) / spread[k]

    def filtered(rows: np.ndarray, points: np.ndarray):
        p, sp, q, sq = tables = unfold(points, order)
        phi, theta = multiply(p, sp, order.s, -1), multiply(q, sq, order.s, 1)
        sums = run_filter(data[:, rows], lengths[rows], phi, theta, order.has_mean)
        logs, vv, vu, uu, state, unit = sums
        mean = vu / uu if order.has_mean else np.zeros(len(rows))
        variance = np.maximum((vv - mean * vu) / lengths[rows], 1e-20)
        return tables, phi, mean, variance, logs, state - mean * unit

    def objective(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        _, _, _, variance, logs, _ = filtered(rows, points)
        return 0.5 * (np.log(variance) + logs / lengths[rows])

    points, low = minimize(objective, len(series), start_points(order.parameters))
    every, moves = np.arange(len(series)), np.concatenate([np.eye(order.parameters), -np.eye(order.parameters)]) * NUDGE
    around = objective(np.repeat(every, len(moves)), (points[:, None] + moves).reshape(len(every) * len(moves), order.parameters))
    margin = lengths * (around.reshape(len(every), len(moves)) - low[:, None]).min(axis=1, initial=np.inf)
    tables, phi, mean, variance, logs, state = filtered(every, points)
    real = variance * spread**2
    loglik = -0.5 * (lengths * (np.log(2 * np.pi * real) + 1) + logs)
    return Fit(tables, center + mean * spread, real, loglik, phi, state * spread, margin)


def ahead(found: Fit, steps: int) -> np.ndarray:
    """(steps, N): expected values of the differenced series after its end."""
    phi = np.vstack([found.phi, np.zeros((len(found.state) - len(found.phi), len(found.mean)))])
    state, out = found.state, np.zeros((steps, len(found.mean)))
    for h in range(steps):
        out[h] = state[0] + found.mean
        state = _move(state, phi)
    return out


def blocks(lengths: np.ndarray, trials: int):
    """Indices of series of like length, longest first, so that all trial points of a block stay small."""
    order, at = np.argsort(-lengths, kind="stable"), 0
    while at < len(order):
        longest = int(lengths[order[at]])
        most = max(CELLS // (max(longest, 1) * trials), 1)
        part = order[at : at + most]
        part = part[lengths[part] * 2 >= longest]
        yield part
        at += len(part)


def fitted(values: list[np.ndarray], order: Order):
    """(indices, differenced levels, Fit) by block, for the series that can bear the model."""
    levels = {k: difference(v, order.gaps) for k, v in enumerate(values) if len(v) > sum(order.gaps) and np.isfinite(v).all()}
    able = [k for k, held in levels.items() if order.enough(len(held[-1]))]
    trials = max(len(start_points(order.parameters)), 2 * order.parameters, 7)
    for part in blocks(np.array([len(levels[k][-1]) for k in able], int), trials):
        index = [able[i] for i in part]
        yield index, [levels[k] for k in index], fit([levels[k][-1] for k in index], order)


def forecasts(values: list[np.ndarray], steps: list[int], order: Order) -> list[np.ndarray | None]:
    """Forecasts of each series; None for one too short for the model, or whose fit is not finite."""
    out: list[np.ndarray | None] = [None] * len(values)
    with np.errstate(all="ignore"):
        for index, levels, found in fitted(values, order):
            future = ahead(found, max(steps[k] for k in index))
            for column, (k, held) in enumerate(zip(index, levels)):
                each = undo(held, order.gaps, future[: steps[k], column])
                out[k] = each if np.isfinite(each).all() else None
    return out


def _arrays(column: pd.Series) -> list[np.ndarray]:
    return [np.asarray(v, dtype=float) for v in column]


def forecast_column(values: Column, steps: Column, order, seasonal=(0, 0, 0, 1)) -> Column:
    """Array of forecasts of each row's array of values; null where there is none."""
    model = Order.of(order, seasonal)

    def run(column: pd.Series, horizon: pd.Series) -> pd.Series:
        return pd.Series(forecasts(_arrays(column), [int(h) for h in horizon], model), dtype=object)

    return F.pandas_udf(run, "array<double>")(values, steps)


MODEL = "ar array<double>, seasonal_ar array<double>, ma array<double>, seasonal_ma array<double>, mean double, variance double, loglik double, margin double"


def model_column(values: Column, order, seasonal=(0, 0, 0, 1)) -> Column:
    """The fitted model of each row's array of values as a struct; null fields where there is none."""
    model = Order.of(order, seasonal)

    def run(column: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = [(None,) * 8] * len(column)
        with np.errstate(all="ignore"):
            for index, _, found in fitted(_arrays(column), model):
                for at, k in enumerate(index):
                    rows[k] = (*(t[:, at] for t in found.tables), found.mean[at], found.variance[at], found.loglik[at], found.margin[at])
        return pd.DataFrame(rows, columns=[part.split()[0] for part in MODEL.split(", ")])

    return F.pandas_udf(run, MODEL)(values)
