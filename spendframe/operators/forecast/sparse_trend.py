"""A trend that bends at few places, with Fourier seasons: the most probable one under a Laplace prior on its bends.

The trend is a line and hinges spread over the first 80 % of the history.  Minimised is

    |y - X b|^2 / 2 + variance * (sum |bend| / changepoint_scale + sum season^2 / (2 season_scale^2))

in values divided by the largest one, with ``variance`` the mean square of what is left, found by turns
with the rest.  Line and seasons are solved for exactly given the bends, so only the bends are searched:
by coordinate descent with soft thresholds over all series of a batch at once, then exactly on
places and signs, until every bend's subgradient is what it must be.  Most bends are exactly zero.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The most hinges, the part of the history they lie in, and (days, pairs) of the seasons.
HINGES, RANGE = 25, 0.8
SEASONS = {"yearly": (365.25, 10), "weekly": (7.0, 3), "daily": (1.0, 4)}
#: The least deviation left, as a part of the largest value: with none the penalties would vanish.
LEAST = 1e-3
SWEEPS, TURNS, CLOSE, ALIKE = 4000, 40, 1e-9, 1e-8


@dataclass(frozen=True)
class Settings:
    yearly: bool = True
    weekly: bool = False
    daily: bool = False
    changepoint_scale: float = 0.05
    season_scale: float = 10.0

    @property
    def seasons(self) -> list[tuple[float, int]]:
        return [SEASONS[name] for name in SEASONS if getattr(self, name)]


def hinges(count: int, settings: Settings) -> np.ndarray:
    """Places of the bends, as parts of the history; none for an infinite scale, which asks for no prior."""
    if not np.isfinite(settings.changepoint_scale):
        return np.empty(0)
    return np.linspace(0.0, RANGE, min(HINGES, max(count - 2, 0)) + 2)[1:-1]


def design(at: np.ndarray, first: float, span: float, bends: np.ndarray, settings: Settings) -> np.ndarray:
    """Columns: one, time, Fourier pairs, then the hinges."""
    t = (at - first) / span
    columns = [np.ones_like(t), t]
    for length, pairs in settings.seasons:
        for k in range(1, pairs + 1):
            angle = 2.0 * np.pi * k * at / length
            columns += [np.sin(angle), np.cos(angle)]
    return np.column_stack([*columns, *(np.maximum(t - h, 0.0) for h in bends)])


def subgradient(gram: np.ndarray, right: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How far each bend is from its optimality condition, as a part of ``limit``: a bend that is not zero
    has slope ``limit`` with its sign, any other a slope of at most ``limit``."""
    slope = right - np.einsum("nij,nj->ni", gram, b)
    off = np.where(b != 0, np.abs(slope - np.sign(b) * limit[:, None]), np.maximum(np.abs(slope) - limit[:, None], 0.0))
    return off / limit[:, None]


def _exact(gram: np.ndarray, right: np.ndarray, limit: float, b: np.ndarray) -> np.ndarray | None:
    """The minimum of one series from a point near it, by active signs: bends with a sign are solved for
    exactly; where a sign would turn, the lowest point on the way is taken; then the bend whose slope
    breaks its limit most gets a sign.  Each solve lowers the objective, so it ends; None if singular."""
    b, signs = b.copy(), np.sign(b)

    def cost(x: np.ndarray) -> np.ndarray:
        return 0.5 * np.einsum("ki,ij,kj->k", x, gram, x) - x @ right + limit * np.abs(x).sum(axis=1)

    for _ in range(20 * len(b) + 20):
        on = np.flatnonzero(signs)
        if len(on):
            try:
                goal = np.linalg.solve(gram[np.ix_(on, on)], right[on] - limit * signs[on])
            except np.linalg.LinAlgError:
                return None
            if (goal * signs[on] > 0).all():
                b[:] = 0.0
                b[on] = goal
            else:
                with np.errstate(all="ignore"):
                    stops = b[on] / (b[on] - goal)
                stops = np.append(stops[(stops > 0) & (stops < 1)], 1.0)
                ways = np.zeros((len(stops), len(b)))
                ways[:, on] = b[on] + stops[:, None] * (goal - b[on])
                ways[np.abs(ways) < 1e-14] = 0.0
                b = ways[cost(ways).argmin()]
                signs = np.sign(b)
                continue
        slope = right - gram @ b
        off = np.where(signs == 0, np.abs(slope) - limit, 0.0)
        worst_at = int(off.argmax())
        if off[worst_at] <= limit * CLOSE / 2:
            return b
        signs[worst_at] = np.sign(slope[worst_at])
    return None


def lasso(gram: np.ndarray, right: np.ndarray, limit: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """(N, m) minima of b' gram b / 2 - right' b + limit |b|_1, all N at once."""
    n, m = right.shape
    b = np.zeros((n, m)) if start is None else start.copy()
    if not m:
        return b
    diagonal = gram[:, np.arange(m), np.arange(m)]
    diagonal = np.where(diagonal > 0, diagonal, 1.0)
    slope = right - np.einsum("nij,nj->ni", gram, b)
    on = np.arange(n)
    for sweep in range(SWEEPS):
        for j in range(m):
            old = b[on, j]
            pull = slope[on, j] + diagonal[on, j] * old
            new = np.sign(pull) * np.maximum(np.abs(pull) - limit[on], 0.0) / diagonal[on, j]
            step = new - old
            if step.any():
                slope[on] -= gram[on, :, j] * step[:, None]
                b[on, j] = new
        if sweep % 50 == 4:  # places and signs are nearly those of the minimum by now
            for k in on:
                tried = _exact(gram[k], right[k], float(limit[k]), b[k])
                if tried is not None:
                    b[k] = tried
            on = on[subgradient(gram[on], right[on], b[on], limit[on]).max(axis=1) >= CLOSE]
            if not len(on):
                break
            slope = right - np.einsum("nij,nj->ni", gram, b)
    return b


@dataclass
class Trend:
    """A fitted series: coefficients of ``design``'s columns in units of ``scale``; ``limit``: the slope a bend must have."""

    first: float
    span: float
    bends: np.ndarray
    scale: float
    coefficients: np.ndarray
    variance: float
    limit: float

    def at(self, days: np.ndarray, settings: Settings) -> np.ndarray:
        return design(days, self.first, self.span, self.bends, settings) @ self.coefficients * self.scale

    @property
    def bent(self) -> np.ndarray:
        return self.coefficients[len(self.coefficients) - len(self.bends) :]


def _span(x: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An orthonormal basis of the columns of ``x`` with a ridge below them, and the map from it to coefficients."""
    u, s, v = np.linalg.svd(np.vstack([x, np.diag(np.sqrt(penalty))]), full_matrices=False)
    keep = s > 1e-10 * s[0]
    return u[:, keep], v[keep].T / s[keep]


def fit(values: list[np.ndarray], days: list[np.ndarray], settings: Settings) -> list[Trend]:
    """Trends of series of any length (one value at least), with the same settings."""
    work = []
    for v, at in zip(values, days):
        span, scale = max(float(at[-1] - at[0]), 1.0), float(np.abs(v).max()) or 1.0
        bends = hinges(len(v), settings)
        work.append((design(at, float(at[0]), span, bends, settings), v / scale, float(at[0]), span, bends, scale))
    out: list[Trend | None] = [None] * len(work)
    groups: dict[int, list[int]] = {}
    for k, row in enumerate(work):
        groups.setdefault(len(row[4]), []).append(k)
    for count, rows in groups.items():
        _fit_alike(work, rows, count, settings, out)
    return out


def _fit_alike(work, rows, count, settings: Settings, out) -> None:
    """Fits series with the same number of bends."""
    n = len(rows)
    free = work[rows[0]][0].shape[1] - count  # line and seasons
    lengths = np.array([len(work[k][1]) for k in rows])
    ridge = np.zeros(free)
    ridge[2:] = 0.0 if np.isinf(settings.season_scale) else settings.season_scale**-2.0
    variance = np.empty(n)
    for i, k in enumerate(rows):
        x, y = work[k][:2]
        line = x[:, :2]
        variance[i] = max(float(np.mean((y - line @ np.linalg.lstsq(line, y, rcond=None)[0]) ** 2)), LEAST**2)
    bends = np.zeros((n, count))
    coefficients = np.zeros((n, free + count))
    limit = variance / settings.changepoint_scale
    for _ in range(TURNS):
        limit = variance / settings.changepoint_scale
        gram, right, solved = np.zeros((n, count, count)), np.zeros((n, count)), []
        for i, k in enumerate(rows):
            x, y = work[k][:2]
            basis, back = _span(x[:, :free], ridge * variance[i])
            below = np.zeros((free, count + 1))
            whole = np.vstack([np.column_stack([x[:, free:], y]), below])
            whole = whole - basis @ (basis.T @ whole)  # what line and seasons can't say
            bent, rest = whole[:, :count], whole[:, count]
            gram[i], right[i] = bent.T @ bent, bent.T @ rest
            idle = np.diag(gram[i]) <= ALIKE * (x[:, free:] ** 2).sum(axis=0)
            gram[i, idle], gram[i, :, idle], right[i, idle] = 0.0, 0.0, 0.0
            solved.append((basis, back))
        bends = lasso(gram, right, limit, bends) if count else bends
        new = np.empty(n)
        for i, k in enumerate(rows):
            x, y = work[k][:2]
            rest = y - x[:, free:] @ bends[i]
            basis, back = solved[i]
            beta = back @ (basis[: len(rest)].T @ rest)
            coefficients[i] = np.concatenate([beta, bends[i]])
            new[i] = max(float(np.mean((rest - x[:, :free] @ beta) ** 2)), LEAST**2)
        settled = np.abs(new - variance) <= 1e-6 * variance
        if settled.all():
            break
        variance = np.where(settled, variance, new)
    for i, k in enumerate(rows):
        _, _, first, span, places, scale = work[k]
        out[k] = Trend(first, span, places, scale, coefficients[i].copy(), float(variance[i]), float(limit[i]))


def _floats(column: pd.Series) -> list[np.ndarray]:
    return [np.asarray(v, dtype=float) for v in column]


def trend_column(values: Column, days: Column, future: Column, settings: Settings) -> Column:
    """Values of the fitted trend and seasons at ``future`` (days as numbers), one array a row; null without values."""

    def run(column: pd.Series, dates: pd.Series, wanted: pd.Series) -> pd.Series:
        v, at, to = _floats(column), _floats(dates), _floats(wanted)
        able = [k for k in range(len(v)) if len(v[k]) and np.isfinite(v[k]).all()]
        out: list = [None] * len(v)
        for k, trend in zip(able, fit([v[k] for k in able], [at[k] for k in able], settings)):
            found = trend.at(to[k], settings)
            out[k] = found if np.isfinite(found).all() else None
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<double>")(values, days, future)


MODEL = "bends array<double>, variance double, changepoint_limit double, worst_subgradient double"


def model_column(values: Column, days: Column, settings: Settings) -> Column:
    """The bends of each row's series (as parts of its largest value), and how far the worst is from its condition."""

    def run(column: pd.Series, dates: pd.Series) -> pd.DataFrame:
        v, at = _floats(column), _floats(dates)
        able = [k for k in range(len(v)) if len(v[k]) and np.isfinite(v[k]).all()]
        rows: list[tuple] = [(None,) * 4] * len(v)
        for k, trend in zip(able, fit([v[k] for k in able], [at[k] for k in able], settings)):
            rows[k] = (trend.bent, trend.variance, trend.limit, worst(v[k], at[k], trend, settings))
        return pd.DataFrame(rows, columns=[part.split()[0] for part in MODEL.split(", ")])

    return F.pandas_udf(run, MODEL)(values, days)


def worst(v: np.ndarray, at: np.ndarray, trend: Trend, settings: Settings) -> float:
    """The largest breach of a bend's condition, from the residuals themselves, as a part of the limit."""
    if not len(trend.bends):
        return 0.0
    x = design(at, trend.first, trend.span, trend.bends, settings)
    slope = x[:, -len(trend.bends) :].T @ (v / trend.scale - x @ trend.coefficients)
    b = trend.bent
    off = np.where(b != 0, np.abs(slope - np.sign(b) * trend.limit), np.maximum(np.abs(slope) - trend.limit, 0.0))
    return float((off / trend.limit).max())
