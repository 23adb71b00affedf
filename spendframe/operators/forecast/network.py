"""A small autoregressive network with trend and season terms, one for each series, trained together.

    value = line + hinges + Fourier pairs + net(what the last values differ from that by)

The net is a line plus one hidden layer of ``tanh`` over the last ``lags`` differences.  All parts are
trained at once: the squared error of one step ahead, with gradients worked out by hand, by Adam
over whole series.  Every series has its own weights and starts from the same ones; series of equal
length take each step in one array operation, and none changes another's result.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cells of a block: series times values times lags.
CELLS = 4_000_000


@dataclass(frozen=True)
class Shape:
    """Settings of the network and its training; ``decay`` and ``season_decay`` are weights of squared coefficients."""

    lags: int = 14
    hidden: int = 6
    hinges: int = 6
    yearly: bool = True
    weekly: bool = False
    daily: bool = False
    rounds: int = 300
    rate: float = 0.03
    decay: float = 1e-3
    season_decay: float = 1e-3

    @property
    def seasons(self) -> list[tuple[float, int]]:
        chosen = ((self.yearly, 365.25, 6), (self.weekly, 7.0, 3), (self.daily, 1.0, 3))
        return [(length, pairs) for on, length, pairs in chosen if on]

    def fitting(self, count: int) -> Shape | None:
        """The shape for a series of ``count`` values: fewer lags where it is short, none below four values."""
        lags = min(self.lags, count // 4)
        return None if lags < 1 else Shape(**{**self.__dict__, "lags": lags})


def features(at: np.ndarray, first: float, span: float, shape: Shape) -> np.ndarray:
    t = (at - first) / span
    columns = [np.ones_like(t), t, *(np.maximum(t - h, 0.0) for h in np.linspace(0, 0.8, shape.hinges + 2)[1:-1])]
    for length, pairs in shape.seasons:
        for k in range(1, pairs + 1):
            angle = 2.0 * np.pi * k * at / length
            columns += [np.sin(angle), np.cos(angle)]
    return np.stack(columns, axis=-1)


Weights = dict[str, np.ndarray]


def start(x: np.ndarray, y: np.ndarray, shape: Shape) -> Weights:
    """Ridge regression for the terms in time, a fixed spread of small weights for the net."""
    n, k = len(y), x.shape[-1]
    gram = np.swapaxes(x, 1, 2) @ x + 1e-2 * np.eye(k)
    terms = np.linalg.solve(gram, np.swapaxes(x, 1, 2) @ y[..., None])[..., 0]
    spread = np.cos(1.0 + np.arange(shape.lags * shape.hidden)).reshape(shape.lags, shape.hidden) / np.sqrt(shape.lags)
    return {
        "terms": terms,
        "line": np.zeros((n, shape.lags)),
        "inner": np.tile(0.5 * spread, (n, 1, 1)),
        "shift": np.zeros((n, shape.hidden)),
        "outer": np.full((n, shape.hidden), 0.1) * np.cos(np.arange(shape.hidden) * 2.0),
    }


def net(rest: np.ndarray, w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """What the net says after windows (N, T, lags) of differences, oldest first; and its hidden values."""
    hidden = np.tanh(rest @ w["inner"] + w["shift"][:, None])
    return (rest @ w["line"][..., None])[..., 0] + (hidden @ w["outer"][..., None])[..., 0], hidden


def loss_and_gradient(x: np.ndarray, y: np.ndarray, w: Weights, shape: Shape) -> tuple[np.ndarray, Weights]:
    """Loss of each series and its gradient."""
    lags, count = shape.lags, y.shape[1]
    rest = y - (x @ w["terms"][..., None])[..., 0]
    windows = sliding_window_view(rest, lags, axis=1)[:, :-1]
    said, hidden = net(windows, w)
    error = rest[:, lags:] - said
    share = 2.0 / error.shape[1]
    pull = share * error  # d loss / d error
    back = pull[..., None] * (1.0 - hidden**2) * w["outer"][:, None]
    to_window = back @ np.swapaxes(w["inner"], 1, 2) + pull[..., None] * w["line"][:, None]
    to_rest = np.zeros_like(rest)
    to_rest[:, lags:] = pull
    for j in range(lags):
        to_rest[:, j : count - lags + j] -= to_window[:, :, j]
    held = np.full(x.shape[-1], shape.season_decay)
    held[:2] = 0.0
    gradient = {
        "terms": -(np.swapaxes(x, 1, 2) @ to_rest[..., None])[..., 0] + 2 * held * w["terms"],
        "line": -(np.swapaxes(windows, 1, 2) @ pull[..., None])[..., 0] + 2 * shape.decay * w["line"],
        "inner": -np.swapaxes(windows, 1, 2) @ back + 2 * shape.decay * w["inner"],
        "shift": -back.sum(axis=1),
        "outer": -(np.swapaxes(hidden, 1, 2) @ pull[..., None])[..., 0] + 2 * shape.decay * w["outer"],
    }
    size = (held * w["terms"] ** 2).sum(axis=1)
    size += shape.decay * sum((w[name] ** 2).reshape(len(y), -1).sum(axis=1) for name in ("line", "inner", "outer"))
    return (error**2).mean(axis=1) + size, gradient


def train(x: np.ndarray, y: np.ndarray, shape: Shape) -> tuple[Weights, np.ndarray]:
    """Weights with the lowest loss met, and that loss."""
    w = start(x, y, shape)
    first = {name: np.zeros_like(v) for name, v in w.items()}
    second = {name: np.zeros_like(v) for name, v in w.items()}
    best, low = {name: v.copy() for name, v in w.items()}, np.full(len(y), np.inf)
    for step in range(1, shape.rounds + 1):
        loss, gradient = loss_and_gradient(x, y, w, shape)
        better = loss < low
        low[better] = loss[better]
        for name in w:
            best[name][better] = w[name][better]
        rate = shape.rate * (1 + np.cos(np.pi * step / shape.rounds)) / 2
        for name, g in gradient.items():
            first[name] += 0.1 * (g - first[name])
            second[name] += 0.001 * (g * g - second[name])
            w[name] = w[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return best, low


def forecast(values: np.ndarray, days: np.ndarray, future: np.ndarray, shape: Shape) -> np.ndarray:
    """(N, steps) forecasts of series (N, T) of equal length, after ``days`` (N, T), at ``future`` (N, steps)."""
    middle, spread = values.mean(axis=1, keepdims=True), values.std(axis=1, keepdims=True)
    spread = np.where(spread > 0, spread, 1.0)
    y = (values - middle) / spread
    frames = [(d[0], max(d[-1] - d[0], 1.0)) for d in days]
    x = np.stack([features(d, *f, shape) for d, f in zip(days, frames)])
    w, _ = train(x, y, shape)
    rest = y - (x @ w["terms"][..., None])[..., 0]
    bound = np.abs(rest).max(axis=1)  # a net fed by itself must not leave what it has seen
    window = rest[:, -shape.lags :]
    after = np.stack([features(f, *frame, shape) for f, frame in zip(future, frames)])
    out = (after @ w["terms"][..., None])[..., 0]
    for h in range(future.shape[1]):
        said = np.clip(net(window[:, None], w)[0][:, 0], -bound, bound)
        out[:, h] += said
        window = np.concatenate([window[:, 1:], said[:, None]], axis=1)
    return middle + spread * out


def forecast_column(values: Column, days: Column, future: Column, shape: Shape) -> Column:
    """Array of forecasts of each row's series at ``future``; null for fewer than four values, or one that is not finite."""

    def run(column: pd.Series, dates: pd.Series, wanted: pd.Series) -> pd.Series:
        out: list = [None] * len(column)
        alike: dict[tuple[int, int], list[int]] = {}
        for k, (v, to) in enumerate(zip(column, wanted)):
            if shape.fitting(len(v)) is not None and np.isfinite(np.asarray(v, dtype=float)).all():
                alike.setdefault((len(v), len(to)), []).append(k)
        for (count, _), rows in alike.items():
            own = shape.fitting(count)
            most = max(CELLS // (count * own.lags), 1)
            for part in (rows[at : at + most] for at in range(0, len(rows), most)):
                stacks = [np.stack([np.asarray(c[k], dtype=float) for k in part]) for c in (column, dates, wanted)]
                for k, found in zip(part, forecast(*stacks, own)):
                    out[k] = found if np.isfinite(found).all() else None
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<double>")(values, days, future)
