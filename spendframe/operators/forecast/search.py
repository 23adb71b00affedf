"""A quasi-Newton search for many small problems at once.

All problems of a block take each step together: gradients by central differences and a ladder of step
lengths are further rows of one call of the objective, so its cost is that of the array operations.
Finished problems leave the block.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LADDER = 0.3 ** np.arange(7)
NUDGE = 1e-5


def start_points(count: int, spread: float = 0.8, most: int = 64) -> np.ndarray:
    """Points to start from: zero first, then all of {-spread, 0, spread} where few, else an even sequence."""
    if count == 0:
        return np.zeros((1, 0))
    if 3**count <= most:
        grid = np.stack(np.meshgrid(*[[0.0, -spread, spread]] * count, indexing="ij"), -1).reshape(-1, count)
        return grid
    # Kronecker's sequence: multiples of roots of one number, modulo one
    root = 2.0
    for _ in range(60):
        root = (1 + root) ** (1 / (count + 1))
    steps = root ** -np.arange(1.0, count + 1)
    points = (np.arange(1, most)[:, None] * steps) % 1.0
    return np.vstack([np.zeros(count), (2 * points - 1) * spread])


def minimize(
    objective: Callable[[np.ndarray, np.ndarray], np.ndarray], problems: int, starts: np.ndarray, *, rounds: int = 80, enough: float = 1e-13
) -> tuple[np.ndarray, np.ndarray]:
    """(points, values): the lowest point found for each problem.

    ``objective(rows, points)`` gives the value of problem ``rows[i]`` at ``points[i]``; rows never fall.
    ``starts`` is one set of points for all problems, or one for each.  Values that are not finite count as infinite."""

    def value(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            found = objective(rows, points)
        return np.where(np.isfinite(found), found, np.inf)

    every = np.arange(problems)
    grid = np.broadcast_to(starts, (problems, *starts.shape[-2:]))
    count, k = grid.shape[1:]
    first = value(np.repeat(every, count), grid.reshape(problems * count, k)).reshape(problems, count)
    best = first.argmin(axis=1)
    x, f = grid[every, best].copy(), first[every, best]
    if k == 0:
        return x, f

    def gradient(rows: np.ndarray) -> np.ndarray:
        moves = np.concatenate([np.eye(k), -np.eye(k)]) * NUDGE
        around = value(np.repeat(rows, 2 * k), (x[rows][:, None] + moves).reshape(-1, k)).reshape(len(rows), 2, k)
        slope = (around[:, 0] - around[:, 1]) / (2 * NUDGE)
        return np.where(np.isfinite(slope), slope, 0.0)

    curve = np.tile(np.eye(k), (problems, 1, 1))  # inverse Hessians
    fresh = np.ones(problems, bool)
    g = np.zeros((problems, k))
    on = every[np.isfinite(f)]
    if len(on):
        g[on] = gradient(on)
    for _ in range(rounds):
        on = on[np.abs(g[on]).max(axis=1) > 1e-9] if len(on) else on
        if not len(on):
            break
        way = -np.einsum("nij,nj->ni", curve[on], g[on])
        uphill = (way * g[on]).sum(axis=1) >= 0
        way[uphill] = -g[on][uphill]
        curve[on[uphill]] = np.eye(k)
        way /= np.maximum(1.0, np.linalg.norm(way, axis=1) / 2)[:, None]
        tried = x[on][:, None] + LADDER[:, None] * way[:, None, :]
        found = value(np.repeat(on, len(LADDER)), tried.reshape(-1, k)).reshape(len(on), -1)
        low = found.argmin(axis=1)
        gain = f[on] - found[np.arange(len(on)), low]
        moved = gain > 0
        stay = on[~moved]
        again = stay[~fresh[stay]]  # a stale curvature may point nowhere; steepest descent has a try
        curve[again], fresh[again] = np.eye(k), True
        go = on[moved]
        step = tried[np.flatnonzero(moved), low[moved]] - x[go]
        x[go] += step
        f[go] -= gain[moved]
        old = g[go].copy()
        if len(go):
            g[go] = gradient(go)
        change = g[go] - old
        bend = (step * change).sum(axis=1)
        good = bend > 1e-14
        rows, s, y, b = go[good], step[good], change[good], bend[good]
        left = np.eye(k) - s[:, :, None] * y[:, None, :] / b[:, None, None]
        curve[rows] = left @ curve[rows] @ left.transpose(0, 2, 1) + s[:, :, None] * s[:, None, :] / b[:, None, None]
        fresh[rows] = False
        on = np.sort(np.concatenate([again, go[gain[moved] > enough * (1 + np.abs(f[go]))]]))
    return x, f
