"""Forecast settings."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from spendframe.params import FORECAST_METHODS, MIN_POINTS, choice, model_order

# Which model family each lag-model name stands for
DARTS_FAMILIES = {
    "exponential_smoothing": "smoothing",
    "arima": "arima",
    "auto_arima": "auto_order",
    "theta": "seasonal_theta",
    "linear_regression": "lag_linear",
    "random_forest": "lag_forest",
    "xgboost": "lag_gbt",
}
ALWAYS_ON = ("sma", "es", "hw", "theta")


@dataclass(frozen=True)
class ForecastOptions:  # default values are fixed values
    """Defaults give the four closed-form methods; other columns exist but stay missing.

    ``darts_algorithm`` switches the ``darts`` column on and picks its model family; an unknown
    name falls back to exponential smoothing with a warning.

    ``arma_estimator``: "likelihood" (exact, by a Kalman filter) or "least_squares" (two stages, every
    lag of a seasonal product free).  ``first_stage_lags``, of the latter: lags beyond the model's own in
    the autoregression that estimates the shocks.  A series too short for the model has no forecast.
    ``max_order`` and ``max_differences`` bound the automatic order, ``auto_seasonal_periods`` is its season
    (1: none).  ``smoothing_periods``, ``smoothing_damped`` and ``theta_periods`` shape the ``darts``
    column's fitted smoothing and its theta method, which takes a season out where a test finds one.
    ``yearly``, ``weekly`` and ``daily`` are obeyed whatever the history's length (daily terms are
    constant on daily series).  ``network_lags`` are those of the trained network (fewer on a series of
    under four times as many rows); with ``network_trained`` off its column has constant series only.  ``trees`` and ``tree_depth`` shape the boosted trees, ``trees`` and
    ``forest_depth`` the forest; both are one model over all series: adding one changes the others' forecasts.
    """

    methods: tuple[str, ...] = ALWAYS_ON
    ensemble: bool = False
    darts_algorithm: str | None = None
    min_points: int = MIN_POINTS
    sma_window: int = 7
    es_alpha: float = 0.5
    hw_alpha: float = 0.3
    hw_beta: float = 0.1
    hw_gamma: float = 0.1
    hw_seasonal_periods: int = 12
    theta: float = 2.0
    arima_order: tuple[int, ...] | str = (1, 1, 1)
    sarima_order: tuple[int, ...] | str = (1, 1, 1)
    sarima_seasonal_order: tuple[int, ...] | str = (1, 1, 1, 12)
    arma_estimator: str = "likelihood"
    first_stage_lags: int = 1
    max_order: int = 2
    max_differences: int = 2
    auto_seasonal_periods: int = 1
    smoothing_periods: int = 12
    smoothing_damped: bool = False
    theta_periods: int = 12
    yearly: bool = True
    weekly: bool = False
    daily: bool = False
    changepoint_scale: float = 0.05
    season_scale: float = 10.0
    network_trained: bool = True
    network_lags: int = 14
    lags: int = 12
    trees: int = 20
    tree_depth: int = 5
    forest_depth: int = 10

    def __post_init__(self):
        for method in self.methods:
            choice(method, FORECAST_METHODS, "method")
        for name, length in (("arima_order", 3), ("sarima_order", 3), ("sarima_seasonal_order", 4)):
            object.__setattr__(self, name, model_order(getattr(self, name), length))
        choice(self.arma_estimator, ("likelihood", "least_squares"), "arma_estimator")
        for name in ("es_alpha", "hw_alpha", "hw_beta", "hw_gamma"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must lie between 0 and 1")
        counts = ("sma_window", "min_points", "network_lags", "lags", "trees", "tree_depth", "forest_depth")
        periods = ("hw_seasonal_periods", "auto_seasonal_periods", "smoothing_periods", "theta_periods")
        for name in (*counts, *periods):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.darts_algorithm is not None:
            if self.darts_algorithm not in DARTS_FAMILIES:
                warnings.warn(
                    f"unknown lag model {self.darts_algorithm!r}; using exponential_smoothing", stacklevel=2
                )
                object.__setattr__(self, "darts_algorithm", "exponential_smoothing")
            if "darts" not in self.methods:
                object.__setattr__(self, "methods", (*self.methods, "darts"))

    @property
    def darts_family(self) -> str | None:
        return DARTS_FAMILIES.get(self.darts_algorithm or "")
