"""Forecasts: fit one row of state per series, then unfold the horizon."""

from spendframe.operators.forecast.api import (
    fit,
    forecast_rows,
    forecast_table,
)
from spendframe.operators.forecast.options import ForecastOptions

__all__ = ["ForecastOptions", "fit", "forecast_rows", "forecast_table"]
