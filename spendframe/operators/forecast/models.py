"""The fitted models themselves, one row a series: coefficients, likelihoods and how well the optimum holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendframe.operators.forecast import closed_forms as cf
from spendframe.operators.forecast import likelihood, smoothing, sparse_trend
from spendframe.params import MIN_POINTS, require_columns


def _arrays(df: DataFrame, series_cols: Sequence[str], date_col: str, value_col: str, min_points: int) -> DataFrame:
    require_columns(df, [*series_cols, date_col, value_col])
    rows = df.select(*series_cols, date_col, value_col)
    numbered = cf.number_from_newest(rows, series_cols=series_cols, date_col=date_col, value_col=value_col)
    values, days = cf.values_oldest_first(F.col(value_col)), cf.days_oldest_first(F.col(date_col))
    arrays = numbered.groupBy(*series_cols).agg(values.alias("_values"), days.alias("_days"))
    return arrays.filter(F.size("_values") >= min_points)


def arma_models(
    df: DataFrame, order, seasonal=(0, 0, 0, 1), *, series_cols: Sequence[str] = (), date_col: str, value_col: str, min_points: int = MIN_POINTS
) -> DataFrame:
    """Series and ``ar, seasonal_ar, ma, seasonal_ma, mean, variance, loglik, margin`` of the exact fit.

    ``margin``: what the best small move of one parameter loses of the log-likelihood; null fields where
    the series is too short for the model."""
    arrays = _arrays(df, series_cols, date_col, value_col, min_points)
    return arrays.select(*series_cols, likelihood.model_column(F.col("_values"), order, seasonal).alias("_model")).select(*series_cols, "_model.*")


def trend_models(
    df: DataFrame,
    settings: sparse_trend.Settings = sparse_trend.Settings(),
    *,
    series_cols: Sequence[str] = (),
    date_col: str,
    value_col: str,
    min_points: int = MIN_POINTS,
) -> DataFrame:
    """Series and ``bends, variance, changepoint_limit, worst_subgradient`` of the trend with few bends."""
    arrays = _arrays(df, series_cols, date_col, value_col, min_points)
    model = sparse_trend.model_column(F.col("_values"), F.col("_days"), settings)
    return arrays.select(*series_cols, model.alias("_model")).select(*series_cols, "_model.*")


def smoothing_models(
    df: DataFrame, shape: smoothing.Shape = smoothing.Shape(), *, series_cols: Sequence[str] = (), date_col: str, value_col: str, min_points: int = MIN_POINTS
) -> DataFrame:
    """Series and ``alpha, beta, gamma, damping, first, error, fixed_error`` of the fitted smoothing."""
    arrays = _arrays(df, series_cols, date_col, value_col, min_points)
    return arrays.select(*series_cols, smoothing.model_column(F.col("_values"), shape).alias("_model")).select(*series_cols, "_model.*")
