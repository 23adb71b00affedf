"""Fit all methods in one pass, then unfold the horizon.

Plan for every closed-form method together: exchange by series, one sort, one window, one
aggregate (it reuses that partitioning), then a generator over the horizon.  Model columns from
``numeric`` and ``trees`` ride along as arrays on the same row, so they add no exchange either.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.functions.dates import forecast_day
from spendframe.functions.numbers import mean_of_present, nan_to_null
from spendframe.operators.clean import long_enough, share_source
from spendframe.operators.forecast import closed_forms as cf
from spendframe.operators.forecast import auto_order, direct, likelihood, network, numeric, smoothing, sparse_trend
from spendframe.operators.forecast.options import ForecastOptions
from spendframe.operators.spine import GRAIN, LAST, grain_of, horizon
from spendframe.params import FORECAST_COLUMNS, FORECAST_METHODS, require_columns
from spendframe.session import settle, shared_folder

STEP, HORIZON, VALUES, DAYS, TRAINED = "step", "_horizon", "_values", "_days", "_trained"
_ARRAY_METHODS = ("arima", "sarima", "prophet", "neural_prophet")
_TRAINED_FAMILIES = ("lag_forest", "lag_gbt")
_MODEL_FAMILIES = ("arima", "auto_order", "lag_linear", "smoothing", "seasonal_theta", *_TRAINED_FAMILIES)


def _uses(options: ForecastOptions, *names: str) -> bool:
    return any(name in options.methods or name == options.darts_family for name in names)


def _needs_values(options: ForecastOptions) -> bool:
    return _uses(options, "hw", *_ARRAY_METHODS, *_MODEL_FAMILIES)


def fit(
    df: DataFrame,
    options: ForecastOptions = ForecastOptions(),
    *,
    series_cols: Sequence[str] = (),
    date_col: str,
    value_col: str,
) -> DataFrame:
    """One row per series with at least ``min_points`` rows: grain, last date and model state."""
    require_columns(df, [*series_cols, date_col, value_col])
    rows = df.select(*series_cols, date_col, value_col)
    if options.darts_family in _TRAINED_FAMILIES and shared_folder(df.sparkSession):
        rows = settle(rows)  # training reads the series several times, and the fit once more
    numbered = cf.number_from_newest(rows, series_cols=series_cols, date_col=date_col, value_col=value_col)
    date, value = F.col(date_col), F.col(value_col)
    state: dict[str, Column] = {
        LAST: F.max(date),
        GRAIN: grain_of(date, F.col(cf.PREVIOUS)),
        "row_count": F.count(F.lit(1)),
    }
    if _uses(options, "sma"):
        state["sma_level"] = cf.moving_average(value, options.sma_window)
    if _uses(options, "es"):
        state["es_level"] = cf.smoothed_level(value, options.es_alpha)
    if _uses(options, "hw"):
        state["hw_level"] = cf.smoothed_level(value, options.hw_alpha)
    if _uses(options, "theta"):
        state.update(cf.theta_state(value))
    if _uses(options, "neural_prophet"):
        state["constant_value"] = cf.constant_or_null(value)
    if _needs_values(options):
        state[VALUES] = cf.values_oldest_first(value)
    if _uses(options, "prophet", "neural_prophet"):
        state[DAYS] = cf.days_oldest_first(date)

    fitted = numbered.groupBy(*series_cols).agg(*[column.alias(name) for name, column in state.items()])
    fitted = fitted.filter(F.col("row_count") >= options.min_points).withColumn(HORIZON, horizon(F.col(GRAIN)))
    if options.darts_family == "auto_order":
        fitted = auto_order.choose(
            fitted, series_cols=series_cols, values=VALUES, steps=HORIZON,
            max_order=options.max_order, max_differences=options.max_differences, period=options.auto_seasonal_periods,
        )
    if options.darts_family in _TRAINED_FAMILIES:
        fitted = _with_trained(fitted, options, series_cols)
    models = _model_columns(options)
    return fitted.withColumns(models).drop(VALUES, DAYS, auto_order.FORECAST, TRAINED)


def trend_settings(options: ForecastOptions) -> sparse_trend.Settings:
    return sparse_trend.Settings(options.yearly, options.weekly, options.daily, options.changepoint_scale, options.season_scale)


def _arma_column(options: ForecastOptions, order, seasonal=(0, 0, 0, 1)) -> Column:
    values, steps = F.col(VALUES), F.col(HORIZON)
    if options.arma_estimator == "likelihood":
        return likelihood.forecast_column(values, steps, order, seasonal)
    return numeric.sarima_column(values, steps, order, seasonal, options.first_stage_lags)


def _with_trained(fitted: DataFrame, options: ForecastOptions, series_cols: Sequence[str]) -> DataFrame:
    """The forecasts of one tree model over all series; training runs its jobs here."""
    names = {"values": VALUES, "steps": HORIZON, "lags": options.lags}
    rows = direct.design_rows(fitted, series_cols=series_cols, **names)
    # each level or tree reads the rows again
    rows = settle(rows) if shared_folder(fitted.sparkSession) else rows.persist()
    if options.darts_family == "lag_gbt":
        settings = direct.Boosting(options.trees, options.tree_depth)
        model = direct.train_boosting(rows, settings)
        return fitted.withColumn(TRAINED, direct.boosting_column(model, F.col(VALUES), F.col(HORIZON), options.lags, settings))
    if rows.isEmpty():
        return fitted.withColumn(TRAINED, F.lit(None).cast("array<double>"))
    model = direct.train_forest(rows, series_cols, trees=options.trees, depth=options.forest_depth)
    keys = list(series_cols) or ["_all"]
    if not series_cols:  # one series: both sides have one row
        fitted = fitted.withColumn("_all", F.lit(0))
    found = direct.forest_forecasts(model, fitted, series_cols=keys, **names)
    found = found.select(*[F.col(c).alias(f"_of_{c}") for c in keys], F.col("_forecast").alias(TRAINED))
    joined = fitted.join(found, [F.col(f"_of_{c}").eqNullSafe(F.col(c)) for c in keys], "left")
    return joined.drop("_all", *[f"_of_{c}" for c in keys])


def _model_columns(options: ForecastOptions) -> dict[str, Column]:
    """Columns computed from the value array: Holt-Winters state and the array forecasts."""
    values, steps = F.col(VALUES), F.col(HORIZON)
    columns: dict[str, Column] = {}
    if _uses(options, "hw"):
        columns["hw_state"] = numeric.holt_winters_column(
            values, options.hw_alpha, options.hw_beta, options.hw_gamma, options.hw_seasonal_periods
        )
    if "arima" in options.methods:
        columns["_arima"] = _arma_column(options, options.arima_order)
    if "sarima" in options.methods:
        columns["_sarima"] = _arma_column(options, options.sarima_order, options.sarima_seasonal_order)
    future = F.transform(F.sequence(F.lit(1), steps), lambda h: F.unix_date(forecast_day(F.col(LAST), h, F.col(GRAIN))))
    if "neural_prophet" in options.methods:
        shape = network.Shape(lags=options.network_lags, yearly=options.yearly, weekly=options.weekly, daily=options.daily)
        constant = F.transform(F.sequence(F.lit(1), steps), lambda _: F.col("constant_value"))
        trained = network.forecast_column(values, F.col(DAYS), future, shape)
        kept = F.when(F.col("constant_value").isNotNull(), constant)
        columns["_neural_prophet"] = kept.otherwise(trained) if options.network_trained else kept
    if "prophet" in options.methods:
        columns["_prophet"] = sparse_trend.trend_column(values, F.col(DAYS), future, trend_settings(options))
    family = options.darts_family
    if family == "arima":
        columns["_darts"] = _arma_column(options, (1, 1, 1))
    elif family == "auto_order":
        columns["_darts"] = F.col(auto_order.FORECAST)
    elif family == "smoothing":
        shape = smoothing.Shape(options.smoothing_periods, damped=options.smoothing_damped)
        columns["_darts"] = smoothing.forecast_column(values, steps, shape)
    elif family == "seasonal_theta":
        columns["_darts"] = smoothing.seasonal_theta_column(values, steps, options.theta, options.theta_periods)
    elif family == "lag_linear":
        columns["_darts"] = numeric.lag_regression_column(values, steps, options.lags)
    elif family in _TRAINED_FAMILIES:
        columns["_darts"] = F.col(TRAINED)
    return columns


def _closed_form(method: str, options: ForecastOptions) -> Column | None:
    step = F.col(STEP)
    if method == "sma":
        return F.col("sma_level")
    if method == "es":
        return F.col("es_level")
    if method == "hw":
        return cf.holt_winters_value(F.col("hw_state"), F.col("hw_level"), options.hw_seasonal_periods, step)
    if method == "theta":
        return cf.theta_value(options.theta, step)
    return None


def _method_column(method: str, options: ForecastOptions, arrays: Sequence[str]) -> Column:
    """The forecast of one method; a method that is off is a missing column, not an absent one."""
    if method not in options.methods:
        return F.lit(None).cast("double").alias(method)
    if f"_{method}" in arrays:
        column = F.col(f"_{method}")
    else:
        column = _closed_form(method, options)
    if column is None:
        column = F.lit(None)
    return nan_to_null(column.cast("double")).alias(method)


def score(
    fitted: DataFrame,
    options: ForecastOptions = ForecastOptions(),
    *,
    series_cols: Sequence[str] = (),
    date_col: str,
) -> DataFrame:
    """One row per series and step: ``last_date, step, <date_col>`` and the ten forecast columns."""
    arrays = [f"_{m}" for m in FORECAST_METHODS if f"_{m}" in fitted.columns]
    carried = [c for c in fitted.columns if c not in (*arrays, HORIZON, "row_count")]
    steps = F.sequence(F.lit(1), F.col(HORIZON)).alias(STEP)
    if arrays:
        # zip first: a generator copies the columns beside it once per output row; a failed fit
        # becomes an empty array, because one NULL array makes the whole zip NULL
        filled = [F.coalesce(F.col(a), F.array().cast("array<double>")).alias(a) for a in arrays]
        unfolded = fitted.select(*carried, F.inline(F.arrays_zip(steps, *filled)))
    else:
        unfolded = fitted.select(*carried, F.explode(steps).alias(STEP))
    day = forecast_day(F.col(LAST), F.col(STEP), F.col(GRAIN)).alias(date_col)
    scored = unfolded.select(
        *series_cols, LAST, STEP, day, *[_method_column(m, options, arrays) for m in FORECAST_METHODS]
    )
    blend = mean_of_present([F.col(m) for m in options.methods]) if options.ensemble else F.lit(None).cast("double")
    return scored.withColumn("ensemble", blend)


def forecast_rows(
    df: DataFrame,
    options: ForecastOptions = ForecastOptions(),
    *,
    series_cols: Sequence[str] = (),
    date_col: str,
    value_col: str,
) -> DataFrame:
    """Forecasts only, with ``last_date`` and ``step``."""
    fitted = fit(df, options, series_cols=series_cols, date_col=date_col, value_col=value_col)
    return score(fitted, options, series_cols=series_cols, date_col=date_col)


def forecast_table(
    df: DataFrame,
    options: ForecastOptions = ForecastOptions(),
    *,
    series_cols: Sequence[str] = (),
    date_col: str,
    value_col: str,
) -> DataFrame:
    """Actual rows (forecasts missing) and forecast rows (value missing) in one table.

    Forecast dates lie after every actual date of their series, so a union gives what joining
    both onto a spine of dates would give.
    """
    future = forecast_rows(df, options, series_cols=series_cols, date_col=date_col, value_col=value_col)
    return with_actuals(df, future, options, series_cols=series_cols, date_col=date_col, value_col=value_col)


def with_actuals(
    df: DataFrame,
    future: DataFrame,
    options: ForecastOptions = ForecastOptions(),
    *,
    series_cols: Sequence[str] = (),
    date_col: str,
    value_col: str,
) -> DataFrame:
    """The actual rows of ``df`` above the forecast rows made from them."""
    past = long_enough(
        df.select(*series_cols, date_col, value_col), series_cols=series_cols, min_points=options.min_points
    )
    missing = {name: F.lit(None).cast("double") for name in FORECAST_COLUMNS}
    names = [*series_cols, date_col, value_col]
    future = future.withColumn(value_col, F.lit(None).cast(df.schema[value_col].dataType))
    return share_source(past.withColumns(missing), [*names, *FORECAST_COLUMNS]).unionByName(
        future.select(*names, *FORECAST_COLUMNS)
    )
