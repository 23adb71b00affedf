"""Per-date fitted values and their change against earlier dates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendframe.functions.numbers import nan_to_null, percent_change
from spendframe.operators.forecast.numeric import smoothing_levels_column
from spendframe.operators.forecast.sparse_trend import Settings, trend_column
from spendframe.params import ANOMALY_PERIODS, iso_date



def rolling_mean(
    df: DataFrame, *, series_cols: Sequence[str] = (), date_col: str, value_col: str, window: int = 7
) -> DataFrame:
    """``series, date, value``: mean of the last ``window`` rows at each date."""
    w = Window.partitionBy(*series_cols).orderBy(date_col, value_col).rowsBetween(-(window - 1), 0)
    return df.select(*series_cols, date_col, F.avg(value_col).over(w).alias("value"))


def _at_each_date(
    df: DataFrame,
    values_at: Callable[[Column, Column], Column],
    *,
    series_cols: Sequence[str],
    date_col: str,
    value_col: str,
) -> DataFrame:
    """``series, date, value`` from a function of a series' value and date arrays.

    The arrays hold one element per period of a series, so their length is set by the calendar
    and not by the number of usage lines.
    """
    ordered = F.sort_array(F.collect_list(F.struct(F.col(date_col).alias("d"), F.col(value_col).alias("v"))))
    series = df.groupBy(*series_cols).agg(ordered.alias("_rows")).filter(F.size("_rows") > 0)
    dates = F.transform("_rows", lambda r: r["d"])
    fitted = values_at(F.transform("_rows", lambda r: r["v"]), dates)
    # a failed fit is an empty array here, which the zip pads with NULL values
    filled = F.coalesce(fitted, F.array().cast("array<double>"))
    return series.select(*series_cols, F.inline(F.arrays_zip(dates.alias(date_col), filled.alias("value"))))


def rolling_smoothing(
    df: DataFrame, *, series_cols: Sequence[str] = (), date_col: str, value_col: str, alpha: float = 0.5
) -> DataFrame:
    """``series, date, value``: the exponential smoothing level at each date."""
    names = {"series_cols": series_cols, "date_col": date_col, "value_col": value_col}
    return _at_each_date(df, lambda values, _: smoothing_levels_column(values, alpha), **names)


def fitted_trend(
    df: DataFrame,
    *,
    series_cols: Sequence[str] = (),
    date_col: str,
    value_col: str,
    yearly: bool = True,
    weekly: bool = False,
    changepoint_scale: float = 0.05,
    season_scale: float = 10.0,
) -> DataFrame:
    """``series, date, value``: the trend-and-seasons model of the whole series at each date."""

    def model(values: Column, dates: Column) -> Column:
        days = F.transform(dates, lambda d: F.unix_date(d.cast("date")))
        settings = Settings(yearly=yearly, weekly=weekly, changepoint_scale=changepoint_scale, season_scale=season_scale)
        return trend_column(values, days, days, settings)

    return _at_each_date(df, model, series_cols=series_cols, date_col=date_col, value_col=value_col)


def history(df: DataFrame, *, date_col: str, as_of: str | dt.date, margin: int = 10) -> DataFrame:
    """The rows a comparison needs: from three months and ``margin`` days back, up to ``as_of``."""
    today = F.lit(str(iso_date(as_of))).cast("date")
    day = F.col(date_col)
    return df.filter((day >= F.date_sub(F.add_months(today, -3), margin)) & (day < today))


def with_change(df: DataFrame, *, value_col: str, baseline_col: str, name: str = "change_pct") -> DataFrame:
    return df.withColumn(name, percent_change(F.col(value_col), F.col(baseline_col)))


def change_since(
    df: DataFrame, days: int, *, series_cols: Sequence[str] = (), date_col: str, value_col: str, name: str = "change_pct"
) -> DataFrame:
    """Adds the change in percent against the value ``days`` days before, in one window by series (no self-join)."""
    window = Window.partitionBy(*series_cols).orderBy(F.unix_date(date_col)).rangeBetween(-days, -days)
    return df.withColumn(name, percent_change(F.col(value_col), F.first(value_col).over(window)))


def compare_periods(
    values: DataFrame,
    *,
    as_of: str | dt.date,
    group_cols: Sequence[str],
    date_col: str,
    threshold: float,
    value_col: str = "value",
    method_col: str = "method",
    methods: Sequence[str] | None = None,
) -> DataFrame:
    """Yesterday's value against 2, 7, 30 and 90 days before it, per group and method.

    One conditional aggregate picks all five dates; it is combined map-side, so a group sends one
    row per map task whatever its history.  ``change_pct`` is NULL where a date is absent or the baseline is zero;
    ``anomaly`` is 'Y' when the change exceeds the threshold in either direction.
    """
    if methods is not None:
        values = values.filter(F.col(method_col).isin(*methods))
    target = iso_date(as_of) - dt.timedelta(days=1)

    def day(back: int) -> Column:
        return F.lit(str(target - dt.timedelta(days=back))).cast("date")

    def value_at(back: int) -> Column:
        return F.max(F.when(F.col(date_col) == day(back), nan_to_null(F.col(value_col))))

    offsets = [0, *(back for _, back in ANOMALY_PERIODS)]
    # no filter on the dates: a group without any of them is still listed, as N/A
    picked = values.groupBy(*group_cols, method_col).agg(*[value_at(b).alias(f"v{b}") for b in offsets])
    periods = F.array(
        *[
            F.struct(F.lit(label).alias("period"), percent_change(F.col("v0"), F.col(f"v{back}")).alias("change_pct"))
            for label, back in ANOMALY_PERIODS
        ]
    )
    rows = picked.select(*group_cols, method_col, F.inline(periods))
    flag = F.when(F.abs("change_pct") > threshold, "Y").otherwise("N")
    return rows.withColumn("anomaly", flag)


def summary_text(compared: DataFrame, *, group_col: str) -> DataFrame:
    """The printed form: five columns, with ``N/A`` for an absent change."""
    return compared.select(
        F.col(group_col).alias("Group"),
        F.col("method").alias("Method"),
        F.col("period").alias("Period"),
        F.coalesce(F.col("change_pct").cast("string"), F.lit("N/A")).alias("Change (%)"),
        F.col("anomaly").alias("Anomaly"),
    )
