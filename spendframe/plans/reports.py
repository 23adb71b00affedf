"""Report pipelines.  Nothing is written or collected between the stages."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.functions.dates import report_range
from spendframe.operators import anomalies
from spendframe.operators.budgets import budget_by_name, compare_with_budgets
from spendframe.operators.clean import clean_series, long_enough, share_source
from spendframe.operators.combine import milestone_summary, summary_methods
from spendframe.operators.forecast import ForecastOptions, forecast_rows
from spendframe.operators.forecast.api import with_actuals
from spendframe.params import MIN_POINTS, choice, iso_date, metric_name
from spendframe.sources.usage import Group, cost_by_period, report_bounds


def forecast_report(
    costs: DataFrame,
    options: ForecastOptions = ForecastOptions(),
    *,
    series_cols: Sequence[str] = (),
    date_col: str,
    value_col: str,
    milestones: bool = False,
) -> tuple[DataFrame, DataFrame | None]:
    """Clean the input, forecast every series, and sum up to the milestones when asked."""
    names = {"series_cols": series_cols, "date_col": date_col, "value_col": value_col}
    series = clean_series(costs, **names)
    rows = forecast_rows(series, options, **names)  # fitted, and where needed trained, once for both results
    table = with_actuals(series, rows, options, **names)
    if not milestones:
        return table, None
    sums = milestone_summary(rows, series_cols=series_cols, date_col=date_col, methods=summary_methods(options))
    return table, sums


def budget_report(
    costs: DataFrame,
    budgets: DataFrame,
    *,
    budget_name: str | None = None,
    all_budgets: bool = False,
    **settings,
) -> DataFrame:
    """One named budget or all of them against every cost row."""
    if (budget_name is None) != all_budgets:
        raise ValueError("give either budget_name or all_budgets")
    chosen = budgets if all_budgets else budget_by_name(budgets, budget_name)
    return compare_with_budgets(costs, chosen, **settings)


def fitted_values(
    series: DataFrame,
    *,
    series_cols: Sequence[str],
    date_col: str,
    value_col: str,
    methods: Sequence[str] = ("sma", "es"),
    window: int = 7,
    alpha: float = 0.5,
) -> DataFrame:
    """``series, date, method, value`` of the methods that have a value at every date."""
    names = {"series_cols": series_cols, "date_col": date_col, "value_col": value_col}
    parts = []
    for method in methods:
        choice(method, ("sma", "es", "prophet"), "per-date method")
        if method == "sma":
            values = anomalies.rolling_mean(series, window=window, **names)
        elif method == "prophet":
            values = anomalies.fitted_trend(series, **names)
        else:
            values = anomalies.rolling_smoothing(series, alpha=alpha, **names)
        parts.append(values.select(*series_cols, date_col, F.lit(method).alias("method"), "value"))
    table = share_source(parts[0], parts[0].columns) if len(parts) > 1 else parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def cost_report(
    usage: DataFrame,
    *,
    ts_col: str,
    amount: str | Column,
    as_of: str | dt.date,
    grain: str = "daily",
    interval: str | None = None,
    include_today: bool = False,
    group: Group | None = None,
    start: str | dt.date | None = None,
    end: str | dt.date | None = None,
    metric: str | None = None,
) -> DataFrame:
    """``PeriodStart, <group>, <metric>`` over the range seen from ``as_of``.

    An explicit ``start`` and ``end`` replace the range.
    """
    today = F.lit(str(iso_date(as_of))).cast("date")
    first, last = report_bounds(start, end, report_range(today, grain, interval, include_today))
    return cost_by_period(
        usage,
        ts_col=ts_col,
        amount=amount,
        grain=grain,
        group=group,
        start=first,
        end=last,
        period_col="PeriodStart",
        cost_col=metric_name(metric),
    )


def anomaly_report(
    usage: DataFrame,
    *,
    ts_col: str,
    amount: str | Column,
    as_of: str | dt.date,
    threshold: float,
    grain: str = "daily",
    group: Group | None = None,
    methods: Sequence[str] = ("sma", "es"),
    min_points: int = MIN_POINTS,
    margin: int = 10,
) -> DataFrame:
    """Usage lines -> cost per period and group -> values at each date -> change against earlier dates.

    Reads from three months and ``margin`` days before ``as_of`` up to ``as_of``.  All groups run
    in the same job; groups with too short a history are left out.
    """
    choice(grain, ("daily",), "grain of a comparison by days")
    today = F.lit(str(iso_date(as_of))).cast("date")
    costs = cost_by_period(
        usage,
        ts_col=ts_col,
        amount=amount,
        grain=grain,
        group=group,
        group_col="group_key",
        start=F.date_sub(F.add_months(today, -3), margin),
        end=today,
    )
    costs = costs.filter(F.col("group_key").isNotNull())
    names = {"series_cols": ["group_key"], "date_col": "period_start", "value_col": "cost"}
    series = long_enough(costs, series_cols=["group_key"], min_points=min_points)
    values = fitted_values(series, methods=methods, **names)
    return anomalies.compare_periods(
        values, as_of=as_of, group_cols=["group_key"], date_col="period_start", threshold=threshold
    )


def what_if(series: DataFrame, *changes: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply event functions one after the other, e.g. ``partial(spike, start=..., ...)``."""
    for change in changes:
        series = series.transform(change)
    return series
