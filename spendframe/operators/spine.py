"""Grain, forecast dates, milestones and report ranges as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendframe.functions.dates import (
    anomaly_reference_days,
    forecast_day,
    milestone_days,
    month_index,
    range_text,
    report_range,
)
from spendframe.params import DAILY_HORIZON, GRAINS, INTERVALS, MONTHLY_HORIZON

GRAIN, LAST = "grain", "last_date"


def grain_of(date: Column, previous: Column) -> Column:
    """Aggregate: 'monthly' when every date is a first of month, or when the dates are month ends
    one month apart (three at least); otherwise 'daily'.

    ``previous`` is the date before ``date`` in the series.  Comparing neighbours finds gaps and
    repeats without a distinct count.
    """
    firsts = F.every(F.dayofmonth(date) == 1)
    ends = F.every(date == F.last_day(date))
    steps = F.every(F.coalesce(month_index(date) - month_index(previous) == 1, F.lit(True)))
    regular_ends = ends & steps & (F.count(F.lit(1)) >= 3)
    return F.when(firsts | regular_ends, "monthly").otherwise("daily")


def series_spans(df: DataFrame, *, series_cols: Sequence[str], date_col: str) -> DataFrame:
    """One row per series: ``grain``, ``last_date``, ``row_count``."""
    previous = F.lag(date_col).over(Window.partitionBy(*series_cols).orderBy(date_col))
    stepped = df.select(*series_cols, date_col, previous.alias("_previous"))
    return stepped.groupBy(*series_cols).agg(
        grain_of(F.col(date_col), F.col("_previous")).alias(GRAIN),
        F.max(date_col).alias(LAST),
        F.count(F.lit(1)).alias("row_count"),
    )


def horizon(grain: Column) -> Column:
    return F.when(grain == "monthly", MONTHLY_HORIZON).otherwise(DAILY_HORIZON)


def forecast_dates(spans: DataFrame, *, series_cols: Sequence[str], date_col: str) -> DataFrame:
    """The dates to forecast, numbered by ``step`` from 1."""
    steps = spans.select(
        *series_cols, LAST, GRAIN, F.explode(F.sequence(F.lit(1), horizon(F.col(GRAIN)))).alias("step")
    )
    day = forecast_day(F.col(LAST), F.col("step"), F.col(GRAIN))
    return steps.select(*series_cols, "step", day.alias(date_col))


def milestone_dates(spans: DataFrame, *, series_cols: Sequence[str]) -> DataFrame:
    """Five labelled dates per series, all after its last date."""
    days = milestone_days(F.col(LAST))
    pairs = F.array(*[F.struct(F.lit(label).alias("label"), day.alias("milestone_date")) for label, day in days])
    return spans.select(*series_cols, LAST, F.inline(pairs))


def report_ranges(df: DataFrame, *, as_of_col: str) -> DataFrame:
    """Every grain, interval and include-today choice for each ``as_of`` date: 42 rows per date."""
    choices = [
        F.struct(
            F.lit(grain).alias("grain"),
            F.lit(interval or "none").alias("interval"),
            F.lit(today).alias("include_today"),
            *[
                range_text(bound, grain).alias(name)
                for name, bound in zip(
                    ("range_start", "range_end"),
                    report_range(F.col(as_of_col), grain, interval, today),
                    strict=True,
                )
            ],
        )
        for grain in GRAINS
        for interval in INTERVALS
        for today in (False, True)
    ]
    return df.select(as_of_col, F.inline(F.array(*choices)))


def anomaly_dates(df: DataFrame, *, as_of_col: str) -> DataFrame:
    """The reference dates seen from each ``as_of`` date."""
    days = anomaly_reference_days(F.col(as_of_col))
    return df.select(as_of_col, *[day.alias(name) for name, day in days.items()])
