"""Long form, milestone sums and horizon cuts of a forecast table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendframe.functions.dates import milestone_days
from spendframe.operators.forecast.options import ForecastOptions
from spendframe.operators.spine import LAST
from spendframe.params import FORECAST_COLUMNS, FORECAST_METHODS


def forecast_long(
    table: DataFrame, *, series_cols: Sequence[str] = (), date_col: str, methods: Sequence[str] = FORECAST_COLUMNS
) -> DataFrame:
    """``series, date, method, value``: one row per method, missing values kept."""
    present = [m for m in methods if m in table.columns]
    return table.unpivot([*series_cols, date_col], present, "method", "value")


def summary_methods(options: ForecastOptions) -> list[str]:
    """Seven methods always; the optional three when switched on."""
    optional = {
        "neural_prophet": "neural_prophet" in options.methods,
        "darts": "darts" in options.methods,
        "ensemble": options.ensemble,
    }
    return [m for m in (*FORECAST_METHODS, "ensemble") if optional.get(m, True)]


def milestone_summary(
    rows: DataFrame,
    *,
    series_cols: Sequence[str] = (),
    date_col: str,
    methods: Sequence[str] = FORECAST_COLUMNS,
) -> DataFrame:
    """Sum of each method's forecasts up to and including each milestone; nothing to sum is 0.

    ``rows`` are ``forecast_rows`` (they carry ``last_date``).  A row's bucket is the number of milestones
    before it; the methods are summed by bucket, a sum each and no condition, and a milestone takes the
    buckets up to its own rank, a handful of rows a series.  Both aggregates keep the partitioning by
    series that the fit has, so neither needs an exchange.
    """
    names = [*series_cols, LAST]
    ends = milestone_days(F.col(LAST))

    def before(day: Column) -> Column:
        return sum((end < day).cast("int") for _, end in ends)

    sums = [F.sum(method).alias(method) for method in methods]
    buckets = rows.groupBy(*names, before(F.col(date_col)).alias("_bucket")).agg(*sums)
    each = F.array(*[F.struct(F.lit(label).alias("label"), end.alias("milestone_date"), before(end).alias("_rank")) for label, end in ends])
    within = buckets.select(*names, "_bucket", *methods, F.inline(each))
    totals = within.groupBy(*names, "label", "milestone_date").agg(
        *[F.coalesce(F.sum(F.when(F.col("_bucket") <= F.col("_rank"), F.col(m))), F.lit(0.0)).alias(m) for m in methods]
    )
    unfolded = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("total")) for m in methods])
    return totals.select(*series_cols, "label", "milestone_date", F.inline(unfolded)).select(
        *series_cols, "method", "label", "milestone_date", "total"
    )


def milestone_lines(summary: DataFrame, *, series_cols: Sequence[str] = ()) -> DataFrame:
    """Each milestone sum with its printable line."""
    line = F.format_string("%s (%s): %s: %.2f", "label", F.col("milestone_date").cast("string"), "method", "total")
    return summary.select(*series_cols, "label", "milestone_date", "method", line.alias("line"))


def forecast_horizon(
    table: DataFrame, days: int, *, series_cols: Sequence[str] = (), date_col: str
) -> DataFrame:
    """Rows from the first forecast date on, for ``days`` days.

    The first forecast date is the first with any forecast column present, per series.  A series
    without one has no rows in the result.
    """
    if days < 1:
        raise ValueError("days must be at least 1")
    methods = [m for m in FORECAST_COLUMNS if m in table.columns]
    if not methods:
        raise ValueError("no forecast columns in the table")
    forecast_day = F.when(F.coalesce(*methods).isNotNull(), F.col(date_col))
    if series_cols:
        first = F.min(forecast_day).over(Window.partitionBy(*series_cols))
    else:
        first = table.agg(F.min(forecast_day)).scalar()  # a window without keys would be one task
    marked = table.withColumn("_first", first)
    inside = (F.col(date_col) >= F.col("_first")) & (F.col(date_col) < F.date_add("_first", days))
    return marked.filter(inside).drop("_first")


def ensure_forecasts(table: DataFrame) -> DataFrame:
    """Raise when no forecast column has a value.  Runs a job, so it is a call of its own."""
    methods = [m for m in FORECAST_COLUMNS if m in table.columns]
    if not methods or table.filter(F.coalesce(*methods).isNotNull()).limit(1).isEmpty():
        raise ValueError("no forecast in the table")
    return table
