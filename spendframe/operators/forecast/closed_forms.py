"""Methods whose fit is an aggregate and whose forecast is an expression in the step ``h``.

Rows are numbered from the newest backwards (``age`` 0 is the last row of its series).  With that
numbering every weight and lag below is known without the series length, so one window and one
aggregate fit all of these methods together:

* moving average      mean of the rows with ``age < window``
* smoothing           ``sum(alpha (1-alpha)^age v) + (1-alpha)^n v_first``, the recursion unrolled
* theta               least-squares line against ``-age``: its intercept is the line at the last row

Holt-Winters divides level and season by each other, so it has no closed form: ``numeric`` runs
that recursion, and only its forecast expression is here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendframe.functions.numbers import ratio

AGE = "_age"
PREVIOUS = "_previous"


def number_from_newest(df: DataFrame, *, series_cols: Sequence[str], date_col: str, value_col: str) -> DataFrame:
    """Add ``age`` and the preceding row's date; equal dates are ordered by value."""
    newest_first = Window.partitionBy(*series_cols).orderBy(F.desc(date_col), F.desc(value_col))
    return df.withColumns(
        {
            AGE: F.row_number().over(newest_first) - 1,
            PREVIOUS: F.lead(date_col).over(newest_first),
        }
    )


def values_oldest_first(value: Column) -> Column:
    """Aggregate: the series as an array.  Its length is the number of periods in the series."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col(AGE)).alias("k"), value.alias("v"))))
    return F.transform(ordered, lambda row: row["v"])


def days_oldest_first(date: Column) -> Column:
    ordered = F.sort_array(F.collect_list(F.struct((-F.col(AGE)).alias("k"), F.unix_date(date).alias("d"))))
    return F.transform(ordered, lambda row: row["d"])


def at_age(value: Column, age: int) -> Column:
    return F.max(F.when(F.col(AGE) == age, value))


def first_value(value: Column) -> Column:
    return F.max_by(value, F.col(AGE))


# -- moving average ---------------------------------------------------------------------------


def moving_average(value: Column, window: int) -> Column:
    return F.avg(F.when(F.col(AGE) < window, value))


# -- exponential smoothing --------------------------------------------------------------------


def smoothed_level(value: Column, alpha: float) -> Column:
    keep = F.lit(1.0 - alpha)
    recent = F.sum(F.lit(alpha) * F.pow(keep, F.col(AGE)) * value)
    return recent + F.pow(keep, F.count(F.lit(1))) * first_value(value)


# -- theta ------------------------------------------------------------------------------------


def theta_state(value: Column) -> dict[str, Column]:
    past = -F.col(AGE).cast("double")
    return {
        "theta_slope": F.regr_slope(value, past),
        "theta_line": F.regr_intercept(value, past),
        "last_value": at_age(value, 0),
        "prev_value": at_age(value, 1),
    }


def theta_value(theta: float, step: Column) -> Column:
    slope, line = F.col("theta_slope"), F.col("theta_line")

    def stretched(actual: Column, on_line: Column) -> Column:
        return F.lit(theta) * (actual - on_line) + on_line

    last = stretched(F.col("last_value"), line)
    before = stretched(F.col("prev_value"), line - slope)
    forecast = (line + slope * step) + (last + (last - before) - line)
    # a one-point series has no line: repeat its value
    return F.coalesce(forecast, F.when(F.col("prev_value").isNull(), F.col("last_value")))


# -- Holt-Winters (state from ``numeric``) -------------------------------------------------------


def holt_winters_value(state: Column, fallback: Column, period: int, step: Column) -> Column:
    """Level plus trend times the season factor of the step; smoothing for short series."""
    season = F.get(state["season"], F.pmod(step - 1, F.lit(period)))
    return F.when(state.isNull(), fallback).otherwise((state["level"] + step * state["trend"]) * season)


# -- constant series --------------------------------------------------------------------------


def constant_or_null(value: Column) -> Column:
    """Aggregate: the last value if all values are within 1e-8 + 1e-5 |first| of the first."""
    first = first_value(value)
    spread = F.greatest(F.max(value) - first, first - F.min(value))
    return F.when(spread <= F.lit(1e-8) + F.lit(1e-5) * F.abs(first), at_age(value, 0))


# -- first-difference autoregression ----------------------------------------------------------


def ar1_difference_state(df: DataFrame, *, series_cols: Sequence[str], date_col: str, value_col: str) -> DataFrame:
    """Order (1, 1, 0) by least squares through the origin: ``last_value, last_step, phi``."""
    w = Window.partitionBy(*series_cols).orderBy(date_col, value_col)
    steps = df.withColumn("_d", F.col(value_col) - F.lag(value_col).over(w))
    steps = steps.withColumn("_d1", F.lag("_d").over(w))
    newest = F.struct(date_col, value_col)
    return steps.groupBy(*series_cols).agg(
        F.max(date_col).alias("last_date"),
        F.max_by(value_col, newest).alias("last_value"),
        F.max_by("_d", newest).alias("last_step"),
        ratio(F.sum(F.col("_d") * F.col("_d1")), F.sum(F.when(F.col("_d").isNotNull(), F.col("_d1") * F.col("_d1")))).alias(
            "phi"
        ),
    )


def ar1_difference_value(step: Column) -> Column:
    """``last + last_step (phi + ... + phi^h)``; the sum is ``h`` when phi is 1."""
    phi = F.col("phi")
    total = F.when(phi == 1, step.cast("double")).otherwise(ratio(phi * (1 - F.pow(phi, step)), 1 - phi))
    return F.col("last_value") + F.col("last_step") * total
