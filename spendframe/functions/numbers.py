"""Number expressions that keep "missing" as NULL (never NaN) and never raise under ANSI mode."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def to_number(value: Column, data_type: T.DataType) -> Column:
    """A column of any type as DOUBLE; text that is not a number, and NaN, become NULL.

    The JVM parser also takes a type suffix (``1d``, ``2.5f``), which is not a number in a CSV.
    """
    number = value.try_cast("double")
    if isinstance(data_type, T.StringType):
        number = F.when(~F.rlike(value, F.lit(r"[0-9.][dDfF]\s*$")), number)
    return nan_to_null(number)


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, NULL when ``bottom`` is zero."""
    return F.try_divide(top, bottom)


def floor_at_zero(value: Column) -> Column:
    """Negative values become 0.  NULL stays NULL (``greatest`` would turn it into 0)."""
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def percent_change(value: Column, baseline: Column) -> Column:
    """Change against a baseline in percent; NULL for a zero or missing baseline."""
    return ratio(value - baseline, baseline) * 100.0


def mean_of_present(values: Sequence[Column]) -> Column:
    """Row-wise mean over the non-NULL columns; NULL when there is none.

    Sums and counts instead of array functions, so that it stays inside generated code.
    """
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values])
    present = reduce(lambda a, b: a + b, [F.when(v.isNull(), 0).otherwise(1) for v in values])
    return ratio(total, present.cast("double"))


def amount_text(amount: Column) -> Column:
    """Six decimals when the text is a number; otherwise the text as it is; '' when absent."""
    number = to_number(amount, T.StringType())
    # format_string prints the word 'null' for NULL, hence the guard
    return F.coalesce(F.when(number.isNotNull(), F.format_string("%.6f", number)), amount, F.lit(""))
