"""Series made from a table of specifications, one series per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.functions.draws import standard_normal
from spendframe.functions.numbers import floor_at_zero
from spendframe.params import SERIES_PATTERNS, choice, require_columns

# Defaults of a specification
DEFAULTS = {
    "periods": 36,
    "baseline": 100.0,
    "trend": 1.0,
    "step_size": 50.0,
    "spike_size": 100.0,
    "noise": 0.05,
}
_INDEX = "_i"


def _setting(specs: DataFrame, name: str, given) -> Column:
    """A per-series column of that name if the table has one, else the parameter or its default."""
    if given is not None:
        return F.lit(given)
    return F.col(name) if name in specs.columns else F.lit(DEFAULTS[name])


def first_date(
    start: Column | None, end: Column | None, periods: Column, grain: str
) -> Column:
    """``start`` wins over ``end``; from an end date, count back.  Monthly grids begin on a first:
    a start within a month rolls forward to the next one."""
    if start is None:
        if end is None:
            raise ValueError("give a start or an end date")
        start = F.add_months(end, 1 - periods) if grain == "monthly" else F.date_sub(end, periods - 1)
    if grain == "daily":
        return start
    return F.when(F.dayofmonth(start) == 1, start).otherwise(F.add_months(F.trunc(start, "month"), 1))


def pattern_value(
    pattern: str, index: Column, periods: Column, baseline: Column, trend: Column, step: Column, spike: Column,
    step_index: Column | None = None, spike_index: Column | None = None,
) -> Column:
    """The noiseless level at ``index``."""
    choice(pattern, SERIES_PATTERNS, "pattern")
    if pattern == "upward_trend":
        return baseline + F.abs(trend) * index
    if pattern == "downward_trend":
        return baseline - F.abs(trend) * index
    if pattern == "step_change":
        at = F.floor(periods / 2) if step_index is None else step_index
        return baseline + F.when(index >= at, step).otherwise(0.0)
    if pattern == "spike":
        at = F.floor(periods / 3) if spike_index is None else spike_index
        return baseline + F.when(index == at, spike).otherwise(0.0)
    return baseline + F.lit(0.0) * index


def generate_dates(
    specs: DataFrame,
    *,
    series_cols: Sequence[str],
    grain: str = "daily",
    start: Column | None = None,
    end: Column | None = None,
    periods: int | None = None,
    date_col: str = "period_start",
) -> DataFrame:
    """``periods`` dates per series, with their 0-based index."""
    choice(grain, ("daily", "monthly"), "grain")
    count = _setting(specs, "periods", periods).cast("int")
    first = first_date(start, end, count, grain)
    dated = specs.withColumns({"_first": first, "_periods": count}).filter(F.col("_periods") > 0)
    rows = dated.select("*", F.explode(F.sequence(F.lit(0), F.col("_periods") - 1)).alias(_INDEX))
    shifted = F.add_months("_first", F.col(_INDEX)) if grain == "monthly" else F.date_add("_first", F.col(_INDEX))
    return rows.withColumn(date_col, shifted).drop("_first")


def generate_series(
    specs: DataFrame,
    *,
    series_cols: Sequence[str],
    pattern: str,
    grain: str = "daily",
    start: Column | None = None,
    end: Column | None = None,
    periods: int | None = None,
    baseline: float | None = None,
    trend: float | None = None,
    step_size: float | None = None,
    step_index: int | None = None,
    spike_size: float | None = None,
    spike_index: int | None = None,
    noise: float | None = None,
    seed: int = 42,
    date_col: str = "period_start",
    value_col: str = "cost",
) -> DataFrame:
    """A pattern plus multiplicative normal noise, never below zero.

    A setting that is not given comes from the specification's column of that name, or from the
    defaults.  Narrow: each specification unfolds in place, and noise hashes series and index.
    """
    require_columns(specs, series_cols)
    rows = generate_dates(
        specs, series_cols=series_cols, grain=grain, start=start, end=end, periods=periods, date_col=date_col
    )
    level = pattern_value(
        pattern,
        F.col(_INDEX),
        F.col("_periods"),
        _setting(specs, "baseline", baseline).cast("double"),
        _setting(specs, "trend", trend).cast("double"),
        _setting(specs, "step_size", step_size).cast("double"),
        _setting(specs, "spike_size", spike_size).cast("double"),
        None if step_index is None else F.lit(step_index),
        None if spike_index is None else F.lit(spike_index),
    )
    if noise != 0:
        keys = [F.col(c) for c in (*series_cols, _INDEX)]
        level = level * (F.lit(1.0) + _setting(specs, "noise", noise) * standard_normal(keys, seed, "noise"))
    return rows.select(*series_cols, date_col, floor_at_zero(level).alias(value_col))
