"""Coercion, filters and the length gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendframe.functions.dates import to_day
from spendframe.functions.numbers import to_number
from spendframe.params import MIN_POINTS, require_columns


def clean_series(df: DataFrame, *, series_cols: Sequence[str] = (), date_col: str, value_col: str) -> DataFrame:
    """Keep the series, date and value columns; coerce; drop rows without a date or a value.

    Narrow: one projection and one filter, no shuffle.  Row order is left to the operators that
    need it.
    """
    require_columns(df, [*series_cols, date_col, value_col])
    types = {field.name: field.dataType for field in df.schema}
    return df.select(
        *series_cols,
        to_day(F.col(date_col), types[date_col]).alias(date_col),
        to_number(F.col(value_col), types[value_col]).alias(value_col),
    ).dropna(subset=[date_col, value_col])


def dropped_rows(df: DataFrame, *, series_cols: Sequence[str] = (), date_col: str, value_col: str) -> DataFrame:
    """One row: how many rows ``clean_series`` keeps and how many it drops, by cause (the date goes first)."""
    require_columns(df, [*series_cols, date_col, value_col])
    types = {field.name: field.dataType for field in df.schema}
    raw_date, raw_value = F.col(date_col), F.col(value_col)
    day, value = to_day(raw_date, types[date_col]), to_number(raw_value, types[value_col])
    causes = {
        "missing_date": raw_date.isNull(),
        "bad_date": raw_date.isNotNull() & day.isNull(),
        "missing_value": day.isNotNull() & raw_value.isNull(),
        "bad_value": day.isNotNull() & raw_value.isNotNull() & value.isNull(),
        "kept": day.isNotNull() & value.isNotNull(),
    }
    return df.agg(*[F.count_if(rule).alias(name) for name, rule in causes.items()])


def ensure_rows(df: DataFrame, what: str = "rows to forecast") -> DataFrame:
    """Raise when the table is empty.  Runs a job, so it is a call of its own."""
    if df.limit(1).isEmpty():
        raise ValueError(f"no {what}")
    return df


def strict_dates(df: DataFrame, *, date_col: str) -> DataFrame:
    """Cast the date column to DATE; a row with a bad date fails the query."""
    require_columns(df, [date_col])
    kind = df.schema[date_col].dataType
    if not isinstance(kind, T.StringType):
        return df.withColumn(date_col, F.col(date_col).cast("date"))
    return df.withColumn(
        date_col,
        F.coalesce(
            to_day(F.col(date_col), kind),
            F.raise_error(F.concat(F.lit(f"invalid date in {date_col}: "), F.coalesce(date_col, F.lit("")))).cast("date"),
        ),
    )


def distinct_groups(df: DataFrame, group_col: str) -> DataFrame:
    """The non-missing values of a group column (combined map-side before the exchange)."""
    return df.select(group_col).filter(F.col(group_col).isNotNull()).distinct()


def series_lengths(df: DataFrame, *, series_cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*series_cols).agg(F.count(F.lit(1)).alias("row_count"))


def long_enough(df: DataFrame, *, series_cols: Sequence[str], min_points: int = MIN_POINTS) -> DataFrame:
    """Rows of the series that have at least ``min_points`` rows.

    A window, because what follows is partitioned by series as well and shares its exchange.
    """
    if not series_cols:  # one series: a window without keys would be one task
        return df.filter(df.agg(F.count(F.lit(1))).scalar() >= min_points)
    width = F.count(F.lit(1)).over(Window.partitionBy(*series_cols))
    return df.withColumn("_rows", width).filter(F.col("_rows") >= min_points).drop("_rows")


def skipped_series(df: DataFrame, *, series_cols: Sequence[str], min_points: int = MIN_POINTS) -> DataFrame:
    """The series the gate leaves out, with their row counts."""
    return series_lengths(df, series_cols=series_cols).filter(F.col("row_count") < min_points)


def share_source(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The first side of a union of two views of one table, ready to share its exchanges.

    The optimizer drops same-name aliases from a union's later sides but keeps those the first
    side passes through, and then the two no longer look alike.  Fresh names on top free them.
    """
    return df.select(*[F.col(f"`{c}`").alias(c) for c in columns])
