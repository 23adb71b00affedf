"""What-if events on a series: step changes, spikes, dips, seasons, random spikes, notes.

Events that count rows number them within a series.  A series is one row per period (aggregate
usage lines first), so that numbering is bounded by the calendar however many lines a group has.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendframe.functions.draws import uniform
from spendframe.functions.numbers import floor_at_zero
from spendframe.params import iso_date, month_factors, one_change, require_columns

NOTE = "note"
_EVENT, _RANK = "_in_event", "_event_rank"


def from_start(date_col: str, start: str | dt.date) -> Column:
    """Rows on or after ``start``."""
    return F.col(date_col) >= F.lit(str(iso_date(start))).cast("date")


def _ranked(df: DataFrame, date_col: str, start, series_cols: Sequence[str]) -> DataFrame:
    """Number the rows of each series from ``start`` on, by date; rows before it get NULL.

    The other plain columns break ties, so that a re-run numbers equal dates the same way.
    """
    eligible = F.coalesce(from_start(date_col, start), F.lit(False))
    plain = [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType) and f.name not in series_cols]
    ties = [c for c in plain if c != date_col]
    # by series alone, rows before the start last: a chain of events, and a forecast behind it, share one exchange
    w = Window.partitionBy(*series_cols).orderBy((~eligible).asc(), date_col, *ties)
    return df.withColumn(_RANK, F.when(eligible, F.row_number().over(w)))


def _changed(value_col: str, inside: Column, pct: float | None, value: float | None, clamp: bool) -> Column:
    """Scale or shift the rows inside the event.  The clamp acts on every row."""
    before = F.col(value_col).cast("double")
    after = before * F.lit(1.0 + pct) if pct is not None else before + F.lit(float(value))
    changed = F.when(inside, after).otherwise(before)
    return floor_at_zero(changed) if clamp else changed


def _noted(df: DataFrame, is_first: Column, note: str | None) -> DataFrame:
    """Put the note on the event's first row, below a note that is already there."""
    if not note:
        return df
    present = F.coalesce(F.col(NOTE), F.lit("")) if NOTE in df.columns else F.lit("")
    added = F.when(present == "", F.lit(note)).otherwise(F.concat(present, F.lit("\n" + note)))
    unchanged = F.col(NOTE) if NOTE in df.columns else F.lit("")
    return df.withColumn(NOTE, F.when(is_first, added).otherwise(unchanged))


def change_rows(
    df: DataFrame, mask: Column, *, value_col: str, pct: float | None = None, value: float | None = None, clamp: bool = False
) -> DataFrame:
    """Apply a change to the rows a predicate selects."""
    require_columns(df, [value_col])
    one_change(pct, value)
    return df.withColumn(value_col, _changed(value_col, mask, pct, value, clamp))


def _apply(df, *, series_cols, date_col, value_col, start, length, pct, value, note) -> DataFrame:
    """A change from ``start`` on, over the first ``length`` rows (all later rows if None).

    Numbering rows needs one exchange by series.  An open-ended change without a note needs no
    numbering and stays a plain projection.
    """
    require_columns(df, [*series_cols, date_col, value_col])
    if length is None and not note:
        return df.withColumn(value_col, _changed(value_col, from_start(date_col, start), pct, value, True))
    ranked = _ranked(df, date_col, start, series_cols)
    inside = F.col(_RANK).isNotNull() if length is None else F.coalesce(F.col(_RANK) <= length, F.lit(False))
    changed = ranked.withColumn(value_col, _changed(value_col, inside, pct, value, True))
    return _noted(changed, F.coalesce(F.col(_RANK) == 1, F.lit(False)), note).drop(_RANK)


def ensure_event_rows(df: DataFrame, *, date_col: str, start: str | dt.date) -> DataFrame:
    """Raise when no row lies on or after ``start``.  Runs a job, so it is a call of its own."""
    if df.filter(from_start(date_col, start)).limit(1).isEmpty():
        raise ValueError(f"no rows on or after {start}")
    return df


def step_change(
    df: DataFrame,
    *,
    series_cols: Sequence[str] = (),
    date_col: str,
    value_col: str,
    start: str | dt.date,
    pct: float | None = None,
    value: float | None = None,
    note: str | None = None,
) -> DataFrame:
    """A lasting change from ``start`` on: ``pct`` as a fraction, or an amount to add."""
    one_change(pct, value)
    return _apply(
        df,
        series_cols=series_cols,
        date_col=date_col,
        value_col=value_col,
        start=start,
        length=None,
        pct=pct,
        value=value,
        note=note,
    )


def _bounded(df, sign: float, length: int, pct, value, **names) -> DataFrame:
    one_change(pct, value, positive=True)
    if length < 1:
        raise ValueError("length must be at least 1")
    return _apply(
        df,
        length=length,
        pct=None if pct is None else sign * pct,
        value=None if value is None else sign * value,
        **names,
    )


def spike(
    df: DataFrame,
    *,
    series_cols: Sequence[str] = (),
    date_col: str,
    value_col: str,
    start: str | dt.date,
    length: int,
    pct: float | None = None,
    value: float | None = None,
    note: str | None = None,
) -> DataFrame:
    """A rise over the first ``length`` rows (not days) on or after ``start``."""
    names = {"series_cols": series_cols, "date_col": date_col, "value_col": value_col}
    return _bounded(df, 1.0, length, pct, value, start=start, note=note, **names)


def dip(
    df: DataFrame,
    *,
    series_cols: Sequence[str] = (),
    date_col: str,
    value_col: str,
    start: str | dt.date,
    length: int,
    pct: float | None = None,
    value: float | None = None,
    note: str | None = None,
) -> DataFrame:
    """A fall over the first ``length`` rows on or after ``start``; never below zero."""
    names = {"series_cols": series_cols, "date_col": date_col, "value_col": value_col}
    return _bounded(df, -1.0, length, pct, value, start=start, note=note, **names)


def annotate(
    df: DataFrame, *, series_cols: Sequence[str] = (), date_col: str, start: str | dt.date, note: str | None
) -> DataFrame:
    """A note on the first row on or after ``start`` of each series; an empty note changes nothing."""
    require_columns(df, [*series_cols, date_col])
    if not note:
        return df
    ranked = _ranked(df, date_col, start, series_cols)
    return _noted(ranked, F.coalesce(F.col(_RANK) == 1, F.lit(False)), note).drop(_RANK)


def seasonality(
    df: DataFrame,
    *,
    date_col: str,
    value_col: str,
    preset: str | None = None,
    factors: str | Sequence[float] | None = None,
) -> DataFrame:
    """Scale each row by its month's factor.  A projection: no sort, no clamp."""
    require_columns(df, [date_col, value_col])
    table = F.array(*[F.lit(f) for f in month_factors(preset, factors)])
    return df.withColumn(value_col, F.col(value_col).cast("double") * F.get(table, F.month(date_col) - 1))


def random_spikes(
    df: DataFrame,
    *,
    series_cols: Sequence[str] = (),
    date_col: str,
    value_col: str,
    max_pct: float,
    prob: float = 0.05,
    seed: int = 42,
) -> DataFrame:
    """With probability ``prob``, scale a row by 1 + U(0, max_pct).

    The draws hash series and date, so they do not depend on partitioning or on a re-run.
    """
    require_columns(df, [*series_cols, date_col, value_col])
    keys = [F.col(c) for c in (*series_cols, date_col)]
    value = F.col(value_col).cast("double")
    lifted = value * (F.lit(1.0) + uniform(keys, seed, "size") * F.lit(float(max_pct)))
    return df.withColumn(value_col, F.when(uniform(keys, seed, "hit") < prob, lifted).otherwise(value))
