"""Date expressions: grains, forecast dates, milestones, report ranges.

All of them are plain expressions on DATE columns, so they fold away when the input is a literal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendframe.params import GRAINS, INTERVALS, MILESTONES, choice


# Spellings of a date that are read besides ISO, in this order; the month comes before the day in
# purely numeric ones.  A bare year is its first of January.
DATE_FORMATS = (
    "M/d/yyyy",
    "M/d/yyyy H:mm[:ss]",
    "yyyy/M/d",
    "yyyyMMdd",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "d-MMM-yyyy",
)


def to_day(value: Column, data_type: T.DataType, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Any date-like column as DATE; text that is not a date becomes NULL.

    ISO text goes through TIMESTAMP_NTZ: that refuses trailing junk (a direct cast to DATE accepts
    it) and takes the calendar day as written, whatever the session time zone.  Other text is tried
    with each of ``formats``.
    """
    if isinstance(data_type, T.StringType):
        text = F.trim(value)
        return F.coalesce(
            text.try_cast("timestamp_ntz").cast("date"), *(F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats)
        )
    return value.cast("date")


def period_start(ts: Column, grain: str) -> Column:
    """Start of the hour (TIMESTAMP_NTZ), day (DATE) or month (DATE) that ``ts`` falls in."""
    choice(grain, GRAINS, "grain")
    if grain == "daily":
        return ts.cast("date")
    if grain == "monthly":
        return F.trunc(ts.cast("date"), "month")
    # date_trunc would take TIMESTAMP_NTZ through the session zone; day + hour does not
    return ts.cast("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour(ts))


def iso_z(ts: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` text."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def month_index(day: Column) -> Column:
    """Months since year 0: consecutive months differ by one."""
    return F.year(day) * 12 + F.month(day)


def forecast_day(last: Column, step: Column, grain: Column) -> Column:
    """The ``step``-th forecast date: firsts of the following months, or the following days."""
    monthly = F.trunc(F.add_months(last, step), "month")
    return F.when(grain == "monthly", monthly).otherwise(F.date_add(last, step))


def milestone_days(last: Column) -> list[tuple[str, Column]]:
    """Five period ends, each strictly after ``last``, as ``(label, date)``.

    They follow from the day after ``last``: the end of the period that day lies in.
    """
    after = F.date_add(last, 1)

    def period_end(unit: str, months: int) -> Column:
        return F.date_sub(F.add_months(F.trunc(after, unit), months), 1)

    ends = [
        period_end("month", 1),
        period_end("month", 2),
        period_end("quarter", 3),
        period_end("quarter", 6),
        period_end("year", 12),
    ]
    return list(zip(MILESTONES, ends, strict=True))


def report_range(as_of: Column, grain: str, interval: str | None, include_today: bool) -> tuple[Column, Column]:
    """``[start, end)`` of a report seen from ``as_of``, both DATE."""
    choice(grain, GRAINS, "grain")
    choice(interval, INTERVALS, "interval")
    month = F.trunc(as_of, "month")
    end = F.date_add(as_of, 1) if include_today else as_of
    if interval is None:
        if grain == "hourly":
            return F.date_sub(as_of, 1), end
        if grain == "daily":
            return F.date_sub(as_of, 7), end
        return F.trunc(F.date_sub(month, 365), "month"), end if include_today else month
    half_year = F.add_months(F.trunc(as_of, "year"), F.when(F.month(as_of) <= 6, 0).otherwise(6))
    start = {
        "day": as_of,
        "week": F.date_sub(as_of, 6),
        "month": month,
        "quarter": F.trunc(as_of, "quarter"),
        "semester": half_year,
        "year": F.trunc(as_of, "year"),
    }[interval]
    return start, end


def range_text(day: Column, grain: str) -> Column:
    """A range bound as a report request spells it: with a time for hourly, else the date."""
    return F.concat(day.cast("string"), F.lit("T00:00:00Z" if grain == "hourly" else ""))


def anomaly_reference_days(as_of: Column) -> dict[str, Column]:
    """The reference dates of a comparison seen from ``as_of``."""
    return {
        "today": as_of,
        "yesterday": F.date_sub(as_of, 1),
        "day_before_yesterday": F.date_sub(as_of, 2),
        "week_ago": F.date_sub(as_of, 7),
        "month_ago": F.add_months(as_of, -1),
        "quarter_ago": F.add_months(as_of, -3),
    }
