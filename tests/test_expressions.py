"""Missing-value rules, date rules, parameter checks."""

import datetime as dt
import math

import pytest
from helpers import day
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendframe import params
from spendframe.functions import dates, draws, numbers


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_to_number_coerces_and_nulls_nan(spark):
    rows = [("1.5",), ("NaN",), ("",), ("abc",), ("1e3",), ("7d",), (None,), (" 2 ",)]
    df = spark.createDataFrame(rows, "t string").select(numbers.to_number(F.col("t"), T.StringType()).alias("x"))
    assert [r.x for r in df.collect()] == [1.5, None, None, None, 1000.0, None, None, 2.0]


def test_to_day_refuses_junk_and_keeps_written_day(spark):
    rows = [("2024-12-01",), ("2024-12-01T23:00:00Z",), ("2024-12-01 junk",), ("nope",), (None,), ("2024-02-30",)]
    df = spark.createDataFrame(rows, "t string").select(dates.to_day(F.col("t"), T.StringType()).alias("x"))
    assert [r.x for r in df.collect()] == [day("2024-12-01"), day("2024-12-01"), None, None, None, None]


def test_to_day_reads_other_spellings(spark):
    spellings = ["01/15/2025", "1/15/2025 13:05", "2025/01/15", "20250115", "Jan 15, 2025", "January 15, 2025", "15 Jan 2025", " 2025-01-15 "]
    df = spark.createDataFrame([(s,) for s in spellings], "t string").select(dates.to_day(F.col("t"), T.StringType()).alias("x"))
    assert {r.x for r in df.collect()} == {day("2025-01-15")}
    bad = spark.createDataFrame([("13/45/2025",), ("2025011",), ("Foo 1, 2025",)], "t string")
    assert {r.x for r in bad.select(dates.to_day(F.col("t"), T.StringType()).alias("x")).collect()} == {None}


def test_floor_keeps_missing(spark):
    assert one(spark, *[numbers.floor_at_zero(F.lit(v).cast("double")) for v in (-1, 2, None)]) == (0.0, 2.0, None)


@pytest.mark.parametrize("a, b, wanted", [(120, 100, 20), (80, 100, -20), (100, 0, None), (None, 5, None), (-5, -10, -50)])
def test_percent_change(spark, a, b, wanted):
    got = one(spark, numbers.percent_change(F.lit(a).cast("double"), F.lit(b).cast("double")))[0]
    assert got == wanted


def test_mean_of_present(spark):
    def mean(*values):
        return one(spark, numbers.mean_of_present([F.lit(v).cast("double") for v in values]))[0]

    assert mean(100, 105, 95) == 100
    assert mean(100, None, 95) == 97.5
    assert mean(None, None) is None


def test_amount_text(spark):
    rows = [("10.50",), ("n/a",), (None,), ("3",)]
    df = spark.createDataFrame(rows, "a string").select(numbers.amount_text(F.col("a")).alias("x"))
    assert [r.x for r in df.collect()] == ["10.500000", "n/a", "", "3.000000"]


@pytest.mark.parametrize(
    "last, ends",
    [
        ("2025-01-15", "2025-01-31 2025-02-28 2025-03-31 2025-06-30 2025-12-31"),
        ("2025-01-31", "2025-02-28 2025-03-31 2025-03-31 2025-06-30 2025-12-31"),
        ("2025-03-31", "2025-04-30 2025-05-31 2025-06-30 2025-09-30 2025-12-31"),
        ("2025-12-31", "2026-01-31 2026-02-28 2026-03-31 2026-06-30 2026-12-31"),
        ("2024-12-01", "2024-12-31 2025-01-31 2024-12-31 2025-03-31 2024-12-31"),
    ],
)
def test_milestones(spark, last, ends):
    got = one(spark, *[c.alias(n) for n, c in dates.milestone_days(F.lit(last).cast("date"))])
    assert list(got) == [day(e) for e in ends.split()]


def test_milestones_match_pandas_offsets(spark):
    import pandas as pd
    from pandas.tseries.offsets import MonthEnd, QuarterEnd, YearEnd

    base = spark.range(1461).select(F.date_add(F.lit("2023-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    rows = base.select("d", *[c.alias(n) for n, c in dates.milestone_days(F.col("d"))]).collect()
    for row in rows:
        stamp = pd.Timestamp(row.d)
        wanted = [stamp + o for o in (MonthEnd(1), MonthEnd(2), QuarterEnd(1), QuarterEnd(2), YearEnd(1))]
        assert list(row)[1:] == [w.date() for w in wanted]


def test_monthly_steps_match_pandas(spark):
    import pandas as pd

    base = spark.range(800).select(F.date_add(F.lit("2023-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    steps = base.select("d", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("h"))
    for row in steps.select("d", "h", dates.forecast_day(F.col("d"), F.col("h"), F.lit("monthly")).alias("x")).collect():
        assert row.x == (pd.Timestamp(row.d) + pd.DateOffset(months=row.h)).replace(day=1).date()


@pytest.mark.parametrize(
    "grain, interval, today, start, end",
    [
        ("hourly", None, False, "2025-05-14", "2025-05-15"),
        ("daily", None, True, "2025-05-08", "2025-05-16"),
        ("monthly", None, False, "2024-05-01", "2025-05-01"),
        ("monthly", None, True, "2024-05-01", "2025-05-16"),
        ("daily", "day", False, "2025-05-15", "2025-05-15"),
        ("daily", "week", False, "2025-05-09", "2025-05-15"),
        ("daily", "quarter", True, "2025-04-01", "2025-05-16"),
        ("monthly", "semester", False, "2025-01-01", "2025-05-15"),
        ("monthly", "year", False, "2025-01-01", "2025-05-15"),
    ],
)
def test_report_range(spark, grain, interval, today, start, end):
    got = one(spark, *dates.report_range(F.lit("2025-05-15").cast("date"), grain, interval, today))
    assert got == (day(start), day(end))


def test_range_text(spark):
    d = F.lit("2025-05-15").cast("date")
    assert one(spark, dates.range_text(d, "hourly"), dates.range_text(d, "daily")) == ("2025-05-15T00:00:00Z", "2025-05-15")
    stamp = F.lit("2025-05-15 07:08:09").cast("timestamp_ntz")
    assert one(spark, dates.iso_z(stamp)) == ("2025-05-15T07:08:09Z",)


def test_period_start_ignores_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        ts = F.lit("2024-03-10 02:30:00").cast("timestamp_ntz")  # inside the New York gap
        got = one(spark, dates.period_start(ts, "hourly").cast("string"), dates.period_start(ts, "monthly"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == ("2024-03-10 02:00:00", day("2024-03-01"))


def test_draws_do_not_depend_on_partitioning(spark):
    def values(parts):
        df = spark.range(500).repartition(parts)
        return {r.id: r.u for r in df.select("id", draws.uniform([F.col("id")], 7, "x").alias("u")).collect()}

    once = values(1)
    assert once == values(7)
    assert all(0 <= u < 1 for u in once.values())
    assert 0.4 < sum(once.values()) / 500 < 0.6


def test_normal_draws(spark):
    x = draws.standard_normal([F.col("id")], 42, "n").alias("x")
    row = spark.range(4000).select(x).select(F.avg("x").alias("m"), F.stddev("x").alias("s")).first()
    assert abs(row.m) < 0.06 and abs(row.s - 1) < 0.05 and math.isfinite(row.s)


def test_parameter_checks():
    assert params.metric_name(None) == "UnblendedCost"
    assert params.metric_name(" BlendedCost ") == "BlendedCost"
    for bad in ("Nope", "BlendedCost,UnblendedCost"):
        with pytest.raises(ValueError):
            params.metric_name(bad)
    assert params.model_order("1, 2,3", 3) == (1, 2, 3)
    for text, length in (("1,2", 3), ("a,b,c", 3), ("1,-1,0", 3)):
        with pytest.raises(ValueError):
            params.model_order(text, length)
    assert params.month_factors("toys", "1," * 11 + "2")[-1] == 2.0  # factors win over a preset
    for preset, factors in ((None, None), ("nope", None), (None, "1,2"), (None, "1," * 11 + "x")):
        with pytest.raises(ValueError):
            params.month_factors(preset, factors)
    for pct, value in ((None, None), (0.1, 5.0)):
        with pytest.raises(ValueError):
            params.one_change(pct, value)
    with pytest.raises(ValueError):
        params.one_change(-0.1, None, positive=True)
    assert params.iso_date("2025-01-02") == dt.date(2025, 1, 2)
    with pytest.raises(ValueError):
        params.iso_date("2025-13-01")
