"""Budgets and anomaly comparisons."""

import datetime as dt

import numpy as np
import pytest
from helpers import day, days_from
from pyspark.sql import functions as F

from spendframe.operators import anomalies, budgets
from spendframe.plans import anomaly_report, budget_report
from spendframe.sources.usage import dimension


@pytest.fixture
def costs(spark):
    rows = [("2025-01-01", 500.0), ("2025-01-02", 800.0), ("2025-01-03", float("nan")), ("2025-01-04", 1200.0)]
    return spark.createDataFrame(rows, "PeriodStart string, UnblendedCost double")


@pytest.fixture
def limits(spark):
    return spark.createDataFrame([("main", 1000.0), ("none", 0.0)], "BudgetName string, BudgetAmount double")


def test_status_and_variance(costs, limits):
    rows = budget_report(costs, limits, budget_name="main").orderBy("PeriodStart").collect()
    assert rows[0].asDict().keys() == {
        "PeriodStart", "BudgetName", "BudgetAmount", "ActualCost", "Variance", "VariancePercent", "Status"
    }
    assert [r.Status for r in rows] == ["UNDER_BUDGET", "THRESHOLD_BREACH", "UNDER_BUDGET", "OVER_BUDGET"]
    assert [r.Variance for r in rows] == [500.0, 200.0, None, -200.0]
    assert [r.VariancePercent for r in rows] == [-50.0, -20.0, None, 20.0]
    assert rows[2].ActualCost is None


def test_every_row_meets_every_budget(costs, limits):
    rows = budget_report(costs, limits, all_budgets=True).collect()
    assert len(rows) == 8
    none = [r for r in rows if r.BudgetName == "none"]
    assert {(r.Status, r.Variance, r.VariancePercent) for r in none} == {("NO_BUDGET", 0.0, 0.0)}


def test_pairing_is_neither_broadcast_nor_a_product(spark, costs):
    many = spark.range(37).select(
        F.format_string("b%d", "id").alias("BudgetName"), (F.col("id") * 100.0).alias("BudgetAmount")
    )
    few, wide = budgets.compare_with_budgets(costs, many, lanes=1), budgets.compare_with_budgets(costs, many)
    order = lambda df: sorted(map(str, df.collect()))
    assert order(few) == order(wide) and few.count() == 148
    for df in (few, wide):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Broadcast" not in plan and "ShuffledHashJoin" in plan


def test_budget_of_its_own_group_and_month(spark):
    rows = [("a", "2025-01-03", 60.0), ("a", "2025-01-20", 30.0), ("a", "2025-02-01", 5.0), ("b", "2025-01-01", 9.0), ("c", "2025-01-01", 1.0)]
    costs = spark.createDataFrame(rows, "team string, d string, cost double").withColumn("d", F.col("d").cast("date"))
    limits = spark.createDataFrame([("a", 100.0), ("b", 5.0), ("z", 1.0)], "BudgetName string, BudgetAmount double")
    got = budgets.compare_by_dimension(costs, limits, dimension_col="team", date_col="d", cost_col="cost").collect()
    assert sorted((str(r.PeriodStart), r.BudgetName, r.ActualCost, r.Status) for r in got) == [
        ("2025-01-01", "a", 90.0, "THRESHOLD_BREACH"), ("2025-01-01", "b", 9.0, "OVER_BUDGET"), ("2025-02-01", "a", 5.0, "UNDER_BUDGET"),
    ]


def test_threshold_is_a_parameter(costs, limits):
    rows = budget_report(costs, limits, budget_name="main", threshold=40.0).orderBy("PeriodStart").collect()
    assert [r.Status for r in rows][:2] == ["THRESHOLD_BREACH", "THRESHOLD_BREACH"]


def test_budget_choice(costs, limits):
    for choice in ({}, {"budget_name": "main", "all_budgets": True}, {"budget_name": "absent"}):
        with pytest.raises(ValueError):
            budget_report(costs, limits, **choice)
    with pytest.raises(ValueError, match="UnblendedCost"):
        budget_report(costs.drop("UnblendedCost"), limits, all_budgets=True)


def test_alerts(costs, limits):
    compared = budget_report(costs, limits, all_budgets=True)
    lines = [r.alert for r in budgets.alert_lines(compared).orderBy("PeriodStart").collect()]
    assert lines == ["  - main: 800.00 vs 1000.00 (-20.0% variance)", "  - main: 1200.00 vs 1000.00 (20.0% variance)"]
    counts = {(r.BudgetName, r.Status): r.row_count for r in budgets.status_counts(compared).collect()}
    assert counts["main", "UNDER_BUDGET"] == 2 and counts["none", "NO_BUDGET"] == 4


NAMES = {"series_cols": ["g"], "date_col": "d", "value_col": "v"}


@pytest.fixture
def two_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(g, d, float(x)) for g in ("a", "b") for d, x in zip(days_from("2024-01-01", 700), rng.uniform(1, 9, 700))]
    return spark.createDataFrame(rows, "g string, d date, v double").repartition(6)


def test_rolling_values_against_brute_force(two_groups):
    values = {}
    for r in two_groups.orderBy("g", "d").collect():
        values.setdefault(r.g, []).append(r.v)
    sma = {(r.g, r.d): r.value for r in anomalies.rolling_mean(two_groups, window=7, **NAMES).collect()}
    es = {(r.g, r.d): r.value for r in anomalies.rolling_smoothing(two_groups, alpha=0.3, **NAMES).collect()}
    for g, series in values.items():
        level = series[0]
        for i, d in enumerate(days_from("2024-01-01", 700)):
            level = 0.3 * series[i] + 0.7 * level
            assert es[g, d] == pytest.approx(level)
            assert sma[g, d] == pytest.approx(np.mean(series[max(0, i - 6) : i + 1]))


def test_compare_periods(spark):
    as_of = day("2025-06-01")
    values = {0: 120.0, 2: 100.0, 7: 0.0, 30: 150.0}  # nothing 90 days back
    rows = [("g", "sma", as_of - dt.timedelta(days=1 + back), v) for back, v in values.items()]
    rows += [("old", "sma", day("2020-01-01"), 1.0), ("g", "es", as_of - dt.timedelta(days=1), float("nan"))]
    df = spark.createDataFrame(rows, "g string, method string, d date, value double")
    out = anomalies.compare_periods(df, as_of=as_of, group_cols=["g"], date_col="d", threshold=20.0)
    got = {(r.g, r.method, r.period): (r.change_pct, r.anomaly) for r in out.collect()}
    assert len(got) == 12
    assert got["g", "sma", "Day Before Yesterday"] == (pytest.approx(20.0), "N")  # the threshold itself is not exceeded
    assert got["g", "sma", "Week Ago"] == (None, "N")
    assert got["g", "sma", "Month Ago"] == (pytest.approx(-20.0), "N")
    assert got["g", "sma", "Quarter Ago"] == got["old", "sma", "Week Ago"] == got["g", "es", "Week Ago"] == (None, "N")
    low = anomalies.compare_periods(df, as_of="2025-06-01", group_cols=["g"], date_col="d", threshold=19.0, methods=["sma"])
    assert {r.period for r in low.filter("anomaly = 'Y'").collect()} == {"Day Before Yesterday", "Month Ago"}
    text = anomalies.summary_text(low, group_col="g").filter("Group = 'old'").first()
    assert text["Change (%)"] == "N/A" and text.asDict().keys() == {"Group", "Method", "Period", "Change (%)", "Anomaly"}


def test_report_from_usage_lines(spark):
    lines = [(d, g, 10.0 if d < day("2025-05-31") else 30.0) for d in days_from("2025-01-01", 151) for g in ("x", "y")]
    lines += [(day("2025-05-30"), "short", 1.0), (day("2025-06-02"), "x", 1e9), (day("2025-05-01"), None, 5.0)]
    usage = spark.createDataFrame(lines, "ts date, g string, v double")
    out = anomaly_report(usage, ts_col="ts", amount="v", as_of="2025-06-01", threshold=20, group=dimension("g", "g"))
    rows = out.collect()
    assert {r.group_key for r in rows} == {"x", "y"} and len(rows) == 2 * 2 * 4
    es = {r.period: r.change_pct for r in rows if r.method == "es" and r.group_key == "x"}
    assert es["Week Ago"] == pytest.approx(100.0) and es["Quarter Ago"] == pytest.approx(100.0)
    whole = anomaly_report(usage, ts_col="ts", amount="v", as_of="2025-06-01", threshold=20, methods=["sma"])
    assert {r.group_key for r in whole.collect()} == {"Total"}


def test_history_window(spark):
    df = spark.createDataFrame([(d,) for d in days_from("2025-01-01", 200)], "d date")
    got = anomalies.history(df, date_col="d", as_of="2025-06-15").agg(F.min("d"), F.max("d")).first()
    assert tuple(got) == (day("2025-03-05"), day("2025-06-14"))


def test_fitted_trend_recovers_a_wave(spark):
    days = days_from("2023-01-01", 800)
    wave = [20 + 3 * np.sin(2 * np.pi * d.toordinal() / 365.25) for d in days]
    df = spark.createDataFrame([("g", d, float(v)) for d, v in zip(days, wave)], "g string, d date, v double")
    free = {"changepoint_scale": float("inf"), "season_scale": float("inf")}
    got = anomalies.fitted_trend(df, **free, **NAMES).orderBy("d").collect()
    assert [r.d for r in got] == days and [r.value for r in got] == pytest.approx(wave, abs=1e-6)
