"""Inputs that are partly bad fail or are counted; nothing is dropped without a word."""

import json

import pytest
from pyspark.sql import functions as F

from spendframe.operators import clean, combine, events
from spendframe.operators.anomalies import change_since
from spendframe.operators.forecast import ForecastOptions, forecast_table, numeric, sparse_trend
from spendframe.sources import budgets, files, reports

from helpers import day, days_from

PAGE = {
    "ResultsByTime": [
        {"TimePeriod": {"Start": f"2025-01-0{d}"}, "Groups": [{"Keys": [k], "Metrics": m} for k, m in groups]}
        for d, groups in (
            (1, [("a", {"UnblendedCost": {"Amount": "1.5"}}), ("b", {"Other": {"Amount": "9"}})]),
            (2, [("a", {"UnblendedCost": {"Amount": "2"}})]),
        )
    ]
}


def test_cut_page_fails(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps(PAGE))
    assert reports.grouped_rows(reports.read_report_pages(spark, str(tmp_path))).count() == 3
    (tmp_path / "2.json").write_text(json.dumps(PAGE)[:-20])
    with pytest.raises(Exception, match="FAILFAST|MALFORMED|Malformed"):
        reports.grouped_rows(reports.read_report_pages(spark, str(tmp_path))).collect()
    text = spark.createDataFrame([(json.dumps(PAGE),), ("{bad",)], "t string")
    with pytest.raises(Exception, match="FAILFAST|MALFORMED|Malformed"):
        reports.grouped_rows(reports.parse_report_pages(text, "t")).collect()
    with pytest.raises(Exception, match="FAILFAST|MALFORMED|Malformed"):
        budgets.parse_budgets(text.where("t = '{bad'"), "t").collect()


def test_several_periods_and_groups_and_an_absent_metric(spark, tmp_path):
    (tmp_path / "pages.jsonl").write_text("\n".join(json.dumps(PAGE) for _ in range(2)))
    rows = reports.grouped_rows(reports.read_report_pages(spark, str(tmp_path), lines=True)).collect()
    wanted = [("2025-01-01", "a", "1.500000"), ("2025-01-02", "a", "2.000000")] * 2
    assert sorted(tuple(r)[:3] for r in rows if r.Group == "a") == sorted(wanted)
    assert len([r for r in rows if r.Group == "b"]) == 2


def test_swapped_header_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("PeriodStart,Cost\n2025-01-01,5\n")
    (tmp_path / "b.csv").write_text("PeriodStart,Cost\n2025-01-02,6\n")
    assert files.read_csv(spark, str(tmp_path)).count() == 2
    (tmp_path / "c.csv").write_text("Cost,PeriodStart\n7,2025-01-03\n")
    with pytest.raises(Exception, match="header|Header"):
        files.read_csv(spark, str(tmp_path)).collect()


def test_dropped_rows_are_counted(spark):
    rows = [("2025-01-01", "1"), ("1/2/2025", "2"), (None, "3"), ("junk", "4"), ("2025-01-05", None), ("2025-01-06", "x")]
    df = spark.createDataFrame(rows, "d string, v string")
    got = clean.dropped_rows(df, date_col="d", value_col="v").first().asDict()
    assert got == {"missing_date": 1, "bad_date": 1, "missing_value": 1, "bad_value": 1, "kept": 2}
    with pytest.raises(ValueError, match="no rows"):
        clean.ensure_rows(clean.clean_series(df.limit(0), date_col="d", value_col="v"))


def test_horizon_errors(series):
    table = forecast_table(series(days_from("2025-01-01", 5), range(5)), date_col="PeriodStart", value_col="Cost")
    with pytest.raises(ValueError, match="no forecast"):
        combine.ensure_forecasts(table)
    with pytest.raises(ValueError, match="at least 1"):
        combine.forecast_horizon(table, 0, date_col="PeriodStart")


def test_chain_of_events_has_one_exchange(spark):
    rows = [(s, day("2025-01-01"), float(k), "") for s in "ab" for k in range(3)]
    df = spark.createDataFrame(rows, "s string, d date, v double, note string").repartition(3)
    names = {"series_cols": ["s"], "date_col": "d", "value_col": "v"}
    for start in ("2025-01-01", "2025-01-02", "2025-01-03"):
        df = events.spike(df, start=start, length=1, pct=0.1, note="n", **names)
    df = clean.long_enough(df, series_cols=["s"], min_points=1)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_change_since_takes_the_day_not_the_row(series):
    df = series([day("2025-01-01"), day("2025-01-05"), day("2025-01-08")], [100, 7, 150])
    got = change_since(df, 7, date_col="PeriodStart", value_col="Cost").orderBy("PeriodStart").collect()
    assert [r.change_pct for r in got] == [None, None, 50.0]


def test_levels_equal_the_recursion(spark):
    rows = [([3.0],), ([1.0, 2.0, 4.0],), ([],), ([5.0] * 4,)]
    got = spark.createDataFrame(rows, "v array<double>").select(numeric.smoothing_levels_column(F.col("v"), 0.5).alias("x")).collect()
    assert [list(r.x) for r in got] == [[3.0], [1.0, 1.5, 2.75], [], [5.0] * 4]


def test_late_bend_in_a_short_history():
    import numpy as np

    days = np.arange(20.0)
    values = np.where(days < 14, days, 14 + 5 * (days - 14))
    settings = sparse_trend.Settings(yearly=False, changepoint_scale=1e6)

    def ahead(v, own):
        return sparse_trend.fit([v], [days], own)[0].at(days[-1] + np.arange(1, 4), own)

    assert abs(np.diff(ahead(values, settings)) - 5).max() < 0.1
    yearly = sparse_trend.Settings(changepoint_scale=1e6)
    assert not np.allclose(ahead(np.sin(days), yearly), ahead(np.sin(days), settings))


def test_product_lags():
    assert numeric._product_lags(1, 1, 12) == [1, 12, 13]


@pytest.mark.parametrize("name", ["random_forest", "xgboost"])
def test_trees_do_not_follow_the_shuffle_width(spark, series, name):
    df = series(days_from("2025-01-01", 60), [10 + (i * 7) % 13 for i in range(60)])
    options = ForecastOptions(methods=("darts",), darts_algorithm=name, trees=4)
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for width in ("2", "8", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", width)
            table = forecast_table(df.repartition(int(width)), options, date_col="PeriodStart", value_col="Cost")
            found.append([r.darts for r in table.orderBy("PeriodStart").collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]
