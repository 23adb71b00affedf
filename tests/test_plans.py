"""The physical plans that scale depends on."""

import pytest
from helpers import days_from
from pyspark.sql import functions as F

from spendframe.operators.clean import clean_series, long_enough
from spendframe.operators.events import seasonality, step_change
from spendframe.operators.forecast import ForecastOptions, fit, forecast_table
from spendframe.sources.usage import cost_by_period, dimension, tag
from workload.bindings import SERIES, service_daily, table

ALL = ForecastOptions(methods=("sma", "es", "hw", "theta", "arima", "sarima", "prophet"), ensemble=True)


def plan(df, run=False) -> str:
    if run:
        df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def test_usage_scan_is_pruned_and_filtered(spark, sf_dir):
    df = cost_by_period(
        table(spark, sf_dir, "events"),
        ts_col="ts",
        amount="value",
        group=dimension("event_type", "service"),
        start="2024-01-05",
        end="2024-01-09",
    )
    text = plan(df)
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in text
    assert "GreaterThanOrEqual(ts,2024-01-05T00:00)" in text and "LessThan(ts,2024-01-09T00:00)" in text
    assert text.count("Exchange") == 1 and "partial_sum" in text


def test_anomaly_lookback_is_pushed_down(spark, sf_dir):
    from spendframe.plans import anomaly_report

    report = anomaly_report(
        table(spark, sf_dir, "lineitem"), ts_col="l_shipdate", amount="l_tax", as_of="2001-08-01", threshold=20, methods=["sma"]
    )
    text = plan(report)
    # the plan text cuts the filter list after 100 characters
    assert "GreaterThanOrEqual(l_shipdate,2001-04-21T00:00)" in text and "LessThan(l_shipdate,2001" in text


def test_fit_adds_one_exchange_for_all_methods(spark, sf_dir):
    text = plan(fit(service_daily(spark, sf_dir), ALL, **SERIES))
    assert text.count("Exchange hashpartitioning") == 2 and text.count("Window [") == 1
    assert text.count("FileScan") == 1 and "SinglePartition" not in text


def test_forecast_table_reads_the_usage_once(spark, sf_dir):
    text = plan(forecast_table(service_daily(spark, sf_dir), ForecastOptions(ensemble=True), **SERIES), run=True)
    assert text.count("FileScan") == 1 and "ReusedExchange" in text and "SinglePartition" not in text


@pytest.mark.parametrize("kind", ["forecast", "fitted"])
def test_same_named_columns_still_share_the_scan(spark, tmp_path, kind):
    """Usage whose columns already carry the series' names: no rename tells the two sides apart."""
    from spendframe.plans.reports import fitted_values

    rows = [(d, g, 1.0 + i % 5) for i, d in enumerate(days_from("2025-01-01", 40)) for g in ("a", "b")]
    path = str(tmp_path / "usage")
    spark.createDataFrame(rows, "period_start date, service string, cost double").write.parquet(path)
    costs = cost_by_period(
        spark.read.parquet(path), ts_col="period_start", amount="cost", group=dimension("service")
    )
    if kind == "forecast":
        df = forecast_table(costs, ForecastOptions(ensemble=True), **SERIES)
    else:
        df = fitted_values(long_enough(costs, series_cols=["service"]), **SERIES)
    text = plan(df, run=True)
    assert text.count("FileScan") == 1 and "ReusedExchange" in text


def test_row_wise_operators_do_not_shuffle(spark):
    df = spark.createDataFrame([(d, "x", 1.0) for d in days_from("2025-01-01", 3)], "d date, g string, v double")
    names = {"date_col": "d", "value_col": "v"}
    for out in (
        clean_series(df, series_cols=["g"], **names),
        step_change(df, series_cols=["g"], start="2025-01-02", pct=0.1, **names),
        seasonality(df, preset="toys", **names),
    ):
        assert "Exchange" not in plan(out)


def test_gate_and_fit_share_the_series_exchange(spark, sf_dir):
    gated = long_enough(service_daily(spark, sf_dir), series_cols=["service"])
    text = plan(fit(gated, ForecastOptions(methods=("sma", "es", "theta")), **SERIES))
    assert text.count("Exchange hashpartitioning") == 2


def test_a_hot_group_is_combined_before_the_exchange(spark):
    """A third of all lines in one group: the exchange carries map-side sums, not lines."""
    lines = spark.range(0, 300_000, numPartitions=6).select(
        F.date_add(F.lit("2025-01-01").cast("date"), (F.col("id") % 20).cast("int")).alias("ts"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.format_string("g%d", F.col("id") % 50)).alias("g"),
        F.lit(0.25).alias("v"),
    )
    df = cost_by_period(lines, ts_col="ts", amount="v", group=dimension("g", "g"))
    rows = df.collect()
    assert sum(r.cost for r in rows) == 75_000.0
    assert sum(r.cost for r in rows if r.g == "hot") == 25_000.0
    shuffled = _shuffled_rows(df)
    assert shuffled is not None and shuffled <= 6 * len(rows)


def _shuffled_rows(df):
    def walk(node):
        if "Exchange" in node.nodeName():
            return node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        for i in range(children.size()):
            found = walk(children.apply(i))
            if found is not None:
                return found
        return None

    root = df._jdf.queryExecution().executedPlan()
    stages = root.executedPlan() if root.nodeName() == "AdaptiveSparkPlan" else root

    def find(node):
        if node.nodeName().startswith("ShuffleQueryStage"):
            return walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            found = find(children.apply(i))
            if found is not None:
                return found
        if node.nodeName().startswith("ResultQueryStage"):
            return find(node.plan())
        return None

    return find(stages)


@pytest.mark.parametrize("group", [None, dimension("user_id"), tag("props", "k")])
def test_every_grouping_has_one_exchange(spark, sf_dir, group):
    df = cost_by_period(table(spark, sf_dir, "events"), ts_col="ts", amount="value", group=group)
    assert plan(df).count("Exchange hashpartitioning") == 1
