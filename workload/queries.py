"""Registered queries.  Each reads whole tables and returns a lazy DataFrame."""

from __future__ import annotations

import datetime as dt
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendframe.functions.numbers import amount_text
from spendframe.operators import anomalies, budgets, clean, combine, events, generate, spine
from spendframe.operators.forecast import closed_forms as cf
from spendframe.operators.forecast import direct, forecast_rows, models, trees
from spendframe.operators.forecast import forecast_table as actuals_and_forecasts
from spendframe.operators.forecast.options import ForecastOptions
from spendframe.params import FORECAST_COLUMNS
from spendframe.plans import anomaly_report, cost_report, what_if
from spendframe.plans.reports import fitted_values
from spendframe.sinks.document import write_json_document
from spendframe.sinks.files import write_csv, write_report_pages
from spendframe.sources import reports
from spendframe.sources.budgets import parse_budgets
from spendframe.sources.files import read_input
from spendframe.sources.usage import cost_by_period, dimension
from workload.bindings import (
    SERIES,
    account_service_daily,
    line_daily,
    mixed_grains,
    monthly_pages,
    only,
    order_days,
    priority_monthly,
    region_budgets,
    report_pages,
    rounded,
    scratch,
    service_daily,
    supplier_daily,
    table,
    tag_daily,
    total_daily,
)

AS_OF = "2001-08-01"
DATES = {"series_cols": ["service"], "date_col": "period_start"}
REGISTRY: dict = {}


def query(function):
    REGISTRY[function.__name__] = function
    return function


# -- cost reports -----------------------------------------------------------------------------


@query
def cost_by_service_daily(spark, sf):
    return service_daily(spark, sf)


@query
def cost_by_account_daily(spark, sf):
    return cost_by_period(
        table(spark, sf, "events"), ts_col="ts", amount="value", group=dimension("user_id", "account")
    )


@query
def cost_by_tag_daily(spark, sf):
    return tag_daily(spark, sf)


@query
def cost_total_daily(spark, sf):
    return total_daily(spark, sf)


@query
def cost_exact_daily(spark, sf):
    costs = cost_by_period(table(spark, sf, "events"), ts_col="ts", amount="value", group=dimension("event_type", "service"), exact=True)
    return costs.withColumn("cost", F.col("cost").cast("string"))


@query
def cost_by_service_hourly(spark, sf):
    return cost_by_period(
        table(spark, sf, "events"),
        ts_col="ts",
        amount="value",
        grain="hourly",
        group=dimension("event_type", "service"),
    )


@query
def cost_by_priority_monthly(spark, sf):
    return priority_monthly(spark, sf)


@query
def cost_year_to_date(spark, sf):
    return cost_by_period(
        table(spark, sf, "lineitem"),
        ts_col="l_shipdate",
        amount=F.col("l_extendedprice") * (1 - F.col("l_discount")),
        group=dimension("l_returnflag", "service"),
        start="2001-01-01",
        end=AS_OF,
    )


@query
def cost_report_semester(spark, sf):
    return cost_report(
        table(spark, sf, "orders"),
        ts_col="o_orderdate",
        amount="o_totalprice",
        as_of="2000-11-20",
        grain="monthly",
        interval="semester",
        include_today=True,
        group=dimension("o_orderpriority", "Service"),
    )


@query
def report_json_grouped(spark, sf):
    return reports.grouped_rows(report_pages(service_daily(spark, sf)), "UnblendedCost", "Service")


@query
def report_json_total(spark, sf):
    return reports.total_rows(report_pages(total_daily(spark, sf)), "UnblendedCost")


@query
def report_json_pages(spark, sf):
    return reports.grouped_rows(monthly_pages(service_daily(spark, sf)), "UnblendedCost", "Service")


@query
def report_json_pages_total(spark, sf):
    return reports.total_rows(monthly_pages(service_daily(spark, sf)), "UnblendedCost")


@query
def report_pages_files(spark, sf):
    """Pages written raw and read back."""
    path = scratch(spark, "pages")
    write_report_pages(monthly_pages(service_daily(spark, sf)), path)
    return reports.grouped_rows(reports.read_report_pages(spark, path, lines=True), "UnblendedCost", "Service")


@query
def csv_files(spark, sf):
    """A series written as CSV, read back as text with its columns checked, and its dates held to be dates."""
    path = scratch(spark, "csv")
    write_csv(service_daily(spark, sf), path)
    rows = clean.strict_dates(read_input(spark, path, ["period_start", "cost"]), date_col="period_start")
    return rows.select("service", "period_start", F.col("cost").cast("double").alias("cost"))


@query
def json_document(spark, sf):
    """A report as one JSON document, read back."""
    path = f"{scratch(spark, 'document')}.json"
    write_json_document(service_daily(spark, sf), path, command="costs", parameters={"grain": "daily"}, as_of=dt.datetime(2001, 8, 1))
    rows = spark.read.option("multiLine", True).json(path).select("command", F.explode("data").alias("d"))
    return rows.select("command", "d.service", F.col("d.period_start").cast("date").alias("period_start"), "d.cost")


@query
def cost_explicit_range(spark, sf):
    return cost_report(
        table(spark, sf, "events"), ts_col="ts", amount="value", as_of=AS_OF, group=dimension("event_type", "Service"),
        start="2024-01-05", end="2024-01-20",
    )


@query
def report_pages_union(spark, sf):
    daily = report_pages(service_daily(spark, sf))
    monthly = report_pages(priority_monthly(spark, sf))
    return reports.grouped_rows(reports.union_pages(daily, monthly), "UnblendedCost", "Service")


@query
def report_amount_fmt(spark, sf):
    amount = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("n/a "), "event_type"))
        .when(F.col("event_type") == "signup", F.lit(None))
        .otherwise(F.col("value").cast("string"))
    )
    return table(spark, sf, "events").select("event_id", amount_text(amount).alias("amount"))


# -- cleaning ---------------------------------------------------------------------------------


@query
def clean_series(spark, sf):
    kind, value = F.col("event_type"), F.col("value").cast("string")
    raw = table(spark, sf, "events").select(
        "event_id",
        F.when(kind == "error", F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(" junk")))
        .when(kind == "click", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd"))
        .alias("day"),
        F.when(kind == "view", "NaN").when(kind == "signup", F.concat(value, F.lit("d"))).otherwise(value).alias("amount"),
        kind,
    )
    return clean.clean_series(raw, series_cols=["event_id"], date_col="day", value_col="amount")


@query
def series_length_gate(spark, sf):
    return clean.long_enough(account_service_daily(spark, sf), series_cols=["account", "service"])


@query
def series_skipped(spark, sf):
    return clean.skipped_series(account_service_daily(spark, sf), series_cols=["account", "service"])


@query
def distinct_groups(spark, sf):
    tagged = table(spark, sf, "events").select(F.get_json_object("props", "$['k']").alias("tag_value"))
    return clean.distinct_groups(tagged, "tag_value")


# -- calendar ---------------------------------------------------------------------------------


@query
def infer_granularity(spark, sf):
    return spine.series_spans(mixed_grains(spark, sf), series_cols=["kind", "service"], date_col="period_start")


@query
def forecast_dates(spark, sf):
    names = ["kind", "service"]
    spans = spine.series_spans(mixed_grains(spark, sf), series_cols=names, date_col="period_start")
    return spine.forecast_dates(spans, series_cols=names, date_col="period_start")


@query
def milestone_dates(spark, sf):
    return spine.milestone_dates(order_days(spark, sf, "last_date"), series_cols=[])


@query
def date_range_matrix(spark, sf):
    return spine.report_ranges(order_days(spark, sf, "as_of"), as_of_col="as_of")


@query
def anomaly_dates(spark, sf):
    return spine.anomaly_dates(order_days(spark, sf, "as_of"), as_of_col="as_of")


# -- forecasts --------------------------------------------------------------------------------


def one_method(series: DataFrame, method: str, names=None, digits: int = 4, **settings) -> DataFrame:
    names = names or SERIES
    rows = forecast_rows(series, only(method, **settings), **names)
    value = F.round(method, digits).alias("value")
    return rows.select(*names["series_cols"], names["date_col"], value)


def darts_rows(series: DataFrame, algorithm: str, **settings) -> DataFrame:
    rows = forecast_rows(series, only(darts_algorithm=algorithm, **settings), **SERIES)
    return rows.select("service", "period_start", F.round("darts", 4).alias("value"))


@query
def forecast_sma(spark, sf):
    return one_method(line_daily(spark, sf), "sma")


@query
def forecast_es(spark, sf):
    return one_method(line_daily(spark, sf), "es")


@query
def forecast_hw(spark, sf):
    return one_method(priority_monthly(spark, sf), "hw")


@query
def forecast_hw_daily(spark, sf):
    return one_method(line_daily(spark, sf), "hw", hw_seasonal_periods=7)


@query
def forecast_hw_short(spark, sf):
    names = {**SERIES, "series_cols": ["account", "service"]}
    return one_method(account_service_daily(spark, sf), "hw", names, hw_seasonal_periods=20)


@query
def forecast_theta(spark, sf):
    return one_method(line_daily(spark, sf), "theta")


@query
def forecast_constant_guard(spark, sf):
    costs = service_daily(spark, sf)
    lines = table(spark, sf, "events")
    flat = lines.groupBy(F.col("event_type").alias("service"), F.col("ts").cast("date").alias("period_start")).agg(
        F.round(F.max(F.length("event_type") / F.lit(3.0)), 6).alias("cost")
    )
    both = costs.select(F.lit("cost").alias("kind"), "service", "period_start", "cost").unionByName(
        flat.select(F.lit("flat").alias("kind"), "service", "period_start", "cost")
    )
    return one_method(both, "neural_prophet", {**SERIES, "series_cols": ["kind", "service"]}, network_trained=False)


@query
def forecast_ar1_diff(spark, sf):
    state = cf.ar1_difference_state(line_daily(spark, sf), **SERIES)
    spans = state.withColumn("grain", F.lit("daily"))
    rows = spans.select("*", F.explode(F.sequence(F.lit(1), F.lit(365))).alias("step"))
    value = F.round(cf.ar1_difference_value(F.col("step")), 4).alias("value")
    return rows.select("service", F.date_add("last_date", F.col("step")).alias("period_start"), value)


@query
def forecast_arima_110(spark, sf):
    return one_method(line_daily(spark, sf), "arima", arima_order=(1, 1, 0), arma_estimator="least_squares")


@query
def forecast_arima_110_exact(spark, sf):
    return one_method(line_daily(spark, sf), "arima", digits=1, arima_order=(1, 1, 0))


@query
def forecast_arima(spark, sf):
    # two searches for one optimum agree to seven digits
    return one_method(line_daily(spark, sf), "arima", digits=-2)


@query
def forecast_sarima_111_010(spark, sf):
    """The seasonal difference and a plain ARMA: with no seasonal coefficient, SQL can search for the rest."""
    settings = {"sarima_order": (1, 1, 1), "sarima_seasonal_order": (0, 1, 0, 12)}
    return one_method(priority_monthly(spark, sf), "sarima", digits=-4, **settings)


@query
def forecast_seasonal_naive(spark, sf):
    return one_method(
        priority_monthly(spark, sf), "sarima", sarima_order=(0, 0, 0), sarima_seasonal_order=(0, 1, 0, 12)
    )


@query
def forecast_sarima(spark, sf):
    return one_method(priority_monthly(spark, sf), "sarima")


@query
def forecast_trend_line(spark, sf):
    unpenalised = {"changepoint_scale": float("inf"), "season_scale": float("inf")}
    return one_method(line_daily(spark, sf), "prophet", digits=2, yearly=False, **unpenalised)


@query
def forecast_fourier_trend(spark, sf):
    return one_method(line_daily(spark, sf), "prophet")


@query
def sarima_models(spark, sf):
    """Whether the fitted product is at a maximum of the likelihood and keeps within its bounds, series by series."""
    found = models.arma_models(priority_monthly(spark, sf), (1, 1, 1), (1, 1, 1, 12), **SERIES)
    own = [F.col(c)[0] for c in ("ar", "seasonal_ar", "ma", "seasonal_ma")]
    inside = F.array_max(F.array(*map(F.abs, own))) < 1
    return found.select("service", inside.alias("inside"), (F.col("margin") > -1e-4).alias("at_maximum"), F.size("ar").alias("n_ar"))


@query
def trend_models(spark, sf):
    """Whether every bend obeys its optimality condition, and most are exactly zero."""
    found = models.trend_models(line_daily(spark, sf), **SERIES)
    zeros = F.size(F.filter("bends", lambda b: b == 0))
    return found.select(
        "service", F.size("bends").alias("n_bends"), (zeros * 2 > F.size("bends")).alias("mostly_zero"), (F.col("worst_subgradient") < 1e-6).alias("optimal")
    )


@query
def smoothing_models(spark, sf):
    """Whether fitted weights err no more than the fixed ones, series by series."""
    found = models.smoothing_models(priority_monthly(spark, sf), **SERIES)
    inside = (F.col("alpha") <= 1) & (F.col("beta") <= F.col("alpha")) & (F.col("gamma") <= 1 - F.col("alpha"))
    return found.select("service", (F.col("error") <= F.col("fixed_error") * (1 + 1e-9)).alias("no_worse"), inside.alias("inside"), F.size("first").alias("n_states"))


@query
def forecast_theta_seasonal(spark, sf):
    rows = forecast_rows(priority_monthly(spark, sf), only(darts_algorithm="theta"), **SERIES)
    return rows.select("service", "period_start", F.round("darts", 2).alias("value"))


@query
def forecast_smoothing(spark, sf):
    return darts_rows(priority_monthly(spark, sf), "exponential_smoothing")


@query
def forecast_network(spark, sf):
    return one_method(line_daily(spark, sf), "neural_prophet", weekly=True)


@query
def lag_features(spark, sf):
    return trees.lag_features(line_daily(spark, sf), **SERIES)


@query
def forecast_lag1_linear(spark, sf):
    return darts_rows(line_daily(spark, sf), "linear_regression", lags=1)


@query
def forecast_lag_linear(spark, sf):
    return darts_rows(line_daily(spark, sf), "linear_regression")


def monthly_arrays(spark, sf) -> DataFrame:
    series = priority_monthly(spark, sf).select("service", "period_start", "cost")
    numbered = cf.number_from_newest(series, **SERIES)
    return numbered.groupBy("service").agg(cf.values_oldest_first(F.col("cost")).alias("v"), F.lit(12).alias("steps"))


@query
def direct_design(spark, sf):
    """The rows that the tree models learn from."""
    rows = direct.design_rows(monthly_arrays(spark, sf), series_cols=["service"], values="v", steps="steps")
    lags = [F.round(F.col("features")[k], 6).alias(f"lag_{k + 1}") for k in range(12)]
    return rows.select("service", "origin", "step", F.round("label", 6).alias("label"), *lags)


@query
def boosting_first_split(spark, sf):
    """Gain of each split of the first tree's root, from the histograms that the boosting is grown on."""
    rows = direct.design_rows(monthly_arrays(spark, sf), series_cols=["service"], values="v", steps="steps")
    settings = direct.Boosting()
    root = direct.Tree(np.array([-1]), np.array([0]), np.array([0.0]))
    found = direct.histograms(rows, 1.0, [], root, 0, settings)
    window = Window.partitionBy("feature").orderBy("bin")
    g, h = F.col("g") / 2.0**direct.UNIT, F.col("h")
    each = found.select("feature", "bin", F.sum(g).over(window).alias("gl"), F.sum(h).over(window).alias("hl"))
    whole = found.groupBy("feature").agg(F.sum(g).alias("g"), F.sum(h).alias("h"))
    each = each.join(whole, "feature").where("hl < h")

    def term(a, b):
        return a * a / (b + settings.ridge)

    gain = 0.5 * (term(F.col("gl"), F.col("hl")) + term(F.col("g") - F.col("gl"), F.col("h") - F.col("hl")) - term(F.col("g"), F.col("h")))
    return each.select("feature", "bin", F.col("hl").cast("long").alias("rows_left"), F.round(gain, 3).alias("gain"))


@query
def forecast_lag_forest(spark, sf):
    return darts_rows(priority_monthly(spark, sf), "random_forest")


@query
def forecast_lag_gbt(spark, sf):
    return darts_rows(priority_monthly(spark, sf), "xgboost")


@query
def forecast_auto_order(spark, sf):
    return darts_rows(priority_monthly(spark, sf), "auto_arima")


@query
def rolling_sma(spark, sf):
    names = {**SERIES, "series_cols": ["account", "service"]}
    return rounded(anomalies.rolling_mean(account_service_daily(spark, sf), **names), "value")


@query
def rolling_es(spark, sf):
    return rounded(anomalies.rolling_smoothing(line_daily(spark, sf), **SERIES), "value", digits=2)


# -- combining --------------------------------------------------------------------------------

BLEND = ForecastOptions(ensemble=True)


@query
def forecast_table(spark, sf):
    return rounded(actuals_and_forecasts(service_daily(spark, sf), BLEND, **SERIES), *FORECAST_COLUMNS)


@query
def forecast_table_monthly(spark, sf):
    return rounded(actuals_and_forecasts(priority_monthly(spark, sf), BLEND, **SERIES), *FORECAST_COLUMNS)


@query
def forecast_table_suppliers(spark, sf):
    table_ = actuals_and_forecasts(supplier_daily(spark, sf), BLEND, **SERIES)
    return rounded(table_, *FORECAST_COLUMNS, digits=2)


@query
def forecast_ensemble(spark, sf):
    rows = forecast_rows(priority_monthly(spark, sf), BLEND, **SERIES)
    return rows.select("service", "period_start", F.round("ensemble", 4).alias("value"))


@query
def forecast_long(spark, sf):
    return rounded(combine.forecast_long(actuals_and_forecasts(service_daily(spark, sf), BLEND, **SERIES), **DATES), "value")


@query
def milestone_summary(spark, sf):
    rows = forecast_rows(service_daily(spark, sf), BLEND, **SERIES)
    return rounded(combine.milestone_summary(rows, **DATES), "total", digits=3)


@query
def milestone_text(spark, sf):
    rows = forecast_rows(service_daily(spark, sf), only("sma"), **SERIES)
    sums = combine.milestone_summary(rows, methods=("sma",), **DATES)
    return combine.milestone_lines(sums, series_cols=["service"])


@query
def forecast_horizon_30(spark, sf):
    cut = combine.forecast_horizon(actuals_and_forecasts(service_daily(spark, sf), BLEND, **SERIES), 30, **DATES)
    return rounded(cut, *FORECAST_COLUMNS)


# -- budgets ----------------------------------------------------------------------------------


def budget_rows(spark, sf, costs=None, chosen=None) -> DataFrame:
    return budgets.compare_with_budgets(
        costs if costs is not None else service_daily(spark, sf),
        chosen if chosen is not None else region_budgets(spark, sf),
        date_col="period_start",
        cost_col="cost",
        keep=("service",),
    )


def rounded_budget(df: DataFrame) -> DataFrame:
    return rounded(df, "Variance", "VariancePercent", digits=6)


@query
def budget_amounts(spark, sf):
    nations = table(spark, sf, "nation")
    limit = F.when(
        F.col("n_regionkey") > 0,
        F.struct((F.col("n_nationkey") * 10.5).cast("string").alias("Amount"), F.lit("USD").alias("Unit")),
    )
    record = F.struct(F.col("n_name").alias("BudgetName"), limit.alias("BudgetLimit"))
    doc = F.to_json(F.struct(F.array(record).alias("Budgets")))
    return parse_budgets(nations.select(doc.alias("doc")), "doc")


@query
def budget_all(spark, sf):
    return rounded_budget(budget_rows(spark, sf))


@query
def budget_single(spark, sf):
    return rounded_budget(budget_rows(spark, sf, chosen=budgets.budget_by_name(region_budgets(spark, sf), "ASIA")))


@query
def budget_status_counts(spark, sf):
    return budgets.status_counts(budget_rows(spark, sf))


@query
def budget_alerts(spark, sf):
    lines = budgets.alert_lines(budget_rows(spark, sf))
    return rounded_budget(lines)


@query
def budget_by_dimension(spark, sf):
    """Event types as teams: each has a budget of its own, held against its month."""
    named = table(spark, sf, "events").select(F.col("event_type").alias("BudgetName")).distinct()
    limits = named.withColumn("BudgetAmount", F.length("BudgetName") * 5000.0)
    rows = budgets.compare_by_dimension(
        service_daily(spark, sf), limits, dimension_col="service", date_col="period_start", cost_col="cost"
    )
    return rounded(rounded_budget(rows), "ActualCost", digits=4)


@query
def budget_many_status(spark, sf):
    """Six budgets for each part against daily costs, counted by day and status."""
    steps = F.array(*[F.lit(k) for k in range(6)])
    many = table(spark, sf, "part").select("p_partkey", "p_retailprice", F.explode(steps).alias("k"))
    limits = many.select(
        F.concat_ws("-", "p_partkey", "k").alias("BudgetName"), (F.col("p_retailprice") * F.col("k") * 2).alias("BudgetAmount")
    )
    return budget_rows(spark, sf, chosen=limits).groupBy("PeriodStart", "Status").agg(F.count(F.lit(1)).alias("row_count"))


@query
def budget_missing_cost(spark, sf):
    gaps = service_daily(spark, sf).withColumn(
        "cost", F.when(F.col("service") == "error", F.lit(float("nan"))).otherwise(F.col("cost"))
    )
    return rounded_budget(budget_rows(spark, sf, costs=gaps))


@query
def budget_json_rows(spark, sf):
    rows = budget_rows(spark, sf)
    text = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("row"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rounded_budget(text.select(F.from_json("row", schema).alias("r")).select("r.*"))


# -- anomalies --------------------------------------------------------------------------------


def compared(spark, sf, methods) -> DataFrame:
    names = {"series_cols": ["service"], "date_col": "period_start", "value_col": "cost"}
    values = fitted_values(line_daily(spark, sf), methods=methods, **names)
    rows = anomalies.compare_periods(
        values, as_of=AS_OF, group_cols=["service"], date_col="period_start", threshold=20.0
    )
    return rounded(rows, "change_pct")


@query
def anomaly_rolling_sma(spark, sf):
    return compared(spark, sf, ["sma"])


@query
def anomaly_rolling_es(spark, sf):
    return compared(spark, sf, ["es"])


@query
def anomaly_fitted_trend(spark, sf):
    return compared(spark, sf, ["prophet"])


@query
def anomaly_periods(spark, sf):
    report = anomaly_report(
        table(spark, sf, "lineitem"),
        ts_col="l_shipdate",
        amount=F.col("l_extendedprice") * (1 - F.col("l_discount")),
        as_of=AS_OF,
        threshold=20.0,
        group=dimension("l_returnflag", "service"),
    )
    return rounded(report, "change_pct")


@query
def anomaly_text(spark, sf):
    return anomalies.summary_text(anomaly_periods(spark, sf), group_col="group_key")


@query
def percent_diff(spark, sf):
    series = line_daily(spark, sf)
    change = anomalies.change_since(series, 7, series_cols=["service"], date_col="period_start", value_col="cost")
    return rounded(change, "change_pct").select("service", "period_start", "change_pct")


# -- what-if events ---------------------------------------------------------------------------


@query
def step_change_pct(spark, sf):
    return rounded(events.step_change(service_daily(spark, sf), start="2024-01-11", pct=0.25, **SERIES), "cost", digits=6)


@query
def step_change_value(spark, sf):
    return rounded(events.step_change(line_daily(spark, sf), start="1998-03-01", value=-250000.0, **SERIES), "cost", digits=6)


@query
def spike_pct(spark, sf):
    return rounded(events.spike(line_daily(spark, sf), start="1998-03-01", length=14, pct=0.5, **SERIES), "cost", digits=6)


@query
def spike_value(spark, sf):
    return rounded(events.spike(priority_monthly(spark, sf), start="1998-03-15", length=5, value=1234.5, **SERIES), "cost", digits=6)


@query
def deep_pct(spark, sf):
    return rounded(events.dip(line_daily(spark, sf), start="1999-12-25", length=10, pct=0.3, **SERIES), "cost", digits=6)


@query
def deep_value_clamped(spark, sf):
    """Net of a fixed credit per line, so that some days are below zero before the change."""
    net = cost_by_period(
        table(spark, sf, "lineitem"),
        ts_col="l_shipdate",
        amount=F.col("l_extendedprice") - 38000.0,
        group=dimension("l_returnflag", "service"),
    )
    return rounded(events.dip(net, start="1998-01-01", length=30, value=50000.0, **SERIES), "cost", digits=6)


@query
def event_note(spark, sf):
    noted = events.spike(service_daily(spark, sf), start="2024-01-15", length=3, pct=0.5, note="launch", **SERIES)
    return rounded(noted, "cost", digits=6)


@query
def event_note_append(spark, sf):
    series = service_daily(spark, sf)
    once = events.annotate(series, start="2024-01-15", note="launch", **DATES)
    changed = what_if(
        once,
        partial(events.dip, start="2024-01-15", length=2, value=10.0, note="outage", **SERIES),
        partial(events.step_change, start="2024-01-20", pct=0.5, note="new price", **SERIES),
    )
    return rounded(changed, "cost", digits=6)


def seasonal(spark, sf, **shape) -> DataFrame:
    scaled = events.seasonality(priority_monthly(spark, sf), date_col="period_start", value_col="cost", **shape)
    return rounded(scaled, "cost")


@query
def seasonality_toys(spark, sf):
    return seasonal(spark, sf, preset="toys")


@query
def seasonality_holidays(spark, sf):
    return seasonal(spark, sf, preset="holidays")


@query
def seasonality_custom(spark, sf):
    return seasonal(spark, sf, factors="1, 1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 1.7, 1.8, 1.9, 2, 0")


@query
def random_spikes(spark, sf):
    return rounded(events.random_spikes(line_daily(spark, sf), max_pct=0.4, prob=0.2, **SERIES), "cost")


# -- generated series -------------------------------------------------------------------------


def specs(spark, sf) -> DataFrame:
    """One specification per supplier."""
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("series"),
        F.col("s_acctbal").alias("baseline"),
        (F.col("s_nationkey") * 2.5).alias("trend"),
    )


def generated(spark, sf, pattern: str, noise: float = 0.0, **settings) -> DataFrame:
    start = F.lit("2024-01-15").cast("date")
    made = generate.generate_series(
        specs(spark, sf), series_cols=["series"], pattern=pattern, start=start, noise=noise, **settings
    )
    return rounded(made, "cost")


@query
def gen_dates(spark, sf):
    days = order_days(spark, sf, "day")
    forward = generate.generate_dates(days, series_cols=["day"], grain="monthly", start=F.col("day"), periods=6)
    back = generate.generate_dates(days, series_cols=["day"], grain="daily", end=F.col("day"), periods=6)
    named = [
        df.select(F.lit(kind).alias("kind"), "day", "period_start")
        for kind, df in (("monthly", forward), ("daily", back))
    ]
    return named[0].unionByName(named[1])


@query
def gen_upward(spark, sf):
    return generated(spark, sf, "upward_trend")


@query
def gen_downward(spark, sf):
    return generated(spark, sf, "downward_trend", trend=-75.0)


@query
def gen_step(spark, sf):
    return generated(spark, sf, "step_change", grain="monthly")


@query
def gen_spike(spark, sf):
    return generated(spark, sf, "spike", periods=20)


@query
def gen_flat(spark, sf):
    return generated(spark, sf, "flat")


@query
def gen_noise(spark, sf):
    return generated(spark, sf, "flat", noise=0.1)
