"""Roles of the test tables: which columns act as usage lines, services, accounts, budgets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendframe.operators.forecast.options import ForecastOptions
from spendframe.session import shared_folder
from spendframe.sources.reports import parse_report_pages
from spendframe.sources.usage import cost_by_period, dimension, everything, tag

SERIES = {"series_cols": ["service"], "date_col": "period_start", "value_col": "cost"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def service_daily(spark, sf_dir) -> DataFrame:
    """30 days, one series per event type."""
    return cost_by_period(
        table(spark, sf_dir, "events"), ts_col="ts", amount="value", group=dimension("event_type", "service")
    )


def account_service_daily(spark, sf_dir) -> DataFrame:
    """Many short series: one per user and event type."""
    events = table(spark, sf_dir, "events")
    keyed = events.withColumn("_key", F.struct("user_id", "event_type"))
    costs = cost_by_period(keyed, ts_col="ts", amount="value", group=dimension("_key", "k"))
    return costs.select(
        F.col("k.user_id").alias("account"), F.col("k.event_type").alias("service"), "period_start", "cost"
    )


def line_daily(spark, sf_dir) -> DataFrame:
    """Seven years of days, one series per return flag."""
    return cost_by_period(
        table(spark, sf_dir, "lineitem"),
        ts_col="l_shipdate",
        amount=F.col("l_extendedprice") * (1 - F.col("l_discount")),
        group=dimension("l_returnflag", "service"),
    )


def supplier_daily(spark, sf_dir) -> DataFrame:
    """One daily series per supplier: the number of series grows with the tables."""
    return cost_by_period(
        table(spark, sf_dir, "lineitem"),
        ts_col="l_shipdate",
        amount=F.col("l_extendedprice") * (1 - F.col("l_discount")),
        group=dimension("l_suppkey", "service"),
    )


def priority_monthly(spark, sf_dir) -> DataFrame:
    """80 months, one series per order priority."""
    return cost_by_period(
        table(spark, sf_dir, "orders"),
        ts_col="o_orderdate",
        amount="o_totalprice",
        grain="monthly",
        group=dimension("o_orderpriority", "service"),
    )


def priority_month_ends(spark, sf_dir) -> DataFrame:
    """The monthly series dated by the last day of the month."""
    return priority_monthly(spark, sf_dir).withColumn("period_start", F.last_day("period_start"))


def mixed_grains(spark, sf_dir) -> DataFrame:
    """Daily, first-of-month and end-of-month series side by side."""
    parts = {
        "daily": service_daily(spark, sf_dir),
        "firsts": priority_monthly(spark, sf_dir),
        "ends": priority_month_ends(spark, sf_dir),
    }
    named = [df.select(F.lit(kind).alias("kind"), "service", "period_start", "cost") for kind, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


def order_days(spark, sf_dir, name: str) -> DataFrame:
    """Every date an order was placed on."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias(name)).distinct()


def region_budgets(spark, sf_dir) -> DataFrame:
    """One budget per region; the first region's is zero."""
    return table(spark, sf_dir, "region").select(
        F.col("r_name").alias("BudgetName"), (F.col("r_regionkey") * 1000.0).alias("BudgetAmount")
    )


def _measure(metric: str, amount):
    return F.create_map(F.lit(metric), F.struct(amount.alias("Amount"), F.lit("USD").alias("Unit")))


def report_pages(costs: DataFrame, metric: str = "UnblendedCost") -> DataFrame:
    """Report JSON with one page per cost row, written and parsed back."""
    amount = F.col("cost").cast("string")
    start = F.col("period_start").cast("string")
    period = F.struct(
        F.struct(start.alias("Start"), start.alias("End")).alias("TimePeriod"),
        _measure(metric, amount).alias("Total"),
        F.array(
            F.struct(F.array("service").alias("Keys"), _measure(metric, amount).alias("Metrics"))
        ).alias("Groups"),
    )
    page = F.to_json(F.struct(F.array(period).alias("ResultsByTime")))
    return parse_report_pages(costs.select(page.alias("page")), "page")


def monthly_pages(costs: DataFrame, metric: str = "UnblendedCost") -> DataFrame:
    """Report JSON with a page a month: several periods, several groups each, and on the 13th another metric only."""
    named = F.when(F.dayofmonth("period_start") == 13, "Other").otherwise(metric)
    measures = F.create_map(named, F.struct(F.col("cost").cast("string").alias("Amount"), F.lit("USD").alias("Unit")))
    groups = F.collect_list(F.struct(F.array("service").alias("Keys"), measures.alias("Metrics"))).alias("Groups")
    whole = F.struct(F.count("*").cast("string").alias("Amount"), F.lit("lines").alias("Unit"))
    start = F.col("period_start").cast("string")
    periods = costs.groupBy("period_start").agg(groups, whole.alias("_whole")).select(
        F.trunc("period_start", "month").alias("month"),
        F.struct(F.struct(start.alias("Start"), start.alias("End")).alias("TimePeriod"), F.create_map(F.lit(metric), F.col("_whole")).alias("Total"), "Groups").alias("_period"),
    )
    pages = periods.groupBy("month").agg(F.collect_list("_period").alias("ResultsByTime"))
    return parse_report_pages(pages.select(F.to_json(F.struct("ResultsByTime")).alias("page")), "page")


def scratch(spark, name: str) -> str:
    """A path of its own in the folder that executors share, else in the warehouse."""
    folder = shared_folder(spark) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def total_daily(spark, sf_dir) -> DataFrame:
    return cost_by_period(
        table(spark, sf_dir, "events"), ts_col="ts", amount="value", group=everything(), group_col="service"
    )


def tag_daily(spark, sf_dir) -> DataFrame:
    return cost_by_period(
        table(spark, sf_dir, "events"), ts_col="ts", amount="value", group=tag("props", "k"), group_col="tag_value"
    )


def only(*methods: str, **settings) -> ForecastOptions:
    return ForecastOptions(methods=methods, **settings)
