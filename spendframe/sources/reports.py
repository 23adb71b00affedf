"""Cost-report JSON pages -> rows.

A page is ``{"ResultsByTime": [{"TimePeriod", "Total", "Groups": [{"Keys", "Metrics"}]}]}``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendframe.functions.numbers import amount_text
from spendframe.params import metric_name

_MEASURES = "map<string, struct<Amount: string, Unit: string>>"
PAGE_SCHEMA = (
    "ResultsByTime array<struct<"
    "TimePeriod: struct<Start: string, End: string>, "
    f"Total: {_MEASURES}, "
    f"Groups: array<struct<Keys: array<string>, Metrics: {_MEASURES}>>>>, "
    "NextPageToken string"
)
TOTAL_KEY = "Total"


def read_report_pages(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Report files, one JSON document each, or with ``lines`` one document a line (such files are
    read in splits).  A directory or glob reads all pages of a report at once, which is the union of
    the pages.  A page that does not parse fails the query: dropping it would lose costs."""
    return spark.read.schema(PAGE_SCHEMA).option("multiLine", not lines).option("mode", "FAILFAST").json(path)


def parse_report_pages(df: DataFrame, json_col: str) -> DataFrame:
    """The same table from a text column that holds one page per row; a bad page fails the query."""
    page = F.from_json(F.col(json_col), PAGE_SCHEMA, {"mode": "FAILFAST"})
    return df.select(page.alias("_page")).select("_page.*")


def union_pages(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Append the periods of further pages."""
    for page in rest:
        first = first.unionByName(page)
    return first


def _amount(measures: Column, metric: str) -> Column:
    return F.try_element_at(measures, F.lit(metric)).getField("Amount")


def grouped_rows(pages: DataFrame, metric: str | None = None, group_name: str = "Group") -> DataFrame:
    """One row per period and group: ``PeriodStart, <group_name>, <metric>`` (amount as text)."""
    metric = metric_name(metric)
    periods = pages.select(F.explode("ResultsByTime").alias("p"))
    groups = periods.select(F.col("p.TimePeriod.Start").alias("PeriodStart"), F.explode("p.Groups").alias("g"))
    return groups.select(
        "PeriodStart",
        F.get("g.Keys", F.lit(0)).alias(group_name),
        amount_text(_amount(F.col("g.Metrics"), metric)).alias(metric),
    )


def total_rows(pages: DataFrame, metric: str | None = None) -> DataFrame:
    """One row per period with the report's total under the key ``Total``."""
    metric = metric_name(metric)
    periods = pages.select(F.explode("ResultsByTime").alias("p"))
    return periods.select(
        F.col("p.TimePeriod.Start").alias("PeriodStart"),
        F.lit(TOTAL_KEY).alias("Group"),
        amount_text(_amount(F.col("p.Total"), metric)).alias(metric),
    )
