"""Cost per period and group, kept current while usage lines arrive.

Row-wise operators (budget comparison, step changes, seasonality, cleaning) hold no state and
take a streaming DataFrame as they are; only the aggregate needs a watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.functions.dates import period_start
from spendframe.functions.numbers import nan_to_null
from spendframe.params import REPORT_DECIMALS, require_columns
from spendframe.sources.usage import Group, everything


def cost_by_period_stream(
    usage: DataFrame,
    *,
    ts_col: str,
    amount: str | Column,
    late_by: str,
    grain: str = "daily",
    group: Group | None = None,
    period_col: str = "period_start",
    group_col: str | None = None,
    cost_col: str = "cost",
) -> DataFrame:
    """Like ``cost_by_period``, with the period start as event time.

    A period closes once a period ``late_by`` later has been seen: append mode emits it then, and
    its state, one sum per group, is dropped.  Update mode emits it at every change.
    """
    require_columns(usage, [ts_col])
    group = group or everything()
    name = group_col or group.name
    cost = F.col(amount) if isinstance(amount, str) else amount
    period = period_start(F.col(ts_col), grain)
    lines = usage.select(
        period.cast("timestamp").alias("_period"),  # a watermark needs an instant
        group.key(usage).alias(name),
        nan_to_null(cost.cast("double")).alias(cost_col),
    )
    sums = lines.withWatermark("_period", late_by).groupBy("_period", F.col(f"`{name}`"))
    totals = sums.agg(F.round(F.sum(cost_col), REPORT_DECIMALS).alias(cost_col))
    kind = "timestamp_ntz" if grain == "hourly" else "date"
    return totals.select(F.col("_period").cast(kind).alias(period_col), F.col(f"`{name}`"), cost_col)
