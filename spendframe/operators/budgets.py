"""Costs against budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.functions.dates import period_start
from spendframe.functions.numbers import nan_to_null, ratio
from spendframe.params import require_columns

DEFAULT_THRESHOLD = 80.0
# Status names
NO_BUDGET, OVER_BUDGET, THRESHOLD_BREACH, UNDER_BUDGET = (
    "NO_BUDGET",
    "OVER_BUDGET",
    "THRESHOLD_BREACH",
    "UNDER_BUDGET",
)
# Parts that cost rows are spread over; each is joined with all budgets.
LANES = 64


def variance_amount(actual: Column, budget: Column) -> Column:
    return F.when(budget == 0, F.lit(0.0)).otherwise(budget - actual)


def variance_percent(actual: Column, budget: Column) -> Column:
    return F.when(budget == 0, F.lit(0.0)).otherwise(ratio(actual - budget, budget) * 100.0)


def budget_status(actual: Column, budget: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    """A missing cost compares as NULL and so ends in UNDER_BUDGET."""
    used = ratio(actual, budget) * 100.0
    return (
        F.when(budget == 0, NO_BUDGET)
        .when(used >= 100, OVER_BUDGET)
        .when(used >= threshold, THRESHOLD_BREACH)
        .otherwise(UNDER_BUDGET)
    )


def budget_by_name(budgets: DataFrame, name: str) -> DataFrame:
    """The budget of that name; raises when there is none (a lookup on the budget table only)."""
    found = budgets.filter(F.col("BudgetName") == name).limit(1)
    if found.isEmpty():
        raise ValueError(f"no budget named {name!r}")
    return found


def _pair(costs: DataFrame, budgets: DataFrame, lanes: int) -> DataFrame:
    """Cost rows spread over lanes by a hash of the row, and joined with a copy of the budgets per lane.

    Both sides are shuffled by the lane and neither is broadcast: the hint keeps the optimizer from
    judging the copies by the size of one.  A hot day or group is spread; equal rows share a lane,
    which adaptive execution splits if it grows.
    """
    spread = costs.withColumn("_lane", F.pmod(F.xxhash64(*costs.columns), F.lit(lanes)).cast("int"))
    copies = budgets.withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    return spread.join(copies.hint("shuffle_hash"), "_lane").drop("_lane")


def compare_with_budgets(
    costs: DataFrame,
    budgets: DataFrame,
    *,
    date_col: str = "PeriodStart",
    cost_col: str = "UnblendedCost",
    keep: tuple[str, ...] = (),
    threshold: float = DEFAULT_THRESHOLD,
    lanes: int = LANES,
) -> DataFrame:
    """Hold every cost row against every budget.

    That is a product by its meaning: ``lanes`` is how many tasks share it.  ``compare_by_dimension``
    is the form for budgets that are meant for one group and a whole period.
    """
    require_columns(costs, [date_col, cost_col, *keep])
    require_columns(budgets, ["BudgetName", "BudgetAmount"])
    rows = costs.select(
        F.col(date_col).alias("PeriodStart"),
        *keep,
        nan_to_null(F.col(cost_col).cast("double")).alias("ActualCost"),
    )
    budgets = budgets.select("BudgetName", "BudgetAmount")
    paired = _pair(rows, budgets, lanes)
    return _compared(paired, keep, threshold)


def compare_by_dimension(
    costs: DataFrame,
    budgets: DataFrame,
    *,
    dimension_col: str,
    date_col: str = "PeriodStart",
    cost_col: str = "UnblendedCost",
    budget_col: str = "BudgetName",
    grain: str = "monthly",
    threshold: float = DEFAULT_THRESHOLD,
) -> DataFrame:
    """Costs summed to the budget's period and group, against the budget of that group only.

    The sums combine on the map side; the join is on the group's name.  Groups without a budget and
    budgets without costs have no rows.
    """
    require_columns(costs, [date_col, cost_col, dimension_col])
    require_columns(budgets, [budget_col, "BudgetAmount"])
    cost = nan_to_null(F.col(cost_col).cast("double"))
    totals = costs.groupBy(period_start(F.col(date_col), grain).alias("PeriodStart"), F.col(dimension_col).alias("_group")).agg(
        F.sum(cost).alias("ActualCost")
    )
    named = budgets.select(F.col(budget_col).alias("BudgetName"), "BudgetAmount")
    return _compared(totals.join(named, F.col("_group") == F.col("BudgetName")), (), threshold)


def _compared(paired: DataFrame, keep: tuple[str, ...], threshold: float) -> DataFrame:
    actual, amount = F.col("ActualCost"), F.col("BudgetAmount")
    return paired.select(
        "PeriodStart",
        *keep,
        "BudgetName",
        "BudgetAmount",
        "ActualCost",
        variance_amount(actual, amount).alias("Variance"),
        variance_percent(actual, amount).alias("VariancePercent"),
        budget_status(actual, amount, threshold).alias("Status"),
    )


def breaches(compared: DataFrame) -> DataFrame:
    return compared.filter(F.col("Status").isin(THRESHOLD_BREACH, OVER_BUDGET))


def alert_lines(compared: DataFrame) -> DataFrame:
    """Breaches with a printable ``alert`` line."""
    line = F.format_string(
        "  - %s: %.2f vs %.2f (%.1f%% variance)", "BudgetName", "ActualCost", "BudgetAmount", "VariancePercent"
    )
    return breaches(compared).withColumn("alert", line)


def status_counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("BudgetName", "Status").agg(F.count(F.lit(1)).alias("row_count"))
