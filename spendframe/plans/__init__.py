"""Whole reports: operators chained into one lazy plan."""

from spendframe.plans.reports import anomaly_report, budget_report, cost_report, forecast_report, what_if

__all__ = ["anomaly_report", "budget_report", "cost_report", "forecast_report", "what_if"]
