"""Named values and parameter checks.  Everything here runs on the driver, before a plan exists."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame

# ---------------------------------------------------------------------------
# Names, labels and defaults that results depend on.
# ---------------------------------------------------------------------------
COST_METRICS = (
    "BlendedCost",
    "UnblendedCost",
    "AmortizedCost",
    "NetAmortizedCost",
    "NetUnblendedCost",
    "UsageQuantity",
    "NormalizedUsageAmount",
)
DEFAULT_METRIC = "UnblendedCost"
GRAINS = ("hourly", "daily", "monthly")
INTERVALS = (None, "day", "week", "month", "quarter", "semester", "year")
FORECAST_METHODS = (
    "sma",
    "es",
    "hw",
    "arima",
    "sarima",
    "theta",
    "prophet",
    "neural_prophet",
    "darts",
)
FORECAST_COLUMNS = (*FORECAST_METHODS, "ensemble")
MILESTONES = (
    "end_of_this_month",
    "end_of_next_month",
    "end_of_next_quarter",
    "end_of_following_quarter",
    "end_of_year",
)
ANOMALY_PERIODS = (
    ("Day Before Yesterday", 2),
    ("Week Ago", 7),
    ("Month Ago", 30),
    ("Quarter Ago", 90),
)
MONTH_FACTORS = {
    "toys": (0.95, 0.95, 0.97, 0.98, 1.00, 1.02, 1.03, 1.05, 1.07, 1.10, 1.30, 1.40),
    "holidays": (1.00, 1.08, 1.00, 0.98, 0.97, 0.98, 1.00, 1.15, 1.02, 1.03, 1.05, 1.20),
}
SERIES_PATTERNS = ("upward_trend", "downward_trend", "step_change", "spike", "flat")
MIN_POINTS = 10
DAILY_HORIZON = 365
MONTHLY_HORIZON = 12
REPORT_DECIMALS = 6
# ---------------------------------------------------------------------------


def metric_name(text: str | None) -> str:
    """One metric name out of ``COST_METRICS``; empty means the default."""
    wanted = [part.strip() for part in (text or DEFAULT_METRIC).split(",") if part.strip()]
    if len(wanted) != 1:
        raise ValueError(f"give one metric, got {len(wanted)}: {text!r}")
    if wanted[0] not in COST_METRICS:
        raise ValueError(f"unknown metric {wanted[0]!r}; known: {', '.join(COST_METRICS)}")
    return wanted[0]


def iso_date(value: str | dt.date) -> dt.date:
    """A ``YYYY-MM-DD`` text (or a date) as a date."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    try:
        return dt.date.fromisoformat(value)
    except ValueError as exc:
        raise ValueError(f"not a YYYY-MM-DD date: {value!r}") from exc


def model_order(order: str | Sequence[int], length: int) -> tuple[int, ...]:
    """A model order such as ``"1,1,1"`` as a tuple of exactly ``length`` whole numbers."""
    items = order.split(",") if isinstance(order, str) else list(order)
    try:
        numbers = tuple(int(item) for item in items)
    except ValueError as exc:
        raise ValueError(f"model order must be whole numbers: {order!r}") from exc
    if len(numbers) != length:
        raise ValueError(f"model order needs {length} numbers, got {len(numbers)}: {order!r}")
    if any(number < 0 for number in numbers):
        raise ValueError(f"model order must not be negative: {order!r}")
    return numbers


def month_factors(preset: str | None, factors: str | Sequence[float] | None) -> tuple[float, ...]:
    """Twelve multipliers, January first.  Explicit factors win over a preset."""
    if not factors:
        if not preset:
            raise ValueError("give a preset or twelve factors")
        if preset not in MONTH_FACTORS:
            raise ValueError(f"unknown preset {preset!r}; known: {', '.join(MONTH_FACTORS)}")
        return MONTH_FACTORS[preset]
    items = [part for part in factors.split(",") if part.strip()] if isinstance(factors, str) else factors
    try:
        numbers = tuple(float(item) for item in items)
    except ValueError as exc:
        raise ValueError(f"month factors must be numbers: {factors!r}") from exc
    if len(numbers) != 12:
        raise ValueError(f"need 12 month factors, got {len(numbers)}")
    return numbers


def one_change(pct: float | None, value: float | None, *, positive: bool = False) -> None:
    """Exactly one of ``pct`` and ``value``; above zero when ``positive``."""
    if (pct is None) == (value is None):
        raise ValueError("give exactly one of pct and value")
    amount = value if pct is None else pct
    if positive and amount <= 0:
        raise ValueError("pct or value must be above zero")


def choice(value, allowed: Sequence, what: str):
    if value not in allowed:
        raise ValueError(f"unknown {what} {value!r}; known: {', '.join(map(str, allowed))}")
    return value


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise with every missing column named; looks at the schema only, runs no job."""
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; present: {', '.join(df.columns)}")
