"""Lagged values as columns, the design of the linear lag model; ``direct`` has that of the tree models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lag_features(
    df: DataFrame, *, series_cols: Sequence[str], date_col: str, value_col: str, lags: int = 12
) -> DataFrame:
    """Add ``lag_1 .. lag_<lags>``; keep the rows that have all of them."""
    w = Window.partitionBy(*series_cols).orderBy(date_col, value_col)
    lagged = df.withColumns({f"lag_{i}": F.lag(value_col, i).over(w) for i in range(1, lags + 1)})
    return lagged.filter(F.col(f"lag_{lags}").isNotNull())
