"""Cost time series on Spark: aggregate usage lines, forecast, budget, compare, reshape.

Every operator is a function from DataFrame to DataFrame.  A *series* is one row per
``(series_cols, period)``; ``series_cols=[]`` means the table is a single series.
"""

from spendframe.session import build_session, settle

__all__ = ["build_session", "settle"]
