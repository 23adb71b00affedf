"""Series operators.  Signature: ``op(df, *, series_cols, date_col, value_col, ...) -> DataFrame``."""
