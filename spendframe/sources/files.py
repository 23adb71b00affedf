"""CSV tables with a header row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from spendframe.params import require_columns


def csv_schema(columns: Sequence[str]) -> T.StructType:
    """All-text schema: values are coerced later, and no inference pass reads the files twice."""
    return T.StructType([T.StructField(name, T.StringType()) for name in columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | Sequence[str] | None = None) -> DataFrame:
    """A CSV file or a directory of them.

    With a schema the read is lazy.  Without one the first header is looked at; every column is
    text.  Either way each file's header is held against the schema when it is read.
    """
    reader = spark.read.option("header", True)
    if schema is None:
        schema = csv_schema(reader.option("inferSchema", False).csv(path).columns)
    if not isinstance(schema, T.StructType):
        schema = csv_schema(schema)
    # a given schema is matched by position; a header that disagrees is an error, not a shift
    return reader.option("enforceSchema", False).schema(schema).csv(path)


def read_input(spark: SparkSession, path: str, required: Sequence[str], schema=None) -> DataFrame:
    """``read_csv`` plus eager checks: the needed columns are there and there is a row."""
    df = read_csv(spark, path, schema)
    require_columns(df, required)
    if df.limit(1).isEmpty():
        raise ValueError(f"no rows in {path}")
    return df
