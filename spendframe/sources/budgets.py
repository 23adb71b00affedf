"""Budget JSON -> one row per budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendframe.functions.numbers import to_number


BUDGETS_SCHEMA = (
    "Budgets array<struct<BudgetName: string, BudgetLimit: struct<Amount: string, Unit: string>, "
    "CostFilters: map<string, array<string>>>>"
)
UNNAMED = "Unknown"


def read_budgets(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Budget files, one document each or, with ``lines``, one a line; a document that does not parse
    fails the query."""
    docs = spark.read.schema(BUDGETS_SCHEMA).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    return budget_rows(docs)


def parse_budgets(df: DataFrame, json_col: str) -> DataFrame:
    doc = F.from_json(F.col(json_col), BUDGETS_SCHEMA, {"mode": "FAILFAST"})
    docs = df.select(doc.alias("_doc")).select("_doc.*")
    return budget_rows(docs)


def budget_rows(docs: DataFrame) -> DataFrame:
    """``BudgetName, BudgetAmount``; no limit, or a limit without an amount, counts as 0."""
    records = docs.select(F.explode("Budgets").alias("b")).select("b.*")
    amount = to_number(F.col("BudgetLimit.Amount"), T.StringType())
    return records.select(
        F.coalesce("BudgetName", F.lit(UNNAMED)).alias("BudgetName"),
        F.coalesce(amount, F.lit(0.0)).alias("BudgetAmount"),
    )
