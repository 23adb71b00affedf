"""Settling a table: one computation, no lineage, in a folder that was named."""

import pytest
from pyspark.sql import functions as F

from spendframe import session, settle


def test_settle_cuts_lineage_and_keeps_rows(spark, tmp_path):
    df = spark.range(100).withColumn("v", F.col("id") * 2).repartition(3)
    settled = settle(df, str(tmp_path))
    plan = settled._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Range" not in plan
    assert sorted(settled.collect()) == sorted(df.collect())


def test_settle_invents_no_folder(spark, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: None)
    with pytest.raises(ValueError, match="checkpoint"):
        settle(spark.range(1))
