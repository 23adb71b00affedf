"""The streamed aggregate gives what the batch aggregate gives."""

import time

from pyspark.sql import functions as F

from spendframe.operators.budgets import budget_status
from spendframe.operators.events import seasonality
from spendframe.sources.usage import cost_by_period, dimension
from spendframe.streaming import cost_by_period_stream


def run(stream, tmp_path, name, mode):
    query = (
        stream.writeStream.format("memory")
        .queryName(name)
        .outputMode(mode)
        .option("checkpointLocation", str(tmp_path / name))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = str(tmp_path / "in")
    for first, last in (("2024-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20"), ("2024-01-20", "2024-02-01")):
        part = events.filter((F.col("ts") >= first) & (F.col("ts") < last))
        part.coalesce(1).write.mode("append").parquet(folder)  # arrival order is file time order
        time.sleep(1.1)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    named = {"ts_col": "ts", "amount": "value", "group": dimension("event_type", "service")}
    updates = run(cost_by_period_stream(stream, late_by="40 days", **named), tmp_path, "updates", "complete")
    got = {tuple(r) for r in updates.collect()}
    batch = cost_by_period(events, **named)
    assert got == {tuple(r) for r in batch.collect()}

    closed = run(cost_by_period_stream(stream, late_by="1 day", **named), tmp_path, "closed", "append")
    early = {tuple(r) for r in closed.collect()}
    assert len(early) > 100 and early <= got
    assert closed.groupBy("period_start", "service").count().filter("count > 1").isEmpty()


def test_row_wise_operators_take_a_stream(spark, sf_dir, tmp_path):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    folder = str(tmp_path / "orders")
    orders.write.parquet(folder)
    stream = spark.readStream.schema(orders.schema).parquet(folder)

    def rows(df):
        scaled = seasonality(df, date_col="o_orderdate", value_col="o_totalprice", preset="toys")
        return scaled.select("o_orderkey", "o_totalprice", budget_status(F.col("o_totalprice"), F.lit(200000.0)).alias("s"))

    table = run(rows(stream), tmp_path, "scaled", "append")
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, rows(orders).collect()))
