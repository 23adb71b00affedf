"""Run every registered query beside its SQL and compare the results value by value.

``python -m workload.check [sf_dir] [query ...]``
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from spendframe import build_session
from workload.oracles import oracle_sql
from workload.queries import REGISTRY

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def sort_key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def compare(spark: SparkSession, connection, name: str, sf_dir: str) -> str:
    started = time.time()
    frame = REGISTRY[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = [tuple(plain(v) for v in row) for row in frame.select(*columns).collect()]
    spark_time = time.time() - started
    sql = oracle_sql().get(name)
    if sql is None:
        return f"rows-only {len(got):>8} rows {spark_time:6.1f}s"
    started = time.time()
    cursor = connection.execute(sql)
    named = [c[0] for c in cursor.description]
    if sorted(named) != columns:
        return f"FAIL columns {sorted(named)} != {columns}"
    order = [named.index(c) for c in columns]
    wanted = [tuple(plain(row[i]) for i in order) for row in cursor.fetchall()]
    duck_time = time.time() - started
    if len(got) != len(wanted):
        return f"FAIL rows {len(got)} != {len(wanted)}"
    got.sort(key=sort_key)
    wanted.sort(key=sort_key)
    wrong = [(a, b) for a, b in zip(got, wanted) if a != b]
    if wrong:
        return f"FAIL {len(wrong)} of {len(got)} rows, first {wrong[0]}"
    return f"ok {len(got):>8} rows {spark_time:6.1f}s, sql {duck_time:5.1f}s"


def main(arguments: list[str]) -> int:
    sf_dir = arguments[0] if arguments else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failures = 0
    for name in arguments[1:] or REGISTRY:
        try:
            outcome = compare(spark, connection, name, sf_dir)
        except Exception as error:  # report and go on with the other queries
            outcome = f"FAIL {type(error).__name__}: {str(error)[:600]}"
        failures += outcome.startswith("FAIL")
        print(f"{name:28} {outcome}", flush=True)
    print(f"{failures} failures")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
