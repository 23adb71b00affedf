"""CSV and JSON in and out, report pages, budgets, the usage aggregate."""

import datetime as dt
import json

import pytest
from helpers import day
from pyspark.sql import functions as F

from spendframe.operators.clean import clean_series
from spendframe.sinks.files import write_csv, write_json, write_json_report, write_report_pages
from spendframe.sources import budgets, reports
from spendframe.sources.files import read_csv, read_input
from spendframe.sources.usage import cost_by_period, dimension, everything, report_bounds, tag

GROUPED = {
    "ResultsByTime": [
        {
            "TimePeriod": {"Start": "2024-12-01", "End": "2024-12-02"},
            "Groups": [
                {"Keys": ["EC2"], "Metrics": {"UnblendedCost": {"Amount": "10.50", "Unit": "USD"}}},
                {"Keys": ["S3"], "Metrics": {"BlendedCost": {"Amount": "1"}}},
            ],
        },
        {"TimePeriod": {"Start": "2024-12-02"}, "Groups": []},
        {"TimePeriod": {"Start": "2024-12-03"}, "Groups": [{"Keys": ["RDS"], "Metrics": {"UnblendedCost": {"Amount": "n/a"}}}]},
    ]
}
TOTAL = {
    "ResultsByTime": [
        {"TimePeriod": {"Start": "2024-12-01"}, "Total": {"UnblendedCost": {"Amount": "15.75"}}},
        {"TimePeriod": {"Start": "2024-12-02"}, "Total": {}},
    ]
}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def pages(spark, *docs):
    return reports.parse_report_pages(spark.createDataFrame([(json.dumps(d),) for d in docs], "page string"), "page")


def test_grouped_report(spark):
    df = reports.grouped_rows(pages(spark, GROUPED), "UnblendedCost", "Service")
    assert df.columns == ["PeriodStart", "Service", "UnblendedCost"]
    assert rows(df) == [("2024-12-01", "EC2", "10.500000"), ("2024-12-01", "S3", ""), ("2024-12-03", "RDS", "n/a")]


def test_total_report(spark):
    df = reports.total_rows(pages(spark, TOTAL))
    assert rows(df) == [("2024-12-01", "Total", "15.750000"), ("2024-12-02", "Total", "")]


def test_report_pages_from_a_directory(spark, tmp_path):
    for number, doc in enumerate((GROUPED, TOTAL)):
        (tmp_path / f"page{number}.json").write_text(json.dumps(doc, indent=2))
    read = reports.read_report_pages(spark, str(tmp_path))
    assert reports.total_rows(read).count() == 5
    united = reports.union_pages(pages(spark, GROUPED), pages(spark, TOTAL))
    assert rows(reports.total_rows(united)) == rows(reports.total_rows(read))


def test_report_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    write_report_pages(pages(spark, GROUPED), path)
    again = spark.read.schema(reports.PAGE_SCHEMA).json(path)
    assert rows(reports.grouped_rows(again)) == rows(reports.grouped_rows(pages(spark, GROUPED)))


def test_budgets(spark, tmp_path):
    doc = {
        "Budgets": [
            {"BudgetName": "a", "BudgetLimit": {"Amount": "1000.00", "Unit": "USD"}},
            {"BudgetName": "b", "CostFilters": {"Service": ["EC2"]}},
            {"BudgetName": "c"},
            {"BudgetLimit": {"Unit": "USD"}},
        ]
    }
    wanted = [("Unknown", 0.0), ("a", 1000.0), ("b", 0.0), ("c", 0.0)]
    assert rows(budgets.parse_budgets(spark.createDataFrame([(json.dumps(doc),)], "d string"), "d")) == wanted
    (tmp_path / "budgets.json").write_text(json.dumps(doc, indent=1))
    assert rows(budgets.read_budgets(spark, str(tmp_path))) == wanted


def test_csv_input_checks(spark, tmp_path):
    file = tmp_path / "costs.csv"
    file.write_text("PeriodStart,UnblendedCost\n2025-01-01,1\n2025-01-02,\n2025-01-03,NaN\nbad,4\n2025-01-05,5\n")
    df = read_input(spark, str(file), ["PeriodStart", "UnblendedCost"])
    clean = clean_series(df, date_col="PeriodStart", value_col="UnblendedCost")
    assert rows(clean) == [(day("2025-01-01"), 1.0), (day("2025-01-05"), 5.0)]
    with pytest.raises(ValueError, match="Cost, Day"):
        read_input(spark, str(file), ["Cost", "Day"])
    empty = tmp_path / "empty.csv"
    empty.write_text("PeriodStart,UnblendedCost\n")
    with pytest.raises(ValueError, match="no rows"):
        read_input(spark, str(empty), ["PeriodStart"])
    assert read_csv(spark, str(file), ["PeriodStart", "UnblendedCost"]).count() == 5


def test_csv_round_trip_writes_missing_as_empty(spark, tmp_path):
    df = spark.createDataFrame([(day("2025-01-01"), 1.5, None), (day("2025-01-02"), None, "x,y")], "d date, v double, t string")
    write_csv(df, str(tmp_path / "csv"))
    text = sorted(line for p in (tmp_path / "csv").glob("*.csv") for line in p.read_text().splitlines())
    assert '2025-01-01,1.5,' in text and '2025-01-02,,"x,y"' in text and "d,v,t" in text
    assert rows(read_csv(spark, str(tmp_path / "csv"))) == [("2025-01-01", "1.5", None), ("2025-01-02", None, "x,y")]


def test_json_report(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, 2.5)], "k int, v double")
    write_json(df, str(tmp_path / "plain"))
    write_json_report(
        df, str(tmp_path / "r"), command="budget", parameters={"threshold": 80}, as_of=dt.datetime(2025, 1, 1)
    )
    meta = spark.read.json(str(tmp_path / "r" / "metadata")).first()
    assert (meta.command, meta.timestamp, meta.parameters.threshold) == ("budget", "2025-01-01T00:00:00", 80)
    data = spark.read.schema("k int, v double").json(str(tmp_path / "r" / "data"))
    assert sorted(data.collect(), key=lambda r: r.k) == [(1, None), (2, 2.5)]
    assert '"v":null' in "".join(p.read_text() for p in (tmp_path / "plain").glob("*.json"))


@pytest.fixture
def usage(spark):
    lines = [
        ("2025-01-01 05:10:00", "ec2", {"env": "prod"}, 1.0),
        ("2025-01-01 05:50:00", "ec2", {"env": "dev"}, 2.0),
        ("2025-01-01 23:59:59", "s3", {}, 4.0),
        ("2025-01-02 00:00:00", "ec2", {"env": "prod"}, 8.0),
        ("2025-02-01 00:00:00", "ec2", {"env": "prod"}, float("nan")),
    ]
    return spark.createDataFrame(lines, "ts string, service string, tags map<string,string>, cost double").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    )


def test_usage_grains_and_groups(usage):
    named = {"ts_col": "ts", "amount": "cost"}
    daily = cost_by_period(usage, group=dimension("service", "Service"), start="2025-01-01", end="2025-01-02", **named)
    assert rows(daily) == [(day("2025-01-01"), "ec2", 3.0), (day("2025-01-01"), "s3", 4.0)]
    hourly = cost_by_period(usage, grain="hourly", end="2025-01-03", **named)
    assert rows(hourly)[0] == (dt.datetime(2025, 1, 1, 5), "Total", 3.0)
    monthly = cost_by_period(usage, grain="monthly", group=everything(), end="2025-02-01", **named)
    assert rows(monthly) == [(day("2025-01-01"), "Total", 15.0)]
    tagged = cost_by_period(usage, group=tag("tags", "env"), end="2025-02-01", grain="monthly", **named)
    assert tagged.columns == ["period_start", "Tag:env", "cost"]
    got = {row[1]: row[2] for row in tagged.collect()}
    assert got == {"prod": 9.0, "dev": 2.0, None: 4.0}


def test_tag_from_json_text(spark):
    df = spark.createDataFrame(
        [("2025-01-01", '{"a.b": "x"}', 1.0), ("2025-01-01", '{"a": {"b": "y"}}', 2.0)], "ts string, props string, cost double"
    )
    df = df.withColumn("ts", F.col("ts").cast("date"))
    got = {r[1]: r[2] for r in cost_by_period(df, ts_col="ts", amount="cost", group=tag("props", "a.b")).collect()}
    assert got == {"x": 1.0, None: 2.0}


def test_usage_parameters(usage):
    with pytest.raises(ValueError):
        tag("tags", "")
    with pytest.raises(ValueError):
        cost_by_period(usage, ts_col="ts", amount="cost", grain="weekly")
    with pytest.raises(ValueError):
        report_bounds("2025-01-01", None, (1, 2))
    assert report_bounds(None, None, (1, 2)) == (1, 2)
