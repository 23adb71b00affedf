"""Pages that lead to each other, and reports as one JSON document."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from spendframe.sinks.document import write_json_document
from spendframe.sources.paged import ReportPages, token_of
from spendframe.sources.reports import grouped_rows, parse_report_pages


def page(start: str, costs: dict[str, str], token: str | None, padding: int = 0) -> str:
    groups = [{"Keys": [k], "Metrics": {"UnblendedCost": {"Amount": v, "Unit": "USD"}}} for k, v in costs.items()]
    body = {"ResultsByTime": [{"TimePeriod": {"Start": start, "End": start}, "Groups": groups, "Note": "x" * padding}]}
    if token is not None:
        body["NextPageToken"] = token
    return json.dumps(body, indent=1)


@pytest.fixture
def folder(tmp_path):
    """Seven pages written in any order; tokens with signs that no file name has."""
    names = ["first", "a/b", "c d", "ä", "e%2F", "f.json", "last"]
    pages = [
        (name, page(f"2025-01-{k + 1:02d}", {"x": f"{k}.5", "y": "1"}, names[k + 1] if k + 1 < len(names) else None, padding=9000 * (k == 2)))
        for k, name in enumerate(names)
    ]
    random.Random(1).shuffle(pages)
    from spendframe.sources.paged import Folder

    for name, text in pages:
        with open(Folder(str(tmp_path)).file(name), "w") as out:
            out.write(text)
    return tmp_path


@pytest.fixture
def pages(spark):
    spark.dataSource.register(ReportPages)
    return lambda path, **options: spark.read.format("report_pages").options(**options).load(str(path))


def test_batch_follows_the_chain(folder, pages):
    rows = pages(folder).collect()
    assert len(rows) == 7 and {r.token for r in rows} >= {"first", "a/b", "ä", "last"}
    assert {r.token: r.next_token for r in rows}["last"] is None
    costs = grouped_rows(parse_report_pages(pages(folder), "page")).collect()
    assert len(costs) == 14 and {(r.PeriodStart, r.UnblendedCost) for r in costs if r.Group == "x"} == {(f"2025-01-{k + 1:02d}", f"{k}.500000") for k in range(7)}
    assert pages(folder).rdd.getNumPartitions() == 7


def test_broken_chains_are_errors(folder, pages):
    with pytest.raises(Exception, match="missing"):
        pages(folder, first="nowhere").collect()
    (folder / "stray.json").write_text(page("2025-02-01", {}, None))
    with pytest.raises(Exception, match="not reached"):
        pages(folder).collect()
    (folder / "last.json").write_text(page("2025-02-01", {}, "stray"))
    assert pages(folder).count() == 8
    (folder / "stray.json").write_text(page("2025-02-01", {}, "a/b"))
    with pytest.raises(Exception, match="circle"):
        pages(folder).collect()
    (folder / "stray.json").write_text("[1, 2]")
    with pytest.raises(Exception, match="object"):
        pages(folder).collect()


def test_a_token_of_inner_objects_does_not_count():
    assert token_of('{"NextPageToken": "t", "x": 1}') == "t" and token_of('{"x": {"NextPageToken": "t"}}') is None
    assert token_of('{"NextPageToken": ""}') is None


def test_a_restarted_stream_repeats_nothing(spark, folder, pages, tmp_path_factory):
    state = tmp_path_factory.mktemp("stream")
    late = folder / "c%20d.json"
    held = late.read_text()
    late.write_text("")
    late.rename(folder / "later.txt")  # the third page isn't there yet

    def run():
        stream = spark.readStream.format("report_pages").load(str(folder))
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{state}/check").trigger(availableNow=True).start(f"{state}/out")
        query.awaitTermination(120)
        return sorted(r.token for r in spark.read.parquet(f"{state}/out").collect())

    assert run() == ["a/b", "first"]
    late.write_text(held)
    assert run() == sorted(["first", "a/b", "c d", "ä", "e%2F", "f.json", "last"])
    assert len(run()) == 7


AS_OF = dt.datetime(2025, 1, 2, 3, 4, 5)


def write(df, path, **settings):
    write_json_document(df, str(path), command="costs", parameters={"grain": "daily", "none": None}, as_of=AS_OF, **settings)
    return json.loads(open(path).read())


def test_one_document_of_many_tasks(spark, tmp_path):
    df = spark.range(1000, numPartitions=7).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit('q"\n'), F.col("id"))).alias("name"), (F.col("id") / 4).alias("cost"))
    got = write(df, tmp_path / "report.json")
    assert {k: got[k] for k in got if k != "data"} == {"command": "costs", "timestamp": "2025-01-02T03:04:05", "parameters": {"grain": "daily", "none": None}}
    assert got["data"] == [{"id": k, "name": f'q"\n{k}' if k % 3 else None, "cost": k / 4} for k in range(1000)]
    assert [p.name for p in tmp_path.iterdir()] == ["report.json"]


def test_empty_parts_and_modes(spark, tmp_path):
    df = spark.range(3, numPartitions=9).select("id")
    assert write(df.where("id < 0"), tmp_path / "r.json")["data"] == []
    with pytest.raises(Exception, match="exists"):
        write(df, tmp_path / "r.json")
    assert write(df, tmp_path / "r.json", mode="overwrite")["data"] == [{"id": 0}, {"id": 1}, {"id": 2}]
    with pytest.raises(ValueError):
        write(df, tmp_path / "s.json", mode="append")


def test_a_failed_task_leaves_no_document(spark, tmp_path):
    bad = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 60, F.raise_error(F.lit("no"))).otherwise("x").alias("v"))
    with pytest.raises(Exception):
        write(bad, tmp_path / "r.json")
    # a task that is killed after the clean-up may still leave its part
    assert all(p.name.startswith("r.json.parts-") for p in tmp_path.iterdir())


def test_a_million_rows_pass_in_blocks(spark, tmp_path):
    path = tmp_path / "large.json"
    write_json_document(spark.range(1_000_000, numPartitions=8), str(path), command="c", parameters={}, as_of=AS_OF)
    back = spark.read.text(str(path)).where("value LIKE '{\"id\":%'")
    ids = back.select(F.get_json_object(F.rtrim(F.col("value"), F.lit(",")), "$.id").cast("long").alias("id"))
    assert ids.agg(F.count("id"), F.sum("id"), F.min("id"), F.max("id")).first() == (1_000_000, 499_999_500_000, 0, 999_999)
