"""CSV and JSON output."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, *, header: bool = True, mode: str = "errorifexists") -> None:
    """CSV part files; missing values are empty fields."""
    df.write.mode(mode).option("header", header).option("nullValue", "").option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """One JSON object per line; missing values stay as explicit nulls."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_json_report(
    df: DataFrame, path: str, *, command: str, parameters: dict, as_of: dt.datetime, mode: str = "errorifexists"
) -> None:
    """A report as ``<path>/metadata`` (one object) and ``<path>/data`` (one object per row).

    A single nested document would need every row in one task; two directories carry the same
    content and can be read back with ``spark.read.json``.
    """
    meta = json.dumps({"command": command, "timestamp": as_of.isoformat(), "parameters": parameters})
    df.sparkSession.range(1).select(F.lit(meta).alias("value")).coalesce(1).write.mode(mode).text(f"{path}/metadata")
    write_json(df, f"{path}/data", mode=mode)


def write_report_pages(pages: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Raw report pages back to JSON, one page per line."""
    pages.write.mode(mode).json(path)
