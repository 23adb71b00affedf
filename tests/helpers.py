"""What the tests of several modules share."""

import datetime as dt


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def days_from(first: str, count: int) -> list[dt.date]:
    return [day(first) + dt.timedelta(days=i) for i in range(count)]


def months_from(first: str, count: int) -> list[dt.date]:
    start = day(first)
    index = start.year * 12 + start.month - 1
    return [dt.date((index + i) // 12, (index + i) % 12 + 1, 1) for i in range(count)]


NAMES = {"date_col": "PeriodStart", "value_col": "Cost"}


def costs(df) -> list[float]:
    return [row["Cost"] for row in df.orderBy("PeriodStart").collect()]
