"""Report pages that lead from one to the next by token, as a source for batch and stream reads.

A folder holds one JSON file a page, named by the token that asks for it (``<token>.json``; the first
page by the option ``first``).  A page's ``NextPageToken`` names the next; one without a token is
the last.  Only tokens are looked up on the driver, from the ends of the files; pages themselves are
read by the tasks.

    spark.dataSource.register(ReportPages)
    pages = spark.read.format("report_pages").load("/data/report")        # token, page, next_token
    rows = grouped_rows(parse_report_pages(pages, "page"))

A batch read follows the whole chain: a missing page, a page met twice and a page that the chain
doesn't reach are errors, as costs would be lost or counted twice.  In a stream the offset is the token
of the page to read next, so a restarted stream goes on where it stopped; a page that isn't there
yet is waited for.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "token string, page string, next_token string"
#: Bytes of a file's end in which its token is looked for before the whole page is.
TAIL = 4096
LAST_TOKEN = re.compile(rb'[{,]\s*"NextPageToken"\s*:\s*("(?:[^"\\]|\\.)*"|null)\s*}\s*\Z')


class Folder:
    """Page files of one folder, on any file system that Arrow opens by URI; plain paths are local."""

    def __init__(self, path: str):
        remote = "://" in path or path.startswith("file:")
        self.store, self.path = fs.FileSystem.from_uri(path) if remote else (fs.LocalFileSystem(), path)

    def file(self, token: str) -> str:
        return f"{self.path.rstrip('/')}/{quote(token, safe='')}.json"

    def has(self, token: str) -> bool:
        return self.store.get_file_info(self.file(token)).type == fs.FileType.File

    def tokens(self) -> set[str]:
        found = self.store.get_file_info(fs.FileSelector(self.path))
        return {unquote(f.base_name[: -len(".json")]) for f in found if f.type == fs.FileType.File and f.base_name.endswith(".json")}

    def text(self, token: str) -> str:
        with self.store.open_input_stream(self.file(token)) as stream:
            return stream.read().decode("utf-8")

    def next(self, token: str) -> str | None:
        """The token of the page after this one; None after the last."""
        with self.store.open_input_file(self.file(token)) as file:
            size = file.size()
            file.seek(max(0, size - TAIL))
            found = LAST_TOKEN.search(file.read())
        if found:
            return json.loads(found[1]) or None
        return token_of(self.text(token))


def token_of(page: str) -> str | None:
    """A page's ``NextPageToken``; a page that is no JSON object is an error."""
    parsed = json.loads(page)
    if not isinstance(parsed, dict):
        raise ValueError("a report page must be a JSON object")
    return parsed.get("NextPageToken") or None


def chain(folder: Folder, token: str | None, stop: str | None = None) -> Iterator[str]:
    """Tokens from ``token`` on, up to ``stop`` or the last page; a page that is missing or met again is an error."""
    seen: set[str] = set()
    while token is not None and token != stop:
        if token in seen:
            raise ValueError(f"the pages run in a circle at token {token!r}")
        if not folder.has(token):
            raise ValueError(f"page {folder.file(token)} is missing")
        seen.add(token)
        yield token
        token = folder.next(token)


class Page(InputPartition):
    def __init__(self, token: str):
        super().__init__(token)


def read_page(folder: Folder, partition: InputPartition) -> Iterator[tuple[str, str, str | None]]:
    page = folder.text(partition.value)
    yield partition.value, page, token_of(page)


class ReportPages(DataSource):
    """Options: ``path`` (or ``load(path)``), ``first`` (the first page's name, ``first``)."""

    @classmethod
    def name(cls) -> str:
        return "report_pages"

    def schema(self) -> str:
        return SCHEMA

    def _folder(self) -> tuple[str, str]:
        if not self.options.get("path"):
            raise ValueError("report_pages needs a path")
        return self.options["path"], self.options.get("first", "first")

    def reader(self, schema) -> DataSourceReader:
        return BatchPages(*self._folder())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StreamedPages(*self._folder())


class BatchPages(DataSourceReader):
    def __init__(self, path: str, first: str):
        self.path, self.first = path, first

    def partitions(self) -> list[InputPartition]:
        folder = Folder(self.path)
        found = list(chain(folder, self.first))
        astray = sorted(folder.tokens() - set(found))
        if astray:
            raise ValueError(f"{len(astray)} pages are not reached by the chain, first {astray[0]!r}")
        return [Page(token) for token in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return read_page(Folder(self.path), partition)


class StreamedPages(DataSourceStreamReader):
    """Offsets are ``{"token": the page to read next}``, null once the last page has been read."""

    def __init__(self, path: str, first: str):
        self.path, self.first = path, first
        self.at: str | None = first

    def initialOffset(self) -> dict:
        return {"token": self.first}

    def latestOffset(self) -> dict:
        folder = Folder(self.path)
        while self.at is not None and folder.has(self.at):
            self.at = folder.next(self.at)
        return {"token": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Page(token) for token in chain(Folder(self.path), start["token"], end["token"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return read_page(Folder(self.path), partition)
