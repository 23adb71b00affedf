"""A report as one JSON document, written by many tasks.

    {"command": ..., "timestamp": ..., "parameters": {...}, "data": [row, row, ...]}

Each task writes its rows, already JSON text, to a part file of its own; the commit step copies the parts
one after another between the head and the end of the document, a block at a time, and renames the
result into place.  No task and no driver ever holds all rows.  A task that runs again writes another
part; only the parts of tasks that Spark commits are copied.  Part order is that of the
partitions, so a sorted table gives a sorted document.
"""

from __future__ import annotations

import datetime as dt
import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 1 << 20


def _store(path: str) -> tuple[fs.FileSystem, str]:
    remote = "://" in path or path.startswith("file:")
    return fs.FileSystem.from_uri(path) if remote else (fs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    name: str | None
    number: int
    rows: int


class JsonDocument(DataSource):
    """Options: ``path`` of the document, ``head`` (a JSON object whose members come before ``data``).

    The table has one text column of JSON values."""

    @classmethod
    def name(cls) -> str:
        return "json_document"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if [f.dataType.simpleString() for f in schema.fields] != ["string"]:
            raise ValueError("json_document writes one column of JSON text")
        return DocumentWriter(self.options["path"], self.options.get("head", "{}"), overwrite)


class DocumentWriter(DataSourceWriter):
    def __init__(self, path: str, head: str, overwrite: bool):
        self.path, self.head, self.overwrite = path, head, overwrite
        self.parts = f"{path}.parts-{uuid.uuid4().hex}"
        store, at = _store(path)
        if not overwrite and store.get_file_info(at).type != fs.FileType.NotFound:
            raise ValueError(f"{path} exists")

    def write(self, rows: Iterator) -> Part:
        store, folder = _store(self.parts)
        number = TaskContext.get().partitionId()
        name, count, out = f"{number:08d}-{uuid.uuid4().hex}", 0, None
        held: list[bytes] = []
        size = 0
        try:
            for row in rows:
                if out is None:
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(f"{folder}/{name}")
                held.append((",\n" if count else "").encode() + (row[0] if row[0] is not None else "null").encode())
                count, size = count + 1, size + len(held[-1])
                if size >= BLOCK:
                    out.write(b"".join(held))
                    held, size = [], 0
            if out is not None:
                out.write(b"".join(held))
        finally:
            if out is not None:
                out.close()
        return Part(name if count else None, number, count)

    def commit(self, messages: list[Part | None]) -> None:
        store, at = _store(self.path)
        _, folder = _store(self.parts)
        parts = sorted((m.number, m.name) for m in messages if m is not None and m.name)
        head = json.loads(self.head)
        before = json.dumps({**head, "data": []}, indent=2)[: -len("]\n}")]
        passing = f"{at}.{uuid.uuid4().hex}"
        with store.open_output_stream(passing) as out:
            out.write(before.encode() + b"\n" * bool(parts))
            for k, (_, name) in enumerate(parts):
                out.write(b",\n" * bool(k))
                with store.open_input_stream(f"{folder}/{name}") as part:
                    while block := part.read(BLOCK):
                        out.write(block)
            out.write(b"\n" * bool(parts) + b"]\n}\n")
        if self.overwrite and store.get_file_info(at).type == fs.FileType.File:
            store.delete_file(at)
        store.move(passing, at)
        self._clear(store, folder)

    def abort(self, messages: list[Part | None]) -> None:
        """Removes the parts; a task that is killed after this may leave one beside the document's place."""
        self._clear(*_store(self.parts))

    @staticmethod
    def _clear(store: fs.FileSystem, folder: str) -> None:
        """Removes this writer's own part folder."""
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


def write_json_document(
    df: DataFrame, path: str, *, command: str, parameters: dict, as_of: dt.datetime, mode: str = "errorifexists"
) -> None:
    """The table as one JSON document at ``path`` (on a file system all executors share); missing values stay nulls.

    ``mode``: ``errorifexists`` or ``overwrite``."""
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError("mode must be errorifexists or overwrite")
    head = json.dumps({"command": command, "timestamp": as_of.isoformat(), "parameters": parameters})
    df.sparkSession.dataSource.register(JsonDocument)
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    writer = rows.write.format("json_document").option("head", head)
    writer.mode("append" if mode == "errorifexists" else "overwrite").save(path)
