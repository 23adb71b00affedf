"""What several operators of this folder need: words, cutting a plan, null-safe joins."""

from __future__ import annotations

import ctypes
import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SENT: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Let Spark hand this package to the executors (once an application), so that their Python needs the
    public libraries only.  The archive is made on the driver, whose file server the executors read."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    top = Path(__file__).resolve().parent.parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(top.rglob("*.py")):
            archive.writestr(zipfile.ZipInfo(str(file.relative_to(top.parent))), file.read_bytes())
    name = f"{top.name}-{hashlib.sha256(held.getvalue()).hexdigest()[:12]}.zip"
    path = Path(tempfile.mkdtemp(prefix="package-")) / name
    path.write_bytes(held.getvalue())
    context.addPyFile(str(path))
    _SENT.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, else one beside the warehouse.

    Both are shared by the driver and all executors; a machine-local temporary folder is never used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    return os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_intermediate")


def cut(df: DataFrame) -> DataFrame:
    """Compute a table once, for several later jobs or rounds, and cut its lineage.

    It is written as Parquet to the shared folder and read again: one computation (a checkpoint may
    take two), committed task by task, and readable after any executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blanks(text: Column, keep: str = "") -> Column:
    """The text with each character of ASCII white space as a blank, but for those in ``keep``; null is empty."""
    text = F.coalesce(text, F.lit(""))
    for char in "\t\n\x0b\x0c\r":  # plain replacements run many times faster than a pattern or translate()
        text = text if char in keep else F.replace(text, F.lit(char), F.lit(" "))
    return text


def words(text: Column) -> Column:
    """Words between runs of ASCII white space, as an array; null gives an empty one."""
    return F.filter(F.split(blanks(text), " "), lambda word: word != "")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names, so that others in the input can't clash with ours."""
    send_package(df.sparkSession)
    return df.select(*(F.col(f"`{name}`").alias(alias) for alias, name in columns.items()))


def keep_ids(docs: DataFrame, ids: DataFrame, id_col: str, *, drop: bool = False) -> DataFrame:
    """Rows of ``docs`` whose id is (or, with ``drop``, is not) among ``ids``; a null id equals a null id."""
    other = ids.select(F.col(ids.columns[0]).alias("_other_id"))
    return docs.join(other, docs[id_col].eqNullSafe(other["_other_id"]), "left_anti" if drop else "left_semi")


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of an Arrow batch; null is empty."""
    return [text or "" for text in batch.column(column).to_pylist()]


def release() -> None:
    """Give memory that this process has freed, but still holds, back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, a function for mapInArrow, with ``release`` after a task's last batch.

    Python workers outlive their tasks, and an executor has up to two for each core where a stage maps
    twice; without this each would hold the memory of its largest task through all later stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def by_bytes(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that none holds more than about ``most`` bytes (one row at least)."""
    for batch in batches:
        pieces = max(1, -(-batch.nbytes // most))
        step = max(1, -(-batch.num_rows // pieces))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
