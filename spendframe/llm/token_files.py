"""Token ids in binary files with Elias-Fano document boundaries.

Documents are dealt into ranges of ascending ids, sorted within, encoded and written: each task
writes files of at most ``file_ids`` ids (one document at least).  A file holds two Elias-Fano
sequences, document ids and boundaries, and the ids of all its documents one after another, in 16
bits where the vocabulary allows.  Files are written under a passing name and renamed, and named by
their place in the order, so a task that runs again leaves the same file.  The manifest, one row a
file, says which files count and how many ids come before each.
"""

from __future__ import annotations

import functools
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spendframe.llm.base import cut, pick, shared_folder, texts_of
from spendframe.llm.elias_fano import EliasFano
from spendframe.llm.pretokens import splitter, unlike

MAGIC = b"TOKENS01"
HEADER = struct.Struct("<8sQQQB")  # magic, documents, of those without id, ids, bytes an id
#: The pattern of the vocabulary's words, and the strings it gives ids of their own.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
#: Characters up to U+00FF on which splitting engines may differ, and chunks a task remembers before it starts afresh.
ODD_LATIN = bytes(c for c in range(0x100) if unlike(chr(c)))
REMEMBERED = 1 << 19
#: Documents whose boundaries are read at a time.
AT_ONCE = 4096


def _byte_letters() -> dict[int, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(0x100) if b not in plain]
    return {b: b for b in plain} | {b: 0x100 + k for k, b in enumerate(other)}


class _Words(dict):
    """Ids of the vocabulary's words, as little-endian bytes; each different one meets the merges once."""

    def __init__(self, whole: Tokenizer):
        super().__init__()
        self.merge, self.letters = whole.model.tokenize, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        spelt = word.encode().decode("latin-1").translate(self.letters)
        ids = self[word] = array("I", [token.id for token in self.merge(spelt)]).tobytes()
        return ids


class _Chunks(dict):
    """Ids of what stands between blanks: one or more words and signs."""

    def __init__(self, words: _Words):
        super().__init__()
        self.words, self.split = words, splitter(PATTERN)

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[chunk] = b"".join([self.words[word] for word in self.split(chunk)])
        return ids


@functools.lru_cache(1)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """A function from text to ids (unsigned, 32 bits), equal to the library's own on whole texts.

    No word of the vocabulary's pattern holds a blank, so a text is cut at blanks first and each different
    chunk is split and merged once.  Texts of Latin-1 letters need no normal form.  Texts with characters on
    which splitting engines differ, or with special strings, go to the library whole.  What a Python worker has
    encoded it keeps for its next tasks, within REMEMBERED words and as many chunks."""
    whole = Tokenizer.from_file(path)
    known = _Chunks(_Words(whole))

    def encode(text: str) -> np.ndarray:
        try:
            latin = text.encode("latin-1")
            odd = len(latin.translate(None, ODD_LATIN)) != len(latin)
        except UnicodeEncodeError:
            latin, odd = None, unlike(text)
        if odd or any(s in text for s in SPECIAL):
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
        if latin is None:
            text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ") if "Σ" in text else text
        return np.frombuffer(b"".join(map(known.__getitem__, text.lower().split())), np.uint32)

    return encode


def to_bytes(doc_ids: list[int | None], documents: list[np.ndarray]) -> bytes:
    """One file: documents in ascending order of id, those without id first."""
    ids = np.concatenate([np.empty(0, np.uint32), *documents])
    missing = sum(d is None for d in doc_ids)
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    ends = np.concatenate([[0], np.cumsum([len(d) for d in documents], dtype=np.int64)]).astype(np.int64)
    head = HEADER.pack(MAGIC, len(documents), missing, len(ids), width)
    present = np.array([d for d in doc_ids if d is not None], np.int64)
    return head + EliasFano.of(present).to_bytes() + EliasFano.of(ends).to_bytes() + ids.astype(f"<u{width}").tobytes()


class TokenFile:
    """A file's documents by number: ``doc_id(k)``, ``bounds(k)`` and ``ids(k)`` read only what they need."""

    def __init__(self, blob: bytes):
        view = memoryview(blob)
        magic, self.documents, self.missing, self.n_ids, self.width = HEADER.unpack_from(view)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.names, size = EliasFano.from_bytes(view[HEADER.size :])
        self.ends, more = EliasFano.from_bytes(view[HEADER.size + size :])
        self.tokens = np.frombuffer(view, f"<u{self.width}", self.n_ids, HEADER.size + size + more)

    def doc_id(self, number: int) -> int | None:
        return None if number < self.missing else self.names.select(number - self.missing)

    def bounds(self, number: int) -> tuple[int, int]:
        return self.ends.select(number), self.ends.select(number + 1)

    def ids(self, number: int) -> np.ndarray:
        return self.tokens[slice(*self.bounds(number))]


def _store(folder: str, name: str, blob: bytes) -> None:
    store, path = fs.FileSystem.from_uri(folder)
    passing = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(passing) as out:
        out.write(blob)
    store.move(passing, f"{path}/{name}")


def write(
    docs: DataFrame, folder: str, *, vocabulary: str, end_id: int = 2, file_ids: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Writes the files into ``folder`` (a URI) and returns the manifest, computed: ``name``, ``n_docs``, ``n_ids``, ``before``.

    Null and empty texts are the end id alone.  Null ids come first; equal ids go by text; repeated
    rows are repeated documents.  Ids are whole numbers.  Other columns are ignored."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, number = encoder(vocabulary), TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            name = f"{task:08d}-{number:06d}.tokens"
            _store(folder, name, to_bytes(names, held))
            row = {"name": name, "n_docs": len(held), "n_ids": int(sum(map(len, held)))}
            return pa.RecordBatch.from_pylist([row], pa.schema([("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        size = 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                ids = np.append(encode(text), np.uint32(end_id))
                if held and size + len(ids) > file_ids:
                    yield flush()
                    names, held, size, number = [], [], 0, number + 1
                names.append(doc)
                held.append(ids)
                size += len(ids)
        if held:
            yield flush()

    plain = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered = plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = cut(ordered.mapInArrow(run, "name string, n_docs bigint, n_ids bigint"))
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("before", before)


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per stored document: ``doc_id``, ``start`` (ids before it), ``n_tokens``, ``ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, blob in zip(batch.column("path").to_pylist(), batch.column("content")):
                file = TokenFile(blob.as_py())
                for first in range(0, file.documents, AT_ONCE):
                    last = min(first + AT_ONCE, file.documents)
                    bounds = file.ends.select_range(first, last + 1)
                    missing = max(0, min(file.missing, last) - first)
                    names = [None] * missing + file.names.select_range(first + missing - file.missing, last - file.missing).tolist()
                    tokens = file.tokens[bounds[0] : bounds[-1]].astype("<u4")
                    edges = (bounds - bounds[0]).tolist()
                    crc = [zlib.crc32(tokens[a:b]) for a, b in zip(edges[:-1], edges[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([path.rsplit("/", 1)[-1]] * len(names), pa.string()),
                            pa.array(names, pa.int64()),
                            pa.array(bounds[:-1], pa.int64()),
                            pa.array(np.diff(bounds), pa.int64()),
                            pa.array(crc, pa.int64()),
                        ],
                        ["file", "doc_id", "inner", "n_tokens", "ids_crc32"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(folder).select("path", "content")
    rows = files.mapInArrow(run, "file string, doc_id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(manifest, rows["file"] == manifest["name"]).select(
        "doc_id", (F.col("before") + F.col("inner")).cast("long").alias("start"), "n_tokens", "ids_crc32"
    )


def new_folder(spark: SparkSession) -> str:
    """A folder of its own among the shared intermediate tables, as a URI."""
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
