"""Byte-level BPE: every distinct word of the corpus is encoded once.

Documents are taken in blocks of bounded size.  A block names its distinct words (pre-tokens) and
keeps each document as the row of its words' places in that list.  The lists are shuffled by word,
packed by (block, word partition); a partition sees every block's copy of a word and encodes it the
first time only.  The ids travel back to the block, and the documents are reassembled by position.

Common words cost one entry per block, not one per occurrence, so nothing is skewed: a word in all
documents is a few bytes for each block.  Blocks are told apart by partition, number and a digest
of their texts; should a re-run block ever differ from the one whose words were encoded, its job
stops instead of mixing them.  Inputs must therefore be re-readable in the same order, as files are.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from spendframe.llm.base import by_bytes, pick, release, released, texts_of
from spendframe.llm.pretokens import splitter

BLOCK_BYTES = 4 << 20
#: Words of a block that are Python strings at a time (those of one text at least).
WORDS_AT_ONCE = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, bytes of equal weight together, compressed."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(planes.tobytes(), 3)


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _block(batch: pa.RecordBatch, split, number: int):
    """(name, words per document, places, distinct words) of one block."""
    counts, held, columns = np.empty(batch.num_rows, np.uint32), [], []
    for row, text in enumerate(texts_of(batch)):
        found = split(text)
        counts[row] = len(found)
        held += found
        if len(held) >= WORDS_AT_ONCE:
            columns.append(pa.array(held, pa.string()))
            held = []
    coded = pa.chunked_array([*columns, pa.array(held, pa.string())]).dictionary_encode().combine_chunks()
    digest = xxhash.xxh64_intdigest(batch.column("text").fill_null("").cast(pa.binary()).to_pylist().__repr__()) & 0xFFFFFFFF
    name = f"{TaskContext.get().partitionId()}:{number}:{digest}"
    return name, counts, coded.indices.to_numpy(), coded.dictionary


def _documents(pattern: str, block_bytes: int, id_type: pa.DataType):
    """Blocks as (block, ids, counts, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(pattern)
        for number, batch in enumerate(by_bytes(batches, block_bytes)):
            name, counts, places, _ = _block(batch, split, number)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name]),
                    pa.array([batch.column("doc_id").to_pylist()], pa.list_(id_type)),
                    pa.array([pack(counts)], pa.binary()),
                    pa.array([pack(places)], pa.binary()),
                ],
                ["block", "ids", "counts", "places"],
            )

    return run


def _words(pattern: str, block_bytes: int, parts: int):
    """Distinct words of each block as (part, block, places, sizes, letters), one row for each word partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(pattern)
        for number, batch in enumerate(by_bytes(batches, block_bytes)):
            name, _, _, distinct = _block(batch, split, number)
            words = distinct.cast(pa.binary()).to_pylist()
            part = np.fromiter((zlib.crc32(word) % parts for word in words), np.int64, len(words))
            order = np.argsort(part, kind="stable")
            used, starts = np.unique(part[order], return_index=True)
            rows = []
            for which in np.split(order, starts[1:]) if len(words) else []:
                own = [words[k] for k in which]
                sizes = np.fromiter(map(len, own), np.uint32, len(own))
                rows.append((pack(which), pack(sizes), zstandard.compress(b"".join(own), 3)))
            columns = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(used), pa.array([name] * len(rows), pa.string())] + [pa.array(c, pa.binary()) for c in columns],
                ["part", "block", "places", "sizes", "letters"],
            )

    return run


def _encode_words(path: str, pattern: str):
    """(block, places, counts, tokens): ids of each listed word; each distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={}).encode_ordinary
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            rows = []
            for places, sizes, letters in zip(*(batch.column(c).to_pylist() for c in ("places", "sizes", "letters"))):
                joined, tokens, ends = zstandard.decompress(letters), [], np.cumsum(unpack(sizes)).tolist()
                counts, start = np.empty(len(ends), np.uint32), 0
                for k, end in enumerate(ends):
                    word, start = joined[start:end], end
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = encode(word.decode())
                    tokens += ids
                    counts[k] = len(ids)
                rows.append((places, pack(counts), pack(np.array(tokens, np.uint32))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block")] + [pa.array(c, pa.binary()) for c in (zip(*rows) if rows else [(), (), ()])],
                ["block", "places", "counts", "tokens"],
            )

    return run


def _reassemble(id_type: pa.DataType):
    """Documents of one block from their places and its words' ids."""
    out = pa.schema([("doc_id", id_type), ("ids", pa.list_(pa.int32()))])

    def assemble(documents: pa.Table, words: pa.Table) -> pa.Table:
        if documents.num_rows != 1:
            raise ValueError("words were encoded for a block that is not there now: the input changed between reads")
        block = documents.to_pylist()[0]
        counts, places = unpack(block["counts"]), unpack(block["places"])
        rows = words.select(["places", "counts", "tokens"]).to_pylist()
        where = np.concatenate([np.empty(0, np.uint32), *(unpack(r["places"]) for r in rows)]).astype(np.int64)
        lengths = np.concatenate([np.empty(0, np.uint32), *(unpack(r["counts"]) for r in rows)]).astype(np.int64)
        tokens = np.concatenate([np.empty(0, np.uint32), *(unpack(r["tokens"]) for r in rows)]).astype(np.int32)
        if len(places) and int(places.max()) >= len(where):
            raise ValueError("words of a block are missing: the input changed between reads")
        length, first = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
        length[where], first[where] = lengths, np.cumsum(lengths) - lengths
        each = length[places]
        ends = np.concatenate([[0], np.cumsum(each)])
        flat = tokens[np.repeat(first[places] - ends[:-1], each) + np.arange(ends[-1])]
        offsets = ends[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
        return pa.table([pa.array(block["ids"], id_type), lists], schema=out)

    def run(documents: pa.Table, words: pa.Table) -> pa.Table:
        try:
            return assemble(documents, words)
        finally:  # its arrays are gone by now; a worker doesn't know its last block
            release()

    return run


def encode(
    docs: DataFrame, *, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(doc_id, ids array<int>): one row per input row.

    ``ranks`` is a rank file every executor can open.  Null and empty texts have no ids; strings that
    look like special tokens are ordinary text.  Null ids and repeated rows are kept as they are;
    other columns are ignored; an empty table gives no rows.  A document is never cut, so a block
    holds one text at least, however long.
    """
    plain = pick(docs, doc_id=id_col, text=text_col)
    kind = plain.schema["doc_id"].dataType
    id_type, name = to_arrow_type(kind), kind.simpleString()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = plain.mapInArrow(released(_documents(pattern, block_bytes, id_type)), f"block string, ids array<{name}>, counts binary, places binary")
    words = plain.mapInArrow(
        released(_words(pattern, block_bytes, parts)), "part bigint, block string, places binary, sizes binary, letters binary"
    )
    encoded = words.repartition(parts, "part").mapInArrow(
        released(_encode_words(ranks, pattern)), "block string, places binary, counts binary, tokens binary"
    )
    return (
        blocks.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(_reassemble(id_type), f"doc_id {name}, ids array<int>")
    )


def decode(encoded: DataFrame, *, ranks: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of each row's ids.  Null ids give null.

    Ids are dense, so the join with the token-byte table is a lookup by row number in a table that
    every task reads from the rank file (bounded by the vocabulary).  An unknown id is an error."""
    columns = [c for c in encoded.columns if c != "decoded"]
    frame = encoded.select(*(f"`{c}`" for c in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = read_ranks(ranks)
        by_id: list[bytes | None] = [None] * (max(known.values()) + 1)
        for token, rank in known.items():
            by_id[rank] = token
        tokens = pa.array(by_id, pa.binary())
        for batch in by_bytes(batches, BLOCK_BYTES):
            ids = batch.column(ids_col)
            first, last = (ids.offsets[k].as_py() for k in (0, -1))  # of a slice, whose values are those of the whole
            own = tokens.take(ids.values.slice(first, last - first))
            lists = pa.ListArray.from_arrays(pc.subtract(ids.offsets, first), own, mask=pc.is_null(ids) if ids.null_count else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pc.binary_join(lists, b"")], [*columns, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    return frame.mapInArrow(released(run), f"{fields}, decoded binary")
