"""SimHash near-duplicates: fingerprints, links within a radius by bit-sliced comparison, components.

Fingerprints that are equal are one class from the start, so thousands of exact copies are one row
when classes are compared.  The 64 bits are cut into radius + 2 blocks: two fingerprints within the
radius agree in two blocks at least, so every pair of blocks is a key (6 keys of 32 bits for radius
2) and all linked classes share one.  Classes with a common key are compared with bit planes; each
bucket gives the links of a spanning forest, never all of its pairs.

A bucket with more than ``bucket`` classes is dealt out: its classes are spread over chunks and
every two chunks meet in one group, so the whole bucket is compared and no task holds more than two
chunks of it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendframe.llm.base import cut, pick, released, texts_of
from spendframe.llm.bit_planes import lowest_labels, near, near_pairs
from spendframe.llm.components import components

SEED = 42
#: Shingles whose bits are unpacked at a time, and rows of whole buckets compared at a time.
SHINGLES_AT_ONCE, ROWS_AT_ONCE = 1 << 16, 1 << 15
#: Buckets up to this size are compared offset by offset for all buckets at once.
SMALL = 32


def fingerprint(text: str, shingle: int = 3) -> int:
    """Unsigned SimHash of a text; 0 without words."""
    words = text.encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII blanks
    if not words:
        return 0
    if len(words) <= shingle:
        grams: Iterator = iter([tuple(words)])
        total = 1
    else:
        grams = zip(*(words[k:] for k in range(shingle)))
        total = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    while part := [digest(join(gram), SEED) for gram in itertools.islice(grams, SHINGLES_AT_ONCE)]:
        hashes = np.array(part, np.uint64).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(hashes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, print): one row per input row; the fingerprint as a signed long."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], ["doc_id", "print"])

    plain = pick(docs, doc_id=id_col, text=text_col)
    return plain.mapInArrow(released(compute), f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, print bigint")


def _keyed(classes: DataFrame, radius: int, bucket: int) -> DataFrame:
    """(key, lo, hi, print): each class under its keys; those of large buckets once for each other chunk."""
    edges = [round(64 * k / (radius + 2)) for k in range(radius + 3)]
    blocks = [
        F.shiftrightunsigned("print", low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        for low, high in itertools.pairwise(edges)
    ]
    keys = [F.xxhash64(F.lit(i), F.lit(j), blocks[i], blocks[j]) for i, j in itertools.combinations(range(radius + 2), 2)]
    keyed = classes.select("print", F.explode(F.array(*keys)).alias("key"))
    large = keyed.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n")).where(F.col("n") > bucket)
    chunks = F.coalesce(F.ceil(F.col("n") / bucket), F.lit(1)).cast("int")
    keyed = keyed.join(large, F.col("key") == F.col("_key"), "left").select(
        "key", "print", chunks.alias("chunks"), F.pmod(F.xxhash64("print", F.lit(1)), chunks).cast("int").alias("own")
    )
    others = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(
        F.array_except(F.sequence(F.lit(0), F.col("chunks") - 1), F.array("own"))
    )
    keyed = keyed.select("key", "print", "own", F.explode(others).alias("other"))
    return keyed.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "print")


def _forest(prints: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of each bucket; bucket k is prints[starts[k]:starts[k + 1]]."""
    n, sizes = len(prints), np.diff(starts)
    place = np.arange(n) - np.repeat(starts[:-1], sizes)
    after = np.repeat(sizes, sizes) - place  # rows from here to the bucket's end
    small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    labels, lefts, rights = np.arange(n), [], []
    for offset in range(1, SMALL):
        at = np.flatnonzero(small & (after > offset))
        if not len(at):
            break
        at = at[near(prints[at], prints[at + offset], radius)]
        lefts.append(at)
        rights.append(at + offset)
    if lefts:
        labels = lowest_labels(n, np.concatenate(lefts), np.concatenate(rights), labels)
    for k in np.flatnonzero(sizes > SMALL):
        own = np.arange(sizes[k])
        for i, j in near_pairs(prints[starts[k] : starts[k + 1]], radius):
            own = lowest_labels(len(own), i, j, own)
        labels[starts[k] : starts[k + 1]] = own + starts[k]
    moved = np.flatnonzero(labels != np.arange(n))
    return prints[moved], prints[labels[moved]]


def links(classes: DataFrame, *, radius: int = 2, bucket: int = 4096) -> DataFrame:
    """(a, b): links between different fingerprints (column ``print``) that join all within the radius.

    The links are those of spanning forests, so components are whole though not all pairs are listed."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def settle(rows: np.ndarray, last: bool):
            new = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            end = len(rows) if last else (new[-1] if len(new) else 0)
            starts = np.concatenate([[0], new[new < end], [end]])
            a, b = _forest(np.ascontiguousarray(rows[:end, 3]).view(np.uint64), starts, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"]), rows[end:]

        for batch in batches:
            held.append(np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1))
            if sum(map(len, held)) >= ROWS_AT_ONCE:
                found, rest = settle(np.concatenate(held), False)
                held = [rest]
                yield found
        if held and sum(map(len, held)):
            yield settle(np.concatenate(held), True)[0]

    keyed = _keyed(classes, radius, bucket)
    return keyed.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(released(compare), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, bucket: int = 4096
) -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id among documents reachable over links of at most ``radius``
    differing bits.  Null, empty and blank texts have fingerprint zero and are linked like any other.
    A null id gets its fingerprint, and names a component (as null) only if all its ids are null.
    Repeated rows get equal results.  Other columns are ignored; an empty table gives no rows.
    """
    prints = cut(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    classes = cut(prints.groupBy("print").agg(F.min("doc_id").alias("first")))
    labels = components(links(classes.select("print"), radius=radius, bucket=bucket))
    grouped = classes.join(labels, F.col("print") == F.col("node"), "left").select(
        F.col("print").alias("_print"), "first", F.coalesce("label", "print").alias("label")
    )
    lowest = grouped.groupBy(F.col("label").alias("_label")).agg(F.min("first").alias("component_id"))
    named = grouped.join(lowest, F.col("label") == F.col("_label")).select("_print", "component_id")
    return prints.join(named, F.col("print") == F.col("_print")).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )
