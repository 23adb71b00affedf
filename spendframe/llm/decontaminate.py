"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in lower case with white space runs as one blank.  A test item of m characters
may be off by k = floor(rate * m) edits.  Cut into k + 1 pieces, one piece at least is unharmed in
any such occurrence, so exact hits of pieces (one Aho-Corasick pass over each document) give every
candidate place; Myers' bit-parallel distance verifies the places around the hits.

The pieces travel to every task, so their size is checked: the benchmark is cut into slices of at
most ``slice_bytes`` of text by a hash of the item, and a larger benchmark takes more passes over
the documents, not more memory.  Documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendframe.llm.base import cut, pick, released, texts_of


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, rate: float) -> list[tuple[int, str]]:
    """(offset, piece): the item cut into one piece more than its edits, of near equal lengths."""
    parts = int(rate * len(item)) + 1
    edges = [len(item) * k // parts for k in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def best_end(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence of ``pattern`` in ``text`` within ``most`` edits, the
    earliest among equals; Myers' recurrence over the columns, all rows of one in an integer's bits."""
    size = len(pattern)
    full, top = (1 << size) - 1, 1 << (size - 1)
    equal: dict[str, int] = {}
    for i, char in enumerate(pattern):
        equal[char] = equal.get(char, 0) | 1 << i
    rises, falls, score, best = full, 0, size, None
    for end, char in enumerate(text, 1):
        match = equal.get(char, 0)
        vertical = match | falls
        diagonal = (((match & rises) + rises) ^ rises) | match
        up, down = falls | (~(diagonal | rises) & full), rises & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        rises, falls = down | (~(vertical | up) & full), up & vertical
        if score <= most and (best is None or score < best[0]):
            best = score, end
    return best


def occurrence(item: str, text: str, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the best occurrence in ``text``; the start is the end of the match backwards."""
    found = best_end(item, text, most)
    if found is None:
        return None
    distance, end = found
    back = best_end(item[::-1], text[max(0, end - len(item) - most) : end][::-1], distance)
    return distance, end - back[1], end


class Matcher:
    """Items with their pieces in one automaton; made once per task."""

    def __init__(self, items: list[str], rate: float):
        self.items, self.most = items, [int(rate * len(item)) for item in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for number, item in enumerate(items):
            for offset, piece in pieces(item, rate):
                places.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int, int]]:
        """{item number: (distance, start, end)}: the best occurrence of each item in a normal text."""
        best: dict[int, tuple[int, int, int]] = {}
        diagonals: dict[int, set[int]] = {}
        for end, (length, found) in self.automaton.iter(text):
            for number, offset in found:
                diagonals.setdefault(number, set()).add(end + 1 - length - offset)
        for number, starts in diagonals.items():
            item, most = self.items[number], self.most[number]
            exact = min((s for s in starts if s >= 0 and text.startswith(item, s)), default=None)
            if exact is not None:
                best[number] = 0, exact, exact + len(item)
                continue
            windows: list[list[int]] = []
            for start in sorted(starts):
                low, high = max(0, start - most), min(len(text), start + len(item) + most)
                if windows and low <= windows[-1][1]:
                    windows[-1][1] = max(high, windows[-1][1])
                else:
                    windows.append([low, high])
            for low, high in windows:
                if got := occurrence(item, text[low:high], most):
                    got = got[0], got[1] + low, got[2] + low
                    best[number] = min(best.get(number, got), got)
        return best


def original_span(raw: str, start: int, end: int) -> tuple[int, int]:
    """Where the words that a span of the normal text touches stand in the raw text (code points)."""
    at, first, last = 0, None, (0, 0)
    for word in re.finditer(r"\S+", raw):
        size = len(word.group().lower())
        if first is None and at + size > start:
            first = word.start()
        if at < end:
            last = word.span()
        at += size + 1
    return first or 0, last[1]


def _slices(benchmark: DataFrame, slice_bytes: int) -> tuple[int, Iterator[pa.Table]]:
    """How many slices the items make, and the slices, fetched one after another."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // slice_bytes)

    def fetched() -> Iterator[pa.Table]:
        for number in range(count):
            part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == number)
            yield part.orderBy("item_id", "text").toArrow()

    return count, fetched()


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    rate: float = 0.05,
    slice_bytes: int = 1 << 21,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document row and test item it holds: ``doc_id``, ``item_id``, ``distance`` (edits), and
    ``start``, ``end`` (the touched words' place in the raw text, code points) of the best occurrence.

    Null and blank texts and items match nothing.  Items of equal text are reported each; repeated
    document rows too.  A null id is kept as null.  Items too short for an edit must occur exactly.
    Other columns are ignored; an empty table gives no rows.
    """
    plain = pick(docs, doc_id=id_col, text=text_col)
    wanted = pick(benchmark, item_id=item_col, text=item_text_col).where(F.trim("text") != "")
    id_type, item_type = (f.schema[0].dataType.simpleString() for f in (plain, wanted))
    schema = f"doc_id {id_type}, item_id {item_type}, distance int, start int, end int"
    result = None
    count, slices = _slices(wanted, slice_bytes)
    for part in slices:
        found = plain.mapInArrow(released(_finder(part, rate)), schema)
        # of several slices each is a pass of its own, written before the next is fetched: the driver holds one
        found = cut(found) if count > 1 else found
        result = found if result is None else result.union(found)
    return docs.sparkSession.createDataFrame([], schema) if result is None else result


def _finder(part: pa.Table, rate: float):
    texts = [normal(x) for x in part.column("text").to_pylist()]
    numbers = [k for k, x in enumerate(texts) if x]
    items, ids = [texts[k] for k in numbers], part.column("item_id").take(pa.array(numbers, pa.int64())).combine_chunks()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, rate) if items else None
        for batch in batches:
            rows = []
            for row, raw in enumerate(texts_of(batch) if matcher else []):
                for number, (distance, start, end) in sorted(matcher.find(normal(raw)).items()):
                    rows.append((row, number, distance, *original_span(raw, start, end)))
            at, number, *rest = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int32())), ids.take(pa.array(number, pa.int32()))]
                + [pa.array(x, pa.int32()) for x in rest],
                ["doc_id", "item_id", "distance", "start", "end"],
            )

    return find
