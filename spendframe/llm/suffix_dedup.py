"""Removing every byte under a string of ``width`` bytes that also starts anywhere else.

1. Texts are told apart by digest; a text with copies is repeated as a whole and one of it goes on.
2. Anchors: in every window of ``width`` bytes the first place with the lowest hash of its next ``gram``
   bytes.  Equal windows have equal anchors, so a repeated string's anchor occurs at two places.
   An anchor's windows follow one another; their bytes are its piece, told apart by a hash.  Each window
   is in one piece, and what lies outside an anchor's own windows does not tell pieces apart.
3. Places are counted by anchor and piece, in an aggregate that combines on the map side, so a passage
   in a third of all texts is one row from there on, with its lowest and highest place.  An anchor
   with one kind of piece needs no comparison; of all others one of each piece is fetched.
4. Pieces meet by anchor in shards: suffix arrays by Larsson-Sadakane refinement and Kasai's common
   prefixes mark windows that occur at two places.  An anchor with more pieces than one shard holds is
   split over shards whose arrays are merged by binary search.
5. An anchor with over ``anchor_pieces`` kinds of piece is no single task's work: its windows are
   counted by a 128-bit digest, again in an aggregate that combines on the map side.
6. Marked ranges of pieces go back to all their places, and from there to the texts.

Texts move once, by digest (all later steps share that exchange); everything else is anchors, one in
about eighty bytes, which are written once, and one of each piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendframe.llm.base import by_bytes, cut, pick, texts_of
from spendframe.llm.suffix_array import DEPTH, SEPARATOR, common_prefixes, locate, suffix_array

BLOCK_BYTES, SHARD_BYTES = 2 << 20, 1 << 19


def _slide(values: np.ndarray, size: int, pick_of) -> np.ndarray:
    """pick_of (minimum or maximum) over each ``size`` neighbours, by doubling."""
    done = 1
    while done * 2 <= size:
        values = pick_of(values[:-done], values[done:])
        done *= 2
    rest = size - done
    return pick_of(values[: len(values) - rest], values[rest:]) if rest else values


def segments(data: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes): pieces, the bytes of neighbouring windows of ``width`` bytes that have one
    anchor, the first of the grams with the window's lowest hash.  Every window is in one piece."""
    if len(data) < width:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    word = data.astype(np.uint64)
    for size in (1, 2, 4):
        word = (word[:-size] << np.uint64(8 * size)) | word[size:]
    count = len(data) - gram + 1
    mixed = np.zeros(count, np.uint64)
    for k in range(0, gram, 8):
        mixed = (mixed ^ word[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    lowest = _slide(mixed, width - gram + 1, np.minimum)
    # another anchor: another lowest hash, or the gram that left the window had it and an equal one has it now
    fresh = (lowest[1:] != lowest[:-1]) | (mixed[: len(lowest) - 1] == lowest[1:])
    starts = np.concatenate([[0], np.flatnonzero(fresh) + 1])
    ends = np.concatenate([starts[1:], [len(lowest)]]) - 1 + width
    return starts, ends, lowest[starts]


def _anchor_rows(width: int, gram: int):
    """(content, place, size, key, piece): where each piece is, its anchor's hash and that of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, BLOCK_BYTES):
            none = np.empty(0, np.int64)
            number, place, size, key = [none], [none], [none], [none.view(np.uint64)]
            pieces: list[int] = []
            for k, text in enumerate(texts_of(batch)):
                data = text.encode()
                starts, ends, hashes = segments(np.frombuffer(data, np.uint8), width, gram)
                number.append(np.full(len(starts), k))
                place.append(starts)
                size.append(ends - starts)
                key.append(hashes)
                pieces += [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("content").take(pa.array(np.concatenate(number))),
                    pa.array(np.concatenate(place)),
                    pa.array(np.concatenate(size).astype(np.int32)),
                    pa.array(np.concatenate(key).view(np.int64)),
                    pa.array(np.array(pieces, np.uint64).view(np.int64)),
                ],
                ["content", "place", "size", "key", "piece"],
            )

    return run


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, piece, low, high, bytes) of the pieces that are fetched from a text."""
    for batch in by_bytes(batches, BLOCK_BYTES):
        columns: list[list] = [[], [], [], [], []]
        for text, wanted in zip(texts_of(batch), batch.column("wanted").to_pylist()):
            data = text.encode() if wanted else b""
            for one in wanted or []:
                held = data[one["place"] : one["place"] + one["size"]]
                for column, value in zip(columns, (one["key"], one["piece"], one["low"], one["high"], held)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], ["key", "piece", "low", "high", "bytes"]
        )


def _marked(pieces: list[bytes], low: np.ndarray, high: np.ndarray, groups: np.ndarray, width: int) -> list[np.ndarray]:
    """For each piece, the starts of its windows that occur at two places or more.

    ``low`` and ``high``: the lowest and highest place of each piece's first byte, as numbers that rise by
    one with each byte; ``groups``: its anchor, rising.  Pieces of one anchor differ from each other."""
    marks = [np.empty(0, np.int64)] * len(pieces)
    sizes = np.bincount(groups, minlength=int(groups[-1]) + 1) if len(groups) else groups
    shards: list[list[int]] = []
    size, last = 0, None
    for k, group in enumerate(groups.tolist()):
        if sizes[group] == 1:  # nothing to compare with
            if low[k] < high[k]:
                marks[k] = np.arange(max(0, len(pieces[k]) - width + 1))
            continue
        length = len(pieces[k]) + 1
        if not shards or size + length > SHARD_BYTES or (last != group and size > SHARD_BYTES // 2):
            shards.append([])
            size = 0
        shards[-1].append(k)
        size, last = size + length, group
    pairs = _split_pairs(shards, groups)
    shared = {number for pair in pairs for number in pair}
    built = {}
    for number, shard in enumerate(shards):
        made = _Shard(shard, pieces, low, high, width)
        if number in shared:
            built[number] = made
        else:
            made.mark(marks)
    for a, b in pairs:
        built[a].merge(built[b])
    for made in built.values():
        made.mark(marks)
    return marks


class _Shard:
    """Surroundings in one suffix array.  Equal windows are a run of it; ``low`` and ``high`` are the
    lowest and highest place of each run's windows."""

    def __init__(self, rows: list[int], pieces: list[bytes], low: np.ndarray, high: np.ndarray, width: int):
        self.rows, self.width = rows, width
        data = b"".join(pieces[k] + bytes([SEPARATOR]) for k in rows) + bytes([SEPARATOR]) * DEPTH
        self.text = np.frombuffer(data, np.uint8)
        sizes = np.array([len(pieces[k]) for k in rows])
        first = np.cumsum(sizes + 1) - sizes - 1
        self.order = suffix_array(self.text)
        fresh = common_prefixes(self.text, self.order) < width
        fresh[:1] = True
        owner = (np.searchsorted(first, self.order, side="right") - 1).astype(np.int32)
        fits = self.order + width <= (first + sizes)[owner]
        self.run = (np.cumsum(fresh) - 1).astype(np.int32)
        # only windows that lie within their piece matter from here on
        self.at = np.flatnonzero(fits)
        self.owner = owner[self.at]
        self.inner = self.order[self.at] - first[self.owner]
        self.of = self.run[self.at]
        runs = int(self.run[-1]) + 1 if len(self.run) else 0
        self.low, self.high = np.full(runs, np.iinfo(np.int64).max), np.full(runs, np.iinfo(np.int64).min)
        np.minimum.at(self.low, self.of, low[rows][self.owner] + self.inner)
        np.maximum.at(self.high, self.of, high[rows][self.owner] + self.inner)

    def merge(self, other: _Shard) -> None:
        """Each run of ``other`` that also occurs here, found by binary search, shares its bounds with ours."""
        ask = other.at[np.concatenate([[True], np.diff(other.of) != 0])] if len(other.at) else other.at
        for part in np.array_split(ask, -(-len(ask) // 8192)) if len(ask) else []:
            hit = locate(self.text, self.order, other.text, other.order[part], self.width)
            mine, theirs = self.run[hit[hit >= 0]], other.run[part[hit >= 0]]
            self.low[mine] = other.low[theirs] = np.minimum(self.low[mine], other.low[theirs])
            self.high[mine] = other.high[theirs] = np.maximum(self.high[mine], other.high[theirs])

    def mark(self, marks: list[np.ndarray]) -> None:
        hit = np.flatnonzero((self.low < self.high)[self.of])
        hit = hit[np.argsort(self.owner[hit], kind="stable")]
        edges = np.searchsorted(self.owner[hit], np.arange(len(self.rows) + 1))
        for number, k in enumerate(self.rows):
            marks[k] = np.sort(self.inner[hit[edges[number] : edges[number + 1]]])


def _split_pairs(shards: list[list[int]], groups: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of shards that hold surroundings of the same anchor (twice over, so that bounds reach all)."""
    holders: dict[int, list[int]] = {}
    for number, shard in enumerate(shards):
        for group in set(groups[shard].tolist()):
            holders.setdefault(group, []).append(number)
    pairs = {(a, b) for held in holders.values() for a in held for b in held if a < b}
    return sorted(pairs) + sorted(pairs, reverse=True)


def _ranges(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows starting at the sorted ``starts``, as ranges that neither overlap nor touch."""
    if not len(starts):
        return starts, starts
    new = np.concatenate([[True], np.diff(starts) > width])
    return starts[new], starts[np.concatenate([new[1:], [True]])] + width


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
MARKED = "key bigint, piece bigint, ranges array<struct<start:bigint,end:bigint>>"


def _shards(width: int, rows_bytes: int = 4 * SHARD_BYTES):
    """(key, piece, marked ranges) of pieces that come sorted by anchor; whole anchors are held at a time."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        groups = np.unique(rows.column("key").to_numpy(), return_inverse=True)[1]
        low, high = (rows.column(name).to_numpy() for name in ("low", "high"))
        marks = _marked(rows.column("bytes").to_pylist(), low, high, groups, width)
        hit = [k for k, windows in enumerate(marks) if len(windows)]
        ranges = [[{"start": a, "end": b} for a, b in zip(*(x.tolist() for x in _ranges(marks[k], width)))] for k in hit]
        keys, pieces = (rows.column(name).take(pa.array(hit, pa.int64())).combine_chunks() for name in ("key", "piece"))
        return pa.RecordBatch.from_arrays([keys, pieces, pa.array(ranges, pa.list_(SPAN))], ["key", "piece", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in by_bytes(batches, rows_bytes):
            held.append(batch)
            if sum(b.nbytes for b in held) < rows_bytes:
                continue
            rows = pa.Table.from_batches(held)
            keys = rows.column("key").to_numpy()
            end = int(np.flatnonzero(keys == keys[-1])[0])  # the last anchor may go on in the next batch
            if end:
                yield settle(rows.slice(0, end).combine_chunks())
                held = rows.slice(end).combine_chunks().to_batches()
        if held and (rows := pa.Table.from_batches(held)).num_rows:
            yield settle(rows.combine_chunks())

    return run


def _digests(width: int):
    """(one, two, key, piece, start, low, high) of every window of the pieces, by a 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, BLOCK_BYTES // 64):
            one, two, starts, number = [], [], [], []
            for k, piece in enumerate(batch.column("bytes").to_pylist()):
                for i in range(len(piece) - width + 1):
                    digest = xxhash.xxh3_128_intdigest(piece[i : i + width])
                    one.append(digest >> 64)
                    two.append(digest & (1 << 64) - 1)
                    starts.append(i)
                    number.append(k)
            at, start = np.array(number, np.int64), np.array(starts, np.int64)
            low, high = (batch.column(name).to_numpy()[at] + start for name in ("low", "high"))
            names = [batch.column(name).take(pa.array(at)) for name in ("key", "piece")]
            hashes = [pa.array(np.array(part, np.uint64).view(np.int64)) for part in (one, two)]
            yield pa.RecordBatch.from_arrays([*hashes, *names, *map(pa.array, (start, low, high))], ["one", "two", "key", "piece", "start", "low", "high"])

    return run


def _spans(marks: list[dict]) -> list[tuple[int, int]]:
    """Byte ranges of a text from the ranges within its pieces (none named: the whole piece), in order."""
    spans = []
    for mark in marks:
        place = mark["place"]
        if mark["ranges"] is None:
            spans.append((place, place + mark["size"]))
        else:
            spans += [(place + r["start"], place + r["end"]) for r in mark["ranges"]]
    return sorted(spans)


def _removed(width: int):
    """What is left of each text when its marked ranges, or all of a text with copies, go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, BLOCK_BYTES):
            rows = []
            for text, copies, marks in zip(texts_of(batch), batch.column("copies").to_pylist(), batch.column("marks").to_pylist()):
                data = text.encode()
                spans = [(0, len(data))] if copies > 1 and len(data) >= width else _spans(marks or [])
                merged: list[list[int]] = []
                for low, high in spans:
                    if merged and low <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], high)
                    else:
                        merged.append([low, high])
                left, done = [], 0
                for low, high in merged:
                    left.append(data[done:low])
                    done = high
                left.append(data[done:])
                rows.append((len(data), sum(b - a for a, b in merged), merged, b"".join(left)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("content"),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in r[2]] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows], pa.string()),
                ],
                ["content", "n_bytes", "n_removed", "removed", "kept_sha256"],
            )

    return run


def repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 200, gram: int = 64, anchor_pieces: int = 16_000
) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_bytes``, ``n_removed``, ``removed`` (ranges of bytes), ``kept_sha256``.

    Null and empty texts have no bytes.  Texts shorter than ``width`` lose nothing.  Repeated rows and
    copies are places of their own, so all of them go.  Null ids are kept; other columns are ignored;
    an empty table gives no rows.  ``gram`` is a multiple of 8 and less than ``width``.
    """
    plain = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    plain = plain.withColumn("content", F.unhex(F.md5(F.encode("text", "UTF-8"))))
    # the same three columns wherever the texts are used, so that all uses share one exchange of them
    texts = plain.groupBy("content").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    found = cut(texts.mapInArrow(_anchor_rows(width, gram), "content binary, place bigint, size int, key bigint, piece bigint"))

    # anchors at one place only are most of them and go first, by counts that combine on the map side
    counts = found.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("places")).where("places > 1").select("_key")
    again = cut(found.join(counts, F.col("key") == F.col("_key")).drop("_key"))
    # places as numbers that rise with each byte; two bits less than a long has, so that no sum overflows
    first = F.shiftright(F.xxhash64("content"), 2) + F.col("place")
    one = [F.first(name).alias(name) for name in ("content", "place", "size")]
    kinds = again.groupBy("key", "piece").agg(F.min(first).alias("low"), F.max(first).alias("high"), *one)
    kinds = cut(kinds)  # settled: which place stands for a piece must not change
    several = kinds.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("kinds"))
    kinds = cut(kinds.join(several, F.col("key") == F.col("_key")).drop("_key"))

    wanted = kinds.where("kinds > 1").select("content", F.struct("key", "piece", "low", "high", "place", "size", "kinds").alias("w"))
    wanted = wanted.groupBy(F.col("content").alias("_content")).agg(F.collect_list("w").alias("wanted"))
    asked = texts.join(wanted, F.col("content") == F.col("_content"))

    def pieces(condition: str) -> DataFrame:
        chosen = F.expr(f"filter(wanted, w -> w.kinds {condition} {anchor_pieces})")
        return asked.select("text", chosen.alias("wanted")).mapInArrow(_fetched, "key bigint, piece bigint, low bigint, high bigint, bytes binary")

    alone = kinds.where("kinds = 1").select("key", "piece", F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("ranges"))
    small = pieces("<=").repartition("key").sortWithinPartitions("key").mapInArrow(_shards(width), MARKED)
    marks = [alone, small]
    if not kinds.where(F.col("kinds") > anchor_pieces).isEmpty():
        windows = pieces(">").mapInArrow(_digests(width), "one bigint, two bigint, key bigint, piece bigint, start bigint, low bigint, high bigint")
        same = windows.groupBy(F.col("one").alias("_one"), F.col("two").alias("_two")).agg(F.min("low").alias("_low"), F.max("high").alias("_high"))
        large = windows.join(same.where("_low <> _high"), (F.col("one") == F.col("_one")) & (F.col("two") == F.col("_two")), "left_semi")
        spans = F.transform(F.array_sort(F.collect_set("start")), lambda s: F.struct(s.alias("start"), (s + width).alias("end")))
        marks.append(large.groupBy("key", "piece").agg(spans.alias("ranges")))
    marked = marks[0].unionByName(marks[1])
    for more in marks[2:]:
        marked = marked.unionByName(more)
    marked = marked.select(F.col("key").alias("_key"), F.col("piece").alias("_piece"), "ranges")
    at = again.join(marked, (F.col("key") == F.col("_key")) & (F.col("piece") == F.col("_piece"))).select(
        F.col("content").alias("_content"), F.struct("place", "size", "ranges").alias("mark")
    )
    gone = at.groupBy("_content").agg(F.collect_list("mark").alias("marks"))
    judged = (
        texts.join(gone, F.col("content") == F.col("_content"), "left")
        .select("content", "text", "copies", "marks")
        .mapInArrow(
            _removed(width),
            "content binary, n_bytes bigint, n_removed bigint, removed array<struct<start:bigint,end:bigint>>, kept_sha256 string",
        )
        .withColumnRenamed("content", "_content")
    )
    return plain.select("doc_id", "content").join(judged, F.col("content") == F.col("_content")).drop("content", "_content")
