"""Personal data: exact patterns, and a character tagger that adds what they miss.

The patterns decide for themselves (leftmost, non-overlapping for each kind; a match that fails its
test is dropped).  Their spans in a bounded sample are the labels a BiLSTM-CRF learns from, beside
rewritten ones (an address spelt with "at", a number without its plus sign).  Every whole text is
then read in overlapping windows; each position takes its tag from the window in whose middle it
lies, so a span across a seam is one span.  Added spans must clear a score margin and a plausibility
test of their kind, and never touch a base span.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendframe.llm import char_tagger
from spendframe.llm.base import by_bytes, pick, released, send_package, texts_of

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive, and only from the start of a run of digits: the same matches without going back over long runs
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # start, kind, end


@dataclass(frozen=True)
class Training:
    """``documents``: how many sampled texts (of up to ``longest`` bytes) give labels; the other fields shape the model."""

    documents: int = 300
    longest: int = 8000
    window: int = 96
    hidden: int = 8
    steps: int = 260
    batch: int = 64
    rate: float = 0.03
    seed: int = 7


@dataclass(frozen=True)
class Reading:
    """``window`` characters at a time, ``overlap`` of them shared; ``margin``: least score of an added span over none."""

    window: int = 256
    overlap: int = 64
    lanes: int = 4096
    margin: float = 6.0
    block_bytes: int = 4 << 20


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, found from each @ so that long runs are read once."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = floor + len(text[floor:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        floor = found.end() if found else at + 1
        at = text.find("@", floor)


def luhn(digits: str) -> bool:
    total = 0
    for k, char in enumerate(reversed(digits)):
        value = int(char) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _address(text: str) -> bool:
    parts = [p.lstrip("0") for p in text.split(".")]
    return len(parts) == 4 and all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns alone, by start and then kind."""
    spans: list[Span] = []
    if "@" in text:
        spans += [(a, 0, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if _address(m.group())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := _digits(m.group())) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(spans)


def rewritten(kind: int, value: str, rng: random.Random) -> str:
    """The same datum as people also write it."""
    if kind == 0:
        at, dot = rng.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" @ ", ".")])
        name, _, host = value.partition("@")
        return name + at + host.replace(".", dot)
    if kind == 1:
        return value.replace(".", rng.choice(["[.]", " . "]))
    if kind == 2:
        return rng.choice([".", "/"]).join(re.findall(".{1,4}", _digits(value)))
    return value.split(" ", 1)[1] if " " in value else value[1:]


def plausible(kind: int, value: str) -> bool:
    """What an added span must look like at least."""
    digits = _digits(value)
    if kind == 0:
        return bool(re.search(r"\w\W{0,2}(?:@|\bat\b)\W{0,2}\w", value)) and bool(re.search(r"\w(?:\.|\W{0,2}\bdot\b\W{0,2})\w", value))
    if kind == 1:
        parts = re.findall(r"[0-9]+", value)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    letters = any(c.isalpha() for c in value)
    return not letters and (12 <= len(digits) <= 19 if kind == 2 else 7 <= len(digits) <= 15)


def training_windows(texts: list[str], options: Training) -> tuple[np.ndarray, np.ndarray]:
    """(codes, tags), each (window, N): around labelled spans, around rewritten ones, and at random places."""
    rng, codes, tags = random.Random(options.seed), [], []

    def add(text: str, spans: list[Span], middle: int) -> None:
        start = max(0, middle - rng.randrange(options.window))
        piece, own = text[start : start + options.window], np.zeros(options.window, np.uint8)
        for a, kind, b in spans:
            own[max(0, a - start) : max(0, b - start)] = kind + 1
        coded = np.full(options.window, char_tagger.PAD, np.uint8)
        coded[: len(piece)] = char_tagger.code(piece)
        own[len(piece) :] = 0
        codes.append(coded)
        tags.append(own)

    for text in texts:
        spans = base_spans(text)
        for a, kind, b in spans:
            add(text, spans, (a + b) // 2)
            other = rewritten(kind, text[a:b], rng)
            near = [(s, k, e) for s, k, e in spans if e <= a]
            add(text[:a] + other + text[b:], [*near, (a, kind, a + len(other))], a + len(other) // 2)
        for match in list(re.finditer(r"[0-9]{3,}", text))[:4]:
            add(text, spans, match.start())
        for _ in range(3):
            add(text, spans, rng.randrange(max(1, len(text))))
    return np.array(codes).T, np.array(tags).T


def fit(docs: DataFrame, options: Training = Training()) -> char_tagger.Tagger | None:
    """A tagger learnt from a bounded sample of ``docs`` (column ``text``); None where no span is found.

    The sample is the ``documents`` different texts with the lowest hashes among those with a digit or @
    and at most ``longest`` bytes: the same for any partitioning.  The hashes are chosen first, so that
    tasks send the driver numbers and then only the chosen texts."""
    usable = docs.where((F.octet_length("text") <= options.longest) & F.col("text").rlike("[0-9@]"))
    hashed = usable.select(F.xxhash64("text").alias("at"), "text")
    lowest = hashed.select("at").distinct().orderBy("at").limit(options.documents).agg(F.max("at")).first()[0]
    chosen = hashed.where(F.col("at") <= F.lit(lowest)).groupBy("at").agg(F.first("text").alias("text")) if lowest is not None else None
    sample = sorted(chosen.collect()) if chosen is not None else []
    codes, tags = training_windows([row.text for row in sample], options) if sample else (None, np.zeros(0))
    if not tags.any():
        return None
    model = char_tagger.Tagger.new(len(KINDS), options.hidden, options.seed)
    char_tagger.train(model, codes, tags, steps=options.steps, batch=options.batch, rate=options.rate, seed=options.seed)
    return model


def tag(model: char_tagger.Tagger, texts: list[str], reading: Reading = Reading()) -> list[list[Span]]:
    """Runs of tags of whole texts that clear the margin, by text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    firsts = ends - sizes
    flat = np.concatenate([char_tagger.code(t) for t in texts] + [np.full(1, char_tagger.PAD, np.uint8)])
    stride, half = reading.window - reading.overlap, reading.overlap // 2
    counts = np.maximum(1, -(-(sizes - reading.overlap) // stride))
    owner = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    found, gain = np.zeros(len(flat), np.uint8), np.zeros(len(flat), np.float32)
    steps = np.arange(reading.window)[:, None]
    for low in range(0, len(owner), reading.lanes):
        own, k = owner[low : low + reading.lanes], number[low : low + reading.lanes]
        at = firsts[own] + k * stride + steps
        there = at < ends[own]
        codes = np.where(there, flat[np.minimum(at, len(flat) - 1)], char_tagger.PAD)
        emitted = char_tagger.scores(model, codes)
        tags = char_tagger.decode(model, emitted)
        mine = there & ((steps >= half) | (k == 0)) & ((steps < reading.window - half) | (k == counts[own] - 1))
        t, lane = np.nonzero(mine & (tags > 0))
        kind = tags[t, lane]
        found[at[t, lane]] = kind
        gain[at[t, lane]] = emitted[t, kind, lane] - emitted[t, 0, lane]
    places = np.flatnonzero(found)
    spans: list[list[Span]] = [[] for _ in texts]
    if len(places):
        text_of = np.searchsorted(ends, places, side="right")
        fresh = np.flatnonzero((np.diff(places) != 1) | (np.diff(found[places]) != 0) | (np.diff(text_of) != 0)) + 1
        for run in np.split(np.arange(len(places)), fresh):
            if gain[places[run]].sum() >= reading.margin:
                doc, start = text_of[run[0]], firsts[text_of[run[0]]]
                spans[doc].append((int(places[run[0]] - start), int(found[places[run[0]]]) - 1, int(places[run[-1]] + 1 - start)))
    return spans


def _trim(text: str, span: Span) -> Span:
    start, kind, end = span
    while start < end and text[start] in " \t\n.,;:":
        start += 1
    while end > start and text[end - 1] in " \t\n.,;:":
        end -= 1
    return start, kind, end


def added_spans(text: str, base: list[Span], tagged: list[Span]) -> list[Span]:
    """Tagged spans that are plausible and apart from all base spans."""
    fresh = []
    for span in tagged:
        start, kind, end = _trim(text, span)
        if start < end and plausible(kind, text[start:end]) and all(b <= start or end <= a for a, _, b in base):
            fresh.append((start, kind, end))
    return fresh


SPANS = "array<struct<start:int,kind:string,end:int>>"


def find(
    docs: DataFrame, model: char_tagger.Tagger | None, *, id_col: str = "doc_id", text_col: str = "text", reading: Reading = Reading()
) -> DataFrame:
    """One row per input row: ``doc_id``, ``base`` and ``spans`` (base and added), arrays by start, then kind.

    Places are code points, the end exclusive.  Null and empty texts have none; null ids and repeated
    rows stay as they are; other columns are ignored; an empty table gives no rows.  Without a model
    ``spans`` is ``base``.  No row is shuffled; a text of any length is read in windows.
    """
    plain = pick(docs, doc_id=id_col, text=text_col)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, reading.block_bytes):
            texts = texts_of(batch)
            base = [base_spans(t) for t in texts]
            tagged = tag(model, texts, reading) if model and texts else [[] for _ in texts]
            every = [sorted(b + added_spans(t, b, more)) for t, b, more in zip(texts, base, tagged)]
            columns = [[[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in row] for row in rows] for rows in (base, every)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, kind) for c in columns)], ["doc_id", "base", "spans"])

    return plain.mapInArrow(released(run), f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, base {SPANS}, spans {SPANS}")


def mask(docs: DataFrame, model: char_tagger.Tagger | None, *, text_col: str = "text", reading: Reading = Reading()) -> DataFrame:
    """The same rows and columns, each span of the text replaced by its kind in brackets (overlapping spans together)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, reading.block_bytes):
            at, texts = batch.schema.names.index(text_col), batch.column(text_col).to_pylist()
            plain = [t or "" for t in texts]
            tagged = tag(model, plain, reading) if model and texts else [[] for _ in texts]
            masked = []
            for raw, text, more in zip(texts, plain, tagged):
                base = base_spans(text)
                pieces, done = [], 0
                for start, kind, end in sorted(base + added_spans(text, base, more)):
                    if start >= done:
                        pieces += [text[done:start], f"[{KINDS[kind]}]"]
                    done = max(done, end)
                masked.append(None if raw is None else "".join(pieces) + text[done:])
            columns = [pa.array(masked, batch.schema.types[k]) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    send_package(docs.sparkSession)
    return docs.mapInArrow(released(run), docs.schema)
