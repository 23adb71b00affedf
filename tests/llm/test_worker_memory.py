"""Python workers outlive their tasks: what they hold afterwards, and how much of a block is Python objects at a time."""

import random
import re
import tracemalloc
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa

from spendframe.llm import byte_bpe, pii
from spendframe.llm.pretokens import splitter

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def some_texts(count, words):
    dice = random.Random(3)
    return [" ".join(f"{dice.choice(['of', 'and', 'Wort', 'été'])} {dice.getrandbits(24):x}" for _ in range(words)) for _ in range(count)]


def largest_worker(spark):
    """MB that the Python worker which holds most holds by itself."""

    def run(batches):
        for batch in batches:
            held = re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(int, held)) / 1024] * batch.num_rows)], ["mb"])

    return max(r.mb for r in spark.range(0, 64, 1, 32).mapInArrow(run, "mb double").collect())


def test_idle_workers_give_memory_back(spark, texts):
    docs = texts(list(enumerate(some_texts(400, 1500))))
    byte_bpe.encode(docs.limit(1), ranks=RANKS, pattern=public_tokenizers.PATTERN).count()
    before = largest_worker(spark)
    coded = byte_bpe.encode(docs, ranks=RANKS, pattern=public_tokenizers.PATTERN)
    byte_bpe.decode(coded, ranks=RANKS).selectExpr("sum(length(decoded))").collect()
    middle = largest_worker(spark)
    pii.mask(docs, pii.char_tagger.Tagger.new(len(pii.KINDS), 8, 7)).selectExpr("sum(length(text))").collect()
    after = largest_worker(spark)
    assert max(middle, after) < before + 25, (before, middle, after)


def test_block_holds_few_strings(monkeypatch):
    class Context:
        get = partitionId = classmethod(lambda cls: cls)

    monkeypatch.setattr(byte_bpe, "TaskContext", Context)
    written = [None, "", *some_texts(300, 700), ""]
    batch, split = pa.RecordBatch.from_pydict({"text": pa.array(written)}), splitter(public_tokenizers.PATTERN)
    split(written[2])
    tracemalloc.start()
    _, counts, places, distinct = byte_bpe._block(batch, split, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    words = [split(t or "") for t in written]
    flat = [w for found in words for w in found]
    assert counts.tolist() == [len(found) for found in words]
    assert distinct.to_pylist() == list(dict.fromkeys(flat))  # in the order in which they first come
    assert distinct.take(pa.array(np.asarray(places, np.int64))).to_pylist() == flat
    assert len(flat) > 1 << 18 and peak < 20 * len(flat)


def test_decode_of_several_slices(spark):
    dice = random.Random(5)
    rows = [(k, None if k % 7 == 0 else [dice.randrange(50_000) for _ in range(0 if k % 5 == 0 else 40_000)]) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id bigint, ids array<int>").coalesce(1)
    by_id = {rank: token for token, rank in byte_bpe.read_ranks(RANKS).items()}
    got = {r.doc_id: r.decoded and bytes(r.decoded) for r in byte_bpe.decode(frame, ranks=RANKS).collect()}
    assert got == {k: None if ids is None else b"".join(by_id[i] for i in ids) or bytearray() for k, ids in rows}
