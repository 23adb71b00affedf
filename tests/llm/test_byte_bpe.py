"""Byte-level BPE against tiktoken, on odd texts and whole tables."""

import random

import public_tokenizers
import pytest
import regex
import tiktoken

from spendframe.llm import byte_bpe
from spendframe.llm.base import table
from spendframe.llm.pretokens import splitter
from spendframe.llm.queries import op1_byte_bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    "", None, " ", "\n\n \t x", "it's we'LL 'tis ''s", "½ ² Ⅷ ٣ 一二", "a\x1cb\x1d\x85\xa0c", "éte ಠಾ", "😀👩‍👩‍👧 <|endoftext|>",
    "x" * 30_000, "  lead", "trail  ", "A_b __ c", "ﬁ ǅ ß İ", " 　z", "!!! ?? 12 345a6", "\0\x7f",
]


@pytest.fixture(scope="module")
def encoder():
    ranks = byte_bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_split_equals_the_pattern():
    rng, split = random.Random(1), splitter(public_tokenizers.PATTERN)
    pool = "abÉß1² \n\t'sࡀ٣_-😀\xa0\x1ćⅧĀ一"
    for _ in range(3000):
        text = "".join(rng.choices(pool, k=rng.randint(0, 30)))
        assert split(text) == regex.findall(public_tokenizers.PATTERN, text)
    every = "".join(chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000)
    assert splitter(public_tokenizers.PATTERN)(every) == regex.findall(public_tokenizers.PATTERN, every)


@pytest.mark.parametrize("block_bytes", [1, 200, 1 << 20])
def test_odd_texts(texts, encoder, block_bytes):
    rows = list(enumerate(ODD)) + [(None, "null id"), (3, ODD[3])]
    coded = byte_bpe.encode(texts(rows, ids=1, block=2), ranks=RANKS, pattern=public_tokenizers.PATTERN, block_bytes=block_bytes)
    got = byte_bpe.decode(coded, ranks=RANKS).collect()
    want = sorted((str(doc), encoder.encode_ordinary(text or ""), (text or "").encode()) for doc, text in rows)
    assert sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in got) == want


def test_empty_table(texts):
    coded = byte_bpe.encode(texts([(1, "a")]).limit(0), ranks=RANKS, pattern=public_tokenizers.PATTERN)
    assert byte_bpe.decode(coded, ranks=RANKS).collect() == []


def test_decode_nulls(spark):
    frame = spark.createDataFrame([(1, [0, 1]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    got = {r.doc_id: r.decoded for r in byte_bpe.decode(frame, ranks=RANKS).collect()}
    assert got[2] is None and bytes(got[3]) == b"" and len(got[1]) == 2


def test_query(spark, sf_dir, encoder):
    import hashlib

    want = {}
    for row in table(spark, sf_dir, "documents").collect():
        ids = encoder.encode_ordinary(row.text or "")
        want[row.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((row.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op1_byte_bpe(spark, sf_dir).collect()}
    assert got == want
