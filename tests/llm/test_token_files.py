"""Token files: Elias-Fano against plain arrays, round trips, and the library's own ids."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spendframe.llm import token_files as t
from spendframe.llm.base import table
from spendframe.llm.elias_fano import EliasFano
from spendframe.llm.queries import op5_token_files

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("values", [[], [0], [7], [3, 3, 3], [0, 1, 2, 3], [-5, 0, 2**40], list(range(0, 10**7, 777)), [5] * 700 + [2**33] * 700])
def test_elias_fano(values):
    coded, size = EliasFano.from_bytes(memoryview(EliasFano.of(np.array(values, np.int64)).to_bytes() + b"rest"))
    assert coded.all().tolist() == values
    assert all(coded.select(i) == values[i] for i in range(0, len(values), 17))
    for first, last in ((0, len(values)), (0, 1), (3, 300), (255, 257), (256, 512), (700, 1400), (5, 5), (-2, 2)):
        assert coded.select_range(first, min(last, len(values))).tolist() == values[max(first, 0) : max(min(last, len(values)), 0)]
    if len(values) > 1000:
        assert size < 4 * len(values)  # 64-bit offsets would take 8 bytes each


def test_file_reads_single_documents():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 70_000, rng.integers(0, 400)).astype(np.uint32) for _ in range(900)]
    names = [None, None, *sorted(rng.integers(0, 10**12, 898).tolist())]
    file = t.TokenFile(t.to_bytes(names, docs))
    for k in (0, 1, 2, 255, 256, 257, 899):
        assert file.doc_id(k) == names[k] and file.ids(k).tolist() == docs[k].tolist()


def test_encoder_equals_the_library():
    library, rng = Tokenizer.from_file(VOCABULARY), random.Random(4)
    encode = t.encoder(VOCABULARY)
    pool = ["It's", "ÉCOLE", "Σίσυφος", "ΟΔΟΣ", "İx", "½", "²", "一二", "a\x1cb", "é", "😀", "<|endoftext|>", "12a", "_x_", "\xa0", "ﬁ", "'S", "ß", "\n"]
    for _ in range(400):
        text = rng.choice(["", " ", "\n"]).join(rng.choices(pool, k=rng.randint(0, 12)))
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def _expected(rows):
    library, start, want = Tokenizer.from_file(VOCABULARY), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((str(doc), start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(want)


@pytest.mark.parametrize("file_ids", [1, 50, 1 << 20])
def test_written_and_read(spark, texts, tmp_path, file_ids):
    rows = [(5, "five words stand right here"), (1, None), (None, "no id"), (3, ""), (9, "long " * 5000), (5, "again"), (5, "again"), (-2, "É")]
    folder = f"file://{tmp_path}/tokens"
    manifest = t.write(texts(rows, name="x", start=1), folder, vocabulary=VOCABULARY, file_ids=file_ids)
    got = t.read(spark, folder, manifest).collect()
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got) == _expected(rows)
    again = t.write(texts(rows[:0]), f"file://{tmp_path}/none", vocabulary=VOCABULARY)
    assert t.read(spark, f"file://{tmp_path}/none", again).collect() == []


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = op5_token_files(spark, sf_dir).collect()
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got) == _expected(rows)
