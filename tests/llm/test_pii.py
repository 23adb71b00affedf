"""Personal data: the patterns against plain ones, the tagger's gradients and decoder, windows, added spans."""

import itertools
import random
import re

import numpy as np
import pytest

from spendframe.llm import char_tagger, pii
from spendframe.llm.base import table

PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_spans(text):
    spans = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            ok = (
                kind == 0
                or (kind == 1 and all(int(p) <= 255 for p in m.group().split(".")))
                or (kind == 2 and 12 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0)
                or (kind == 3 and 9 <= len(digits) <= 15)
            )
            if ok:
                spans.append((m.start(), kind, m.end()))
    return sorted(spans)


def test_base_equals_the_patterns():
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "@x", ".com", "1", "25", "256", ".", "+", " ", "-", "(", ")", "4111 1111 1111 1111", "10.0.0.1", "é", "_", "%", "\n", "000"]
    for _ in range(5000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), repr(text)


def test_long_runs_are_read_once():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "@" * 200_000, "a@" * 100_000, "+1" + "-" * 400_000, "1 " * 200_000):
        pii.base_spans(text)


def small(kinds=2, hidden=3):
    model = char_tagger.Tagger.new(kinds, hidden, 1)
    for w in model.weights:
        w *= np.float32(0.5)
    rng = np.random.default_rng(2)
    model.moves += rng.normal(0, 0.3, model.moves.shape).astype(np.float32)
    return model, rng


def test_gradients():
    model, rng = small()
    codes, tags = rng.integers(0, char_tagger.CODES, (7, 3)), np.zeros((7, 3), np.int64)
    tags[2:4, 0], tags[5:, 1] = 1, 2
    _, gradients = char_tagger.loss_and_gradients(model, codes, tags)
    for weights, gradient in zip(model.weights, gradients):
        for at in [np.unravel_index(k, weights.shape) for k in np.argsort(-np.abs(gradient).ravel())[:6]]:
            kept, step = weights[at], np.float32(1e-2)
            weights[at] = kept + step
            above, _ = char_tagger.loss_and_gradients(model, codes, tags)
            weights[at] = kept - step
            below, _ = char_tagger.loss_and_gradients(model, codes, tags)
            weights[at] = kept
            assert abs((above - below) / (2 * step) - gradient[at]) < 2e-3


def test_decoder_finds_the_best_path():
    model, rng = small()
    emitted = rng.normal(0, 1, (6, 3, 4)).astype(np.float32)
    moves, tags = model.allowed(), char_tagger.decode(model, emitted)
    for lane in range(4):
        def score(path):
            return sum(emitted[t, k, lane] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path))

        best = max(itertools.product(range(3), repeat=6), key=score)
        assert tuple(tags[:, lane]) == best


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(table(spark, "/root/testdata/sf0.01", "documents"), pii.Training(steps=200))


def test_learns_held_out_and_rewritten_spans(spark, model):
    texts = [r.text for r in table(spark, "/root/testdata/sf0.1", "documents").where("doc_id % 7 = 3 AND length(text) < 9000 AND text rlike '@|[0-9]'").collect()]
    tagged = pii.tag(model, texts)
    found = total = 0
    for text, spans in zip(texts, tagged):
        for a, kind, b in pii.base_spans(text):
            if kind in (0, 1, 3):
                total += 1
                found += any(k == kind and s < b and a < e for s, k, e in spans)
    assert total > 20 and found / total > 0.85
    text = "Please write to ann.lee at mail3 dot example dot com or call (555) 555-0123 on monday."
    added = pii.added_spans(text, [], pii.tag(model, [text], pii.Reading(margin=0))[0])
    assert {k for _, k, _ in added} <= {0, 3}


def test_windows_do_not_matter_for_base_and_seams(spark, texts, model):
    body = "the quiet words of a long text go on and on. " * 400
    rows = [(k, body[: 150 * k] + " ann.34@mail0.example.com " + body) for k in range(1, 12)] + [(90, None), (91, ""), (None, "1.2.3.4"), (1, "x"), (92, body)]
    got = pii.find(texts(rows, base=1, spans="s"), model).collect()
    assert len(got) == len(rows)
    for row in got:
        base = [(s.start, s.kind, s.end) for s in row.base]
        every = [(s.start, s.kind, s.end) for s in row.spans]
        assert set(base) <= set(every) and every == sorted(every, key=lambda s: (s[0], pii.KINDS.index(s[1])))
    assert all(len(r.base) == 1 and len(r.spans) == 1 for r in got if r.doc_id in range(2, 12))
    assert [r.spans for r in got if r.doc_id in (90, 91, 92)] == [[], [], []]
    assert pii.find(texts(rows).limit(0), model).collect() == []


def test_mask_and_no_model(spark, texts):
    assert pii.fit(texts([(1, "no data"), (2, None)])) is None
    masked = pii.mask(texts([(1, "at 10.0.0.1 or a@b.cd now"), (2, None), (3, "")]), None).collect()
    assert [r.text for r in sorted(masked, key=lambda r: r.doc_id)] == ["at [ip] or [email] now", None, ""]
