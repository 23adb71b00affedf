"""Edit matching against the plain distance table, and planted passages."""

import random

import pytest

from spendframe.llm import decontaminate as d


def plain_best(item, text):
    """Smallest distance of ``item`` to any substring, by the full table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for char in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i - 1] + (x != char), row[i] + 1, new[-1] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_distance_equals_the_table():
    rng = random.Random(2)
    for _ in range(200):
        item = "".join(rng.choices("abc ", k=rng.randint(1, 90)))
        text = "".join(rng.choices("abc ", k=rng.randint(0, 150)))
        if rng.random() < 0.7:
            text += "".join(c for c in item if rng.random() > 0.05) + "zz"
        want = plain_best(item, text)
        got = d.occurrence(item, text, want)
        assert got[0] == want and plain_best(item, text[got[1] : got[2]]) == want
        assert want == 0 or d.occurrence(item, text, want - 1) is None


@pytest.mark.parametrize("edits", [0, 1, 3, 5])
def test_pieces_lose_no_occurrence(edits):
    rng = random.Random(edits)
    items = ["".join(rng.choices("abcdefgh ", k=100)).strip().replace("  ", " x") for _ in range(20)]
    matcher = d.Matcher([d.normal(i) for i in items], 0.05)
    for number, item in enumerate(matcher.items):
        changed = list(item)
        for _ in range(min(edits, int(0.05 * len(item)))):
            at = rng.randrange(len(changed))
            changed[at] = rng.choice(["", "q", changed[at] + "q"])
        text = d.normal("before this " + "".join(changed) + " and after")
        best = plain_best(item, text)
        assert (number in matcher.find(text)) == (best <= int(0.05 * len(item)))
        if best <= int(0.05 * len(item)):
            assert matcher.find(text)[number][0] == best


def test_documents(spark, texts):
    item = "The quick brown fox jumps over the lazy dog while the other animals watch from a distance, silently."
    other = "Completely different words stand in this second item, so that nothing else in the table resembles it."
    bench = spark.createDataFrame([(1, item), (2, other), (3, None), (4, "  "), (5, item)], "item_id bigint, text string")
    rows = [
        (10, "intro\n" + item.upper().replace(" ", "  ") + "\nend"),
        (11, item.replace("quick", "quack").replace("lazy", "lazi")),
        (12, item[:60]),
        (13, None),
        (14, ""),
        (15, "x " * 50_000 + other),
        (None, item),
        (11, item.replace("quick", "quack").replace("lazy", "lazi")),
    ]
    got = d.leaks(texts(rows, item_id=9, start=1), bench)
    found = sorted((r.doc_id or -1, r.item_id, r.distance) for r in got.collect())
    assert found == [(-1, 1, 0), (-1, 5, 0), (10, 1, 0), (10, 5, 0), (11, 1, 2), (11, 1, 2), (11, 5, 2), (11, 5, 2), (15, 2, 0)]
    span = next(r for r in got.collect() if r.doc_id == 10)
    assert rows[0][1][span.start : span.end] == item.upper().replace(" ", "  ")
    sliced = d.leaks(texts(rows), bench, slice_bytes=50)
    assert sorted(map(str, sliced.collect())) == sorted(map(str, got.collect()))
    assert d.leaks(texts(rows), bench.limit(0)).count() == 0
    assert d.leaks(texts(rows).limit(0), bench).count() == 0
