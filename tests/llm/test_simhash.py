"""SimHash against a brute-force version: fingerprints, distances, components, skewed buckets."""

import random

import numpy as np
import pytest
import xxhash

from spendframe.llm import bit_planes, simhash
from spendframe.llm.components import components


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    """{id: smallest id reachable}, by trying all pairs."""
    lowest = {doc: doc for doc in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= radius and lowest[a] > lowest[b]:
                    lowest[a], changed = lowest[b], True
    return lowest


def flipped(value, count, rng):
    for bit in rng.sample(range(64), count):
        value ^= 1 << bit
    return value


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 7])
def test_planes_give_distances(radius):
    rng = random.Random(radius)
    left = [rng.getrandbits(64) for _ in range(700)]
    right = [flipped(x, rng.randint(0, 9), rng) for x in left]
    got = bit_planes.near(np.array(left, np.uint64), np.array(right, np.uint64), radius)
    assert got.tolist() == [(a ^ b).bit_count() <= radius for a, b in zip(left, right)]


def test_all_pairs_of_a_bucket():
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    values = [flipped(rng.choice(seeds), rng.randint(0, 3), rng) for _ in range(333)]
    got = set()
    for i, j in bit_planes.near_pairs(np.array(values, np.uint64), 2, queries=50):
        got |= set(zip(i.tolist(), j.tolist()))
    assert got == {(i, j) for i in range(333) for j in range(i + 1, 333) if (values[i] ^ values[j]).bit_count() <= 2}


def test_documents(spark, texts):
    rng = random.Random(1)
    vocabulary = ["Alpha", "bêta", "GAMMA", "ÉCOLE", "delta", "x"]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 300))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t + "\n") for i, t in enumerate(base[:10])]
    rows += [(200 + i, t.replace("x", "y", 1)) for i, t in enumerate(base)]
    rows += [(300, ""), (301, None), (302, " \t\x0b "), (303, "one"), (304, "One two"), (0, base[0])]
    got = simhash.near_duplicates(texts(rows)).collect()
    prints = {doc: plain_fingerprint(text) for doc, text in rows}
    assert len(got) == len(rows)
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == plain_components(prints, 2)
    assert all(len(r.fingerprint) == 16 for r in got)


def test_dealt_buckets_lose_no_link(spark):
    """A bucket far over its limit is compared in chunks; a chain of near classes stays one component."""
    rng = random.Random(3)
    chain = [0xABCD_0000_1234_0000]
    for _ in range(150):
        chain.append(chain[-1] ^ (1 << rng.randrange(16)) ^ (1 << (32 + rng.randrange(16))))
    prints = sorted(set(chain) | {flipped(chain[0], 20, rng) for _ in range(40)})
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "print bigint")
    labels = {r.node: r.label for r in components(simhash.links(frame, bucket=8)).collect()}
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    wanted = plain_components(dict(zip(signed, prints)), 2)
    assert {p: labels.get(p, p) for p in signed} == wanted


def test_nulls_and_empty_tables(spark, texts):
    got = simhash.near_duplicates(texts([(None, "a b c"), (None, None), (7, "a b c")])).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in got if r.component_id) == [(False, 7), (True, 7)]
    assert simhash.near_duplicates(texts([(1, "a")]).limit(0)).collect() == []
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert components(none).collect() == []


def test_components_of_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (None, 3), (41, 40)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(42)}, **{100 + i: 100 for i in range(30)}}
