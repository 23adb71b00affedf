"""Merkle manifests against lists of digests built level by level in plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from spendframe.llm import merkle
from spendframe.llm.base import cut


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves: list[str], arity: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and each leaf's siblings (left, right) from the bottom up."""
    ways: list[list[tuple[str, str]]] = [[] for _ in leaves]
    owners = [[k] for k in range(len(leaves))]
    while len(leaves) > 1:
        next_leaves, next_owners = [], []
        for at in range(0, len(leaves), arity):
            run = leaves[at : at + arity]
            for k in range(len(run)):
                for owner in owners[at + k]:
                    ways[owner].append(("".join(run[:k]), "".join(run[k + 1 :])))
            next_leaves.append(sha("".join(run)))
            next_owners.append([o for own in owners[at : at + arity] for o in own])
        leaves, owners = next_leaves, next_owners
    return leaves[0], ways


def brute(rows, arity):
    """(doc_id, leaf, subroot, root, siblings) of (doc_id, source, lang, n_chars, text) rows."""
    groups: dict = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0], leaf(*row)))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    lower = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        lower[lang] = tree([own for _, own in groups[lang]], arity)
    root, above = tree([lower[lang][0] for lang in langs], arity)
    return sorted(
        (str(doc), own, lower[lang][0], root, "".join(a + b for a, b in way + above[k]))
        for k, lang in enumerate(langs)
        for (doc, own), way in zip(groups[lang], lower[lang][1])
    )


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree int, idx string, digest string, n int, of string, path int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "i", "d", 2, "o", 3) for r in rows], SCHEMA)


def got(found):
    rows = found.withColumn("siblings", merkle.siblings(F.col("path"))).collect()
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.siblings) for r in rows)


ODD = [
    (None, "s", None, None, None),
    (None, "s", "en", 3, "abc"),
    (5, None, "en", 0, ""),
    (5, None, "en", 0, ""),
    (5, "other", "en", 1, "é\U0001f600"),
    (2, "s", "en", 1, "x" * 100_000),
    (9, "s", "", 1, "blank name"),
    (7, "s", "é", 1, "accent"),
    (8, "s", "z", 1, "lone"),
]


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_equals_lists(spark, arity):
    rows = ODD + [(100 - k, f"s{k % 3}", ("en", "de", None)[k % 3 if k % 7 else 0], k, f"text {k}") for k in range(40)]
    found = cut(merkle.manifest(frame(spark, rows), arity=arity))
    assert got(found) == brute(rows, arity)
    assert found.where(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0


def test_the_layout_of_the_input_does_not_matter(spark):
    rows = ODD + [(k, "s", "en", k, f"text {k}") for k in range(30)]
    docs = frame(spark, rows)
    assert got(merkle.manifest(docs.repartition(7))) == got(merkle.manifest(docs.coalesce(1).orderBy(F.desc("doc_id")))) == brute(rows, 2)


def test_one_row_and_none(spark):
    one = merkle.manifest(frame(spark, [(1, "s", "en", 2, "ab")])).collect()[0]
    assert one.path == [] and one.leaf == one.subroot == one.root == leaf(1, "s", "en", 2, "ab")
    assert merkle.manifest(frame(spark, ODD).limit(0)).collect() == []
    with pytest.raises(ValueError):
        merkle.levels(frame(spark, ODD), 1)


def test_a_changed_row_is_found(spark):
    docs = frame(spark, ODD[3:])
    claim = merkle.leaf(*[F.col(c) for c in ("doc_id", "source", "lang")], F.col("n_chars") + F.when(F.col("doc_id") == 2, 1).otherwise(0), F.col("text"))
    rows = merkle.manifest(docs, extra={"claim": claim}).collect()
    found = merkle.manifest(docs, extra={"claim": claim}).withColumn("ok", merkle.fold(F.col("claim"), F.col("path")) == F.col("root"))
    assert {r.doc_id for r in found.where("NOT ok").collect()} == {2} and len(rows) == len(ODD[3:])


def test_levels_shrink_and_keep_no_group_in_one_task(spark):
    leaves = cut(spark.range(1000).select(F.lit("t").alias("tree"), F.col("id").alias("idx"), F.lit(1000).cast("long").alias("n"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest")))
    tables = merkle.levels(leaves)
    assert [t.count() for t in tables] == [1000, 500, 250, 125, 63, 32, 16, 8, 4, 2, 1]
    assert merkle.roots(tables).first().digest.hex() == tree([sha(str(k)) for k in range(1000)], 2)[0]
