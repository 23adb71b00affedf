"""PU learning: prior and risk on made data, held-out accuracy on the labelled table, edge cases."""

import zlib

import numpy as np

from spendframe.llm import quality_pu as q
from spendframe.llm.base import table


def test_prior_and_weights_without_negatives():
    rng = np.random.default_rng(1)
    positive = np.clip(rng.normal(0.3, 0.1, (4000, len(q.MEASURES))), 0, 1)
    negative = np.clip(rng.normal(0.7, 0.1, (4000, len(q.MEASURES))), 0, 1)
    for share in (0.3, 0.8):
        n = int(4000 * share)
        unlabelled = np.concatenate([positive[:n][::-1], negative[: 4000 - n]])
        rng.shuffle(unlabelled)
        options = q.PuOptions()
        p, u = q._spread(positive), q._spread(unlabelled)
        half = q.first_fit(p[::2], u[::2], options)
        bins = [np.bincount(np.floor(q._sigmoid(z[1::2] @ half) * q.BINS).astype(int), minlength=q.BINS + 1) for z in (p, u)]
        prior = q.class_prior(*bins, options.confidence)
        weights = q.fit_risk(p, u, prior, options)
        assert abs(prior - share) < 0.08
        assert (q._spread(positive) @ weights > 0).mean() > 0.97 and (q._spread(negative) @ weights < 0).mean() > 0.97


def test_refined_weights_are_the_minimum_over_all_rows(spark):
    """The risk of all unlabelled rows, in NumPy: no moved weight has a lower one; a sample's minimum has a higher."""
    rng = np.random.default_rng(2)
    positive = np.clip(rng.normal(0.35, 0.15, (800, len(q.MEASURES))), 0, 1)
    unlabelled = np.clip(np.concatenate([rng.normal(0.35, 0.15, (900, len(q.MEASURES))), rng.normal(0.6, 0.15, (2100, len(q.MEASURES)))]), 0, 1)
    options, prior = q.PuOptions(decay=1e-2, passes=12), 0.3
    p, u = q._spread(positive), q._spread(unlabelled)

    def risk(w):
        sp, su = q._sigmoid(p @ w), q._sigmoid(u @ w)
        negative = -np.log(1 - su + 1e-12).mean() + prior * np.log(1 - sp + 1e-12).mean()
        return max(0.0, negative) - prior * np.log(sp + 1e-12).mean() + options.decay * w @ w / 2

    start = q.fit_risk(p, u[::10], prior, options)
    frame = spark.createDataFrame([(row.tolist(),) for row in unlabelled], "x array<double>")
    got = q.refine(start, prior, p, u[::10], frame, options)
    assert risk(got) < risk(start)
    assert all(risk(got + rng.normal(scale=s, size=len(got))) > risk(got) - 1e-7 for s in (1e-3, 0.1) for _ in range(200))
    assert (q.refine(start, prior, p, u[::10], frame.limit(0), options) == start).all()


def test_held_out_rows(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    got = {r.doc_id: r for r in q.score(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    truth = [(r.quality, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    good = [r.predicted for y, r in truth if y == 1]
    bad = [r.predicted for y, r in truth if y == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2
    order = np.argsort([r.score for _, r in truth])
    ranks = np.empty(len(order))
    ranks[order] = np.arange(len(order))
    y = np.array([y for y, _ in truth])
    auc = (ranks[y == 1].mean() - ranks[y == 0].mean()) / len(y) + 0.5
    assert auc > 0.95


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.001", n) for n in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS string)) % 5 = 0, 1 - quality, quality) AS quality", "toxic")
    one, two = ({r.doc_id: r.score for r in q.score(docs, x).collect()} for x in (labels, flipped))
    assert one == two


def test_edges(spark, texts):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = [(1, "good words " * 40), (2, None), (3, ""), (None, "x"), (3, ""), (4, "z" * 200_000), (6, " \n ")]
    got = q.score(texts(rows, x=1, score=2), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    assert {r.score for r in q.score(texts(rows), labels.limit(0)).collect()} == {0.5}
    assert q.score(texts(rows).limit(0), labels).collect() == []
