"""A quality score learnt from trusted positives and unlabelled text (non-negative PU learning).

Each text becomes a dozen shape measures in one pass (words, symbols, capitals, repeats, lines);
labels, language, source and id are not among them.  A logistic score is first fitted on the driver to at
most ``sample`` positives and as many unlabelled rows, chosen by hash.  The class prior is the smallest
ratio of unlabelled to positive mass above a threshold that enough rows support; both masses are
histograms over all training rows that the scorer behind them hasn't learnt from.  Then the
non-negative unbiased risk
    prior E+[l(f)] + max(0, E_u[l(-f)] - prior E+[l(-f)])
is minimised: from the sample's minimum on by Newton steps whose gradient is a sum over all unlabelled
rows, one pass over the measures each.  Only the labelled side rests on the bounded sample.
Scores follow from a last pass over the measures, not the texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.llm.base import cut, pick, texts_of

SYMBOLS = "#*$%&|<>"
MEASURES = ("length", "short", "symbols", "capitals", "shouts", "variety", "neighbours", "windows", "lines", "word_size", "digits", "tables")


@dataclass(frozen=True)
class PuOptions:
    """``folds``: rows whose crc32(id as text) mod folds is 0 are held out and teach nothing.  ``sample`` bounds the
    labelled positives, and the unlabelled rows of the first fit; ``passes`` the steps over all unlabelled rows."""

    sample: int = 20_000
    folds: int = 5
    steps: int = 400
    rate: float = 0.05
    decay: float = 1e-4
    threshold: float = 0.3
    confidence: float = 0.05
    passes: int = 8


def measures(text: str) -> list[float]:
    """Numbers around 0 to 1 that describe a text's shape; an empty text has them too."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0, 1.0] + [0.0] * (len(MEASURES) - 2)
    size = len(text)
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    windows = Counter(zip(words, words[1:], words[2:]))
    again = sum(count for count in windows.values() if count > 1)
    capitals = size - len(text.translate(_NO_CAPITALS))
    return [
        min(1.0, np.log1p(n) / 10),
        max(0.0, 1 - n / 50),
        min(1.0, 10 * sum(map(text.count, SYMBOLS)) / size),
        min(1.0, 3 * capitals / size),
        min(1.0, 2 * text.count("!") / n),
        1 - len(set(words)) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        again / max(1, n - 2),
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, abs(size / n - 6.2) / 4),
        min(1.0, 10 * sum(map(text.count, "0123456789")) / size),
        min(1.0, 5 * text.count(" | ") / n),
    ]


_NO_CAPITALS = {c: None for c in range(0x250) if chr(c).isupper()}


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): one row per input row, computed and kept in the shared folder."""
    plain = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([measures(t) for t in texts_of(batch)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), values], ["doc_id", "x"])

    return cut(plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, x array<double>"))


def held_out(options: PuOptions):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % options.folds == 0, F.lit(False))


def _spread(x: np.ndarray) -> np.ndarray:
    """The measures, their square roots (small shares count), and one."""
    return np.concatenate([x, np.sqrt(x), np.ones((len(x), 1))], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _adam(gradient, size: int, options: PuOptions) -> np.ndarray:
    weights, first, second = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, options.steps + 1):
        g = gradient(weights) + options.decay * weights
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        weights -= options.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return weights


#: Bins of the histograms behind the class prior.
BINS = 2000


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float) -> float:
    """Share of positives among the unlabelled, from counts by score (rising bins) of rows the scorer hasn't learnt from.

    Above any threshold the unlabelled share is at least prior times the positive share; the least
    ratio, with a margin for few rows, is where hardly a negative is left."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    if not n_p or not n_u:
        return 0.5
    above_p, above_u = (np.cumsum(counts[::-1])[::-1] / counts.sum() for counts in (positive, unlabelled))
    at = above_p > 0
    above_p, above_u = above_p[at], above_u[at]
    slack = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(n_p) + 1 / np.sqrt(n_u))
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def first_fit(p: np.ndarray, u: np.ndarray, options: PuOptions) -> np.ndarray:
    """Weights that tell positives from unlabelled rows (both spread)."""
    return _adam(lambda w: (p.T @ (_sigmoid(p @ w) - 1)) / len(p) + (u.T @ _sigmoid(u @ w)) / len(u), p.shape[1], options)


def fit_risk(p: np.ndarray, u: np.ndarray, prior: float, options: PuOptions) -> np.ndarray:
    """Weights of lowest non-negative risk on the given rows (spread)."""

    def risk_gradient(w: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        as_positive = prior * (p.T @ (sp - 1)) / len(p)
        as_negative = (u.T @ su) / len(u) - prior * (p.T @ sp) / len(p)
        value = -np.log(1 - su + 1e-12).mean() + prior * np.log(1 - sp + 1e-12).mean()
        return as_positive + as_negative if value >= 0 else -as_negative

    return _adam(risk_gradient, p.shape[1], options)


def _features() -> list[Column]:
    """The columns that ``_spread`` makes of ``x``."""
    count = len(MEASURES)
    return [F.col("x")[k] for k in range(count)] + [F.sqrt(F.col("x")[k]) for k in range(count)] + [F.lit(1.0)]


def probability(weights: Sequence[float]) -> Column:
    """The logistic score of ``x``."""
    value = sum((float(w) * z for w, z in zip(weights, _features())), F.lit(0.0))
    return 1 / (1 + F.exp(-F.greatest(F.least(value, F.lit(30.0)), F.lit(-30.0))))


def refine(weights: np.ndarray, prior: float, p: np.ndarray, sample: np.ndarray, unlabelled: DataFrame, options: PuOptions) -> np.ndarray:
    """Newton steps on the risk with all unlabelled rows; the curvature is the sample's.

    With logistic loss the positive part of the risk is linear, so where the risk is not clipped it is
    convex.  A step that would lead to a clipped or higher risk ends the search."""
    best = None
    for _ in range(options.passes + 1):
        scored = unlabelled.withColumn("s", probability(weights))
        sums = scored.agg(F.count("*"), F.sum(-F.log(1 - F.col("s") + 1e-12)), *[F.sum(F.col("s") * z) for z in _features()]).first()
        if not sums[0]:
            return weights
        sp = _sigmoid(p @ weights)
        negative = sums[1] / sums[0] + prior * np.log(1 - sp + 1e-12).mean()
        risk = negative - prior * np.log(sp + 1e-12).mean() + options.decay * (weights @ weights) / 2
        if negative < 0 or (best is not None and risk > best[0]):
            return weights if best is None else best[1]
        better = best is None or best[0] - risk > 1e-9
        best = risk, weights
        if not better:
            break
        g = np.array(sums[2:], float) / sums[0] - prior * p.mean(axis=0) + options.decay * weights
        s = _sigmoid(sample @ weights)
        curve = (sample * (s * (1 - s))[:, None]).T @ sample / len(sample) + (options.decay + 1e-6) * np.eye(len(weights))
        weights = weights - np.linalg.solve(curve, g)
    return best[1]


def learn(measured: DataFrame, labels: DataFrame, options: PuOptions = PuOptions()) -> tuple[np.ndarray, float] | None:
    """Weights and prior from rows that are not held out; None without positives.

    ``labels`` has doc_id and quality; null labels teach nothing, of repeated labels the highest counts."""
    known = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("quality"))
    rows = measured.where(~held_out(options) & F.col("doc_id").isNotNull()).join(known, F.col("doc_id") == F.col("_id"), "left")

    # joined with the labels once; every pass reads what it needs of this
    hashed = cut(rows.select("x", "quality", F.xxhash64("doc_id").alias("at")))

    def drawn(part: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, spread measures) of the rows with the lowest hashes; the hashes are chosen first, so that
        tasks send the driver little."""
        highest = part.select("at").distinct().orderBy("at").limit(options.sample).agg(F.max("at")).first()[0]
        if highest is None:
            return np.empty(0, np.int64), _spread(np.empty((0, len(MEASURES))))
        chosen = part.where(F.col("at") <= F.lit(highest)).groupBy("at").agg(F.min("x").alias("x")).collect()
        chosen = sorted((r.at, r.x) for r in chosen)
        return np.array([at for at, _ in chosen]), _spread(np.array([x for _, x in chosen]))

    unlabelled = hashed.where("quality IS NULL")
    (p_at, p), (u_at, u) = drawn(hashed.where("quality = 1")), drawn(unlabelled)
    if not len(p) or not len(u):
        return None
    odd = p_at % 2 == 1, u_at % 2 == 1
    prior = 0.5
    if not odd[0].all() and not odd[1].all():
        half = first_fit(p[~odd[0]], u[~odd[1]], options)
        others = hashed.where((F.pmod("at", F.lit(2)) == 1) & (F.col("quality").isNull() | (F.col("quality") == 1)))
        place = F.floor(probability(half) * BINS).cast("int")
        counts = np.zeros((2, BINS + 1))
        for r in others.groupBy(place.alias("bin"), F.col("quality").isNull().alias("free")).count().collect():
            counts[int(r.free), r.bin] = r["count"]
        prior = class_prior(counts[0], counts[1], options.confidence)
    return refine(fit_risk(p, u, prior, options), prior, p, u, unlabelled, options), prior


def score(docs: DataFrame, labels: DataFrame, options: PuOptions = PuOptions(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``score``, ``predicted``.

    Null and empty texts have a score too.  A null id is not held out, nor does it teach.  Repeated rows
    get equal scores.  Without positives or unlabelled rows every score is 0.5.  Other columns are
    ignored; an empty table gives no rows.
    """
    measured = measure(docs, id_col=id_col, text_col=text_col)
    learnt = learn(measured, labels, options)
    weights = [0.0] * (2 * len(MEASURES) + 1) if learnt is None else learnt[0].tolist()
    return measured.select(
        "doc_id", held_out(options).alias("held_out"), probability(weights).alias("score")
    ).withColumn("predicted", (F.col("score") >= options.threshold).cast("int"))
