"""Tree ensembles that forecast each step directly: the step is a feature, so no forecast feeds another.

A design row holds the last values before an origin, divided by the series' mean size, and a step; its
label is the value that many steps on.  All series share one model.  Each origin takes the steps that
leave its remainder modulo ``stride``, so every step is learnt at some origins and rows stay a few times
the values.  Rows come from the series' arrays within their partition: no join, no shuffle.

``lag_forest`` is an MLlib forest; its one ``transform`` covers every series and step.  ``lag_gbt`` is boosting
of the second order: each level of a tree is one pass in which tasks add gradients and Hessians up by
(node, feature, bin) and an aggregate merges them on the map side.  Sums are whole numbers, so neither
the order of rows nor the width of a shuffle changes a tree.  The driver sees histograms and trees
only, whose size the settings bound.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 42
#: Parts of the training rows: the forest's bootstrap draws by part, so the count must not follow the cluster.
TRAINING_PARTS = 32
#: Steps that an origin teaches, about.
STEPS_EACH = 12
#: Bins of a feature: values in eighths of the series' mean size, steps in equal parts of the horizon.
BINS, PER_LEVEL = 64, 8
#: Gradients are whole multiples of 2^-UNIT.
UNIT = 20
PREDICTED = "_predicted"


def level_of(values: Column) -> Column:
    """The mean size of a series; 1 where that is zero."""
    size = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.abs(v)) / F.size(values)
    return F.when(size > 0, size).otherwise(1.0)


def _scaled(values: Column, end: Column, lags: int, level: Column) -> Column:
    """The last ``lags`` of the first ``end`` values, newest first, in units of the level."""
    return F.transform(F.reverse(F.slice(values, end - lags + 1, lags)), lambda v: v / level)


def design_rows(
    table: DataFrame, *, series_cols: Sequence[str] = (), values: str, steps: str, lags: int = 12, stride: int | None = None
) -> DataFrame:
    """Series, ``origin`` (values known), ``step``, ``features`` (lags, then the step's part of the horizon) and ``label``.

    ``table`` has a row per series with its values, oldest first, as an array, and its horizon.  ``stride``
    None: about STEPS_EACH steps an origin.  Series of ``lags`` values or fewer have no rows."""
    v, n, level = F.col(values), F.size(values), F.col("_level")
    every = F.lit(stride) if stride else F.ceil(F.col(steps) / STEPS_EACH).cast("int")

    def at(origin: Column) -> Column:
        able = F.sequence(F.lit(1), F.least(F.col(steps), n - origin))
        chosen = F.filter(able, lambda h: F.pmod(h, every) == F.pmod(origin, every))
        recent = _scaled(v, origin, lags, level)

        def row(h: Column) -> Column:
            features = F.concat(recent, F.array(h / F.col(steps)))
            return F.struct(origin.alias("origin"), h.alias("step"), features.alias("features"), (F.get(v, origin + h - 1) / level).alias("label"))

        return F.transform(chosen, row)

    long = table.where(n > lags).withColumn("_level", level_of(v))
    return long.select(*series_cols, F.inline(F.flatten(F.transform(F.sequence(F.lit(lags), n - 1), at))))


# -- forest -----------------------------------------------------------------------------------


def train_forest(rows: DataFrame, keys: Sequence[str], *, trees: int, depth: int):
    """An MLlib forest; rows are dealt by a hash into a fixed number of parts and sorted, whatever the shuffle width."""
    dealt = rows.repartition(TRAINING_PARTS, F.xxhash64(*keys, "origin", "step")).sortWithinPartitions(*keys, "origin", "step", "label")
    frame = dealt.select(array_to_vector(F.col("features")).alias("features"), "label")
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=SEED, predictionCol=PREDICTED).fit(frame)


def forest_forecasts(model, table: DataFrame, *, series_cols: Sequence[str], values: str, steps: str, lags: int) -> DataFrame:
    """Series and ``_forecast``, an array by step, from one ``transform`` of all series and steps."""
    v = F.col(values)
    long = table.where(F.size(v) >= lags).select(
        *series_cols, steps, level_of(v).alias("_level"), _scaled(v, F.size(v), lags, level_of(v)).alias("_recent"), F.explode(F.sequence(F.lit(1), F.col(steps))).alias("step")
    )
    asked = long.withColumn("features", array_to_vector(F.concat("_recent", F.array(F.col("step") / F.col(steps)))))
    scored = model.transform(asked).select(*series_cols, F.struct("step", (F.col(PREDICTED) * F.col("_level")).alias("v")).alias("_one"))
    return scored.groupBy(*series_cols).agg(F.transform(F.sort_array(F.collect_list("_one")), lambda r: r["v"]).alias("_forecast"))


# -- boosting ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Boosting:
    trees: int = 20
    depth: int = 3
    rate: float = 0.3
    ridge: float = 1.0  # added to a node's Hessian
    gain: float = 0.0  # what a split must gain


@dataclass
class Tree:
    """Nodes by number, the root 0 and children 2k + 1 and 2k + 2: ``feature`` -1 is a leaf; a bin up to ``split`` goes left."""

    feature: np.ndarray
    split: np.ndarray
    weight: np.ndarray

    def nodes(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row of bins reaches after ``depth`` levels at most."""
        at = np.zeros(len(bins), int)
        for _ in range(depth):
            inner = self.feature[at] >= 0
            right = bins[np.arange(len(bins)), np.maximum(self.feature[at], 0)] > self.split[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at


def bins_of(features: np.ndarray) -> np.ndarray:
    """Bin numbers (rows, features); the last feature is the step's part of the horizon, over 0 up to 1."""
    out = np.floor(features * PER_LEVEL)
    out[:, -1] = np.ceil(features[:, -1] * BINS) - 1
    return np.clip(out, 0, BINS - 1).astype(np.int64)


def predict(bins: np.ndarray, base: float, trees: Sequence[Tree], settings: Boosting) -> np.ndarray:
    total = np.full(len(bins), base)
    for tree in trees:
        total += settings.rate * tree.weight[tree.nodes(bins, settings.depth)]
    return total


def histograms(rows: DataFrame, base: float, trees: Sequence[Tree], growing: Tree, level: int, settings: Boosting) -> DataFrame:
    """(node, feature, bin, g, h) of the nodes on one level: sums of gradients, in units of 2^-UNIT, and of Hessians.

    The loss is half the squared error, so a row's gradient is prediction less label and its Hessian one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = h = None
        first = 2**level - 1
        for batch in batches:
            if not batch.num_rows:
                continue
            features = np.asarray(batch.column("features").flatten()).reshape(batch.num_rows, -1)
            bins = bins_of(features)
            gradient = np.rint((predict(bins, base, trees, settings) - batch.column("label").to_numpy()) * 2.0**UNIT).astype(np.int64)
            node = growing.nodes(bins, level) - first  # rows in a leaf of an upper level fall below zero
            if g is None:
                g, h = np.zeros((2, 2**level, bins.shape[1], BINS), np.int64)
            keep = node >= 0
            for f in range(bins.shape[1]):
                np.add.at(g[:, f], (node[keep], bins[keep, f]), gradient[keep])
                np.add.at(h[:, f], (node[keep], bins[keep, f]), 1)
        if g is not None:
            node, feature, at = np.nonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (node + first, feature, at, g[node, feature, at], h[node, feature, at])], ["node", "feature", "bin", "g", "h"])

    parts = rows.select("features", "label").mapInArrow(run, "node bigint, feature bigint, bin bigint, g bigint, h bigint")
    return parts.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def best_splits(found: pd.DataFrame, settings: Boosting) -> dict[int, tuple[int, int, float, float, float, float]]:
    """{node: (feature, split, gain, weight of the node, of the left child, of the right)}; feature -1: no split gains."""
    out = {}
    for node, own in found.groupby("node"):
        g, h = np.zeros((2, int(own["feature"].max()) + 1, BINS))
        g[own["feature"], own["bin"]], h[own["feature"], own["bin"]] = own["g"] / 2.0**UNIT, own["h"]
        total_g, total_h = g[0].sum(), h[0].sum()
        left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
        right_g, right_h = total_g - left_g, total_h - left_h
        gains = 0.5 * (left_g**2 / (left_h + settings.ridge) + right_g**2 / (right_h + settings.ridge) - total_g**2 / (total_h + settings.ridge))
        gains = np.where((left_h > 0) & (right_h > 0), gains, -np.inf)
        f, s = np.unravel_index(int(np.argmax(np.round(gains, 9))), gains.shape)  # of equal gains the first feature and bin
        weight = -total_g / (total_h + settings.ridge)
        if gains[f, s] <= settings.gain:
            out[int(node)] = -1, 0, 0.0, weight, 0.0, 0.0
        else:
            out[int(node)] = int(f), int(s), float(gains[f, s]), weight, -left_g[f, s] / (left_h[f, s] + settings.ridge), -right_g[f, s] / (right_h[f, s] + settings.ridge)
    return out


def train_boosting(rows: DataFrame, settings: Boosting = Boosting()) -> tuple[float, list[Tree]] | None:
    """(base, trees); None without rows.  One job a level; ``rows`` should be read from files (see ``settle``)."""
    whole = F.round(F.col("label") * 2.0**UNIT).cast("decimal(38,0)")
    count, total = rows.agg(F.count("*"), F.sum(whole)).first()
    if not count:
        return None
    base = float(total) / 2.0**UNIT / count
    trees: list[Tree] = []
    for _ in range(settings.trees):
        size = 2 ** (settings.depth + 1) - 1
        tree = Tree(np.full(size, -1), np.zeros(size, int), np.zeros(size))
        for level in range(settings.depth):
            found = histograms(rows, base, trees, tree, level, settings).toPandas()
            for node, (feature, split, _, weight, left, right) in best_splits(found, settings).items():
                tree.weight[node] = weight
                if feature >= 0:
                    tree.feature[node], tree.split[node] = feature, split
                    tree.weight[2 * node + 1], tree.weight[2 * node + 2] = left, right
            first = 2**level - 1
            if (tree.feature[first : 2 * first + 1] < 0).all():
                break
        trees.append(tree)
    return base, trees


def boosting_column(model: tuple[float, list[Tree]] | None, values: Column, steps: Column, lags: int, settings: Boosting) -> Column:
    """Forecast arrays; null for a series of fewer values than lags."""

    def run(column: pd.Series, horizon: pd.Series) -> pd.Series:
        out: list = [None] * len(column)
        for k, (v, count) in enumerate(zip(column, horizon)):
            v = np.asarray(v, dtype=float)
            if model is None or len(v) < lags or not np.isfinite(v).all():
                continue
            level = float(np.abs(v).mean()) or 1.0
            features = np.empty((int(count), lags + 1))
            features[:, :-1] = v[-lags:][::-1] / level
            features[:, -1] = np.arange(1, int(count) + 1) / int(count)
            out[k] = predict(bins_of(features), *model, settings) * level
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<double>")(values, steps)
