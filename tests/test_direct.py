"""Tree models that forecast every step directly: design rows, one transform, second-order boosting."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from spendframe.operators.forecast import direct as d

SERIES = [("a", [float(v) for v in range(1, 31)], 6), (None, [float((k * 7) % 13) for k in range(40)], 6), ("short", [1.0] * 5, 6), ("zero", [0.0] * 20, 6)]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(SERIES, "name string, v array<double>, steps int")


def by_hand(lags=4, stride=2):
    rows = []
    for name, v, steps in SERIES:
        level = np.abs(v).mean() or 1.0
        for origin in range(lags, len(v)):
            for h in range(1, min(steps, len(v) - origin) + 1):
                if h % stride == origin % stride:
                    rows.append((str(name), origin, h, [x / level for x in v[origin - lags : origin][::-1]] + [h / steps], v[origin + h - 1] / level))
    return sorted(rows)


def test_design_rows(table):
    got = sorted((str(r.name), r.origin, r.step, list(r.features), r.label) for r in d.design_rows(table, series_cols=["name"], values="v", steps="steps", lags=4, stride=2).collect())
    want = by_hand()
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(g[3] == pytest.approx(w[3]) and g[4] == pytest.approx(w[4]) for g, w in zip(got, want))
    whole = d.design_rows(table, series_cols=["name"], values="v", steps="steps", lags=4)
    assert {r.step for r in whole.select("step").distinct().collect()} == set(range(1, 7))
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()


def test_forest_forecasts_are_those_of_one_transform(table):
    rows = d.design_rows(table, series_cols=["name"], values="v", steps="steps", lags=4)
    model = d.train_forest(rows, ["name"], trees=3, depth=4)
    got = {r.name: list(r._forecast) for r in d.forest_forecasts(model, table, series_cols=["name"], values="v", steps="steps", lags=4).collect()}
    assert set(got) == {"a", None, "short", "zero"} and all(len(v) == 6 for v in got.values())
    for name, v, steps in SERIES:
        level = float(np.abs(v).mean()) or 1.0
        asked = table.sparkSession.createDataFrame([(h, [x / level for x in v[-4:][::-1]] + [h / steps]) for h in range(1, steps + 1)], "h int, f array<double>")
        want = model.transform(asked.select("h", array_to_vector("f").alias("features"))).orderBy("h").collect()
        assert got[name] == pytest.approx([r[d.PREDICTED] * level for r in want])


def plain_tree(x, g, settings, depth=0):
    """A tree grown by trying every split of every node."""
    weight = -g.sum() / (len(g) + settings.ridge)
    best = (settings.gain, None)
    if depth < settings.depth:
        for f in range(x.shape[1]):
            for s in range(d.BINS - 1):
                left = x[:, f] <= s
                if 0 < left.sum() < len(g):
                    parts = [g[left].sum() ** 2 / (left.sum() + settings.ridge), g[~left].sum() ** 2 / ((~left).sum() + settings.ridge), -g.sum() ** 2 / (len(g) + settings.ridge)]
                    gain = round(0.5 * sum(parts), 9)
                    if gain > best[0]:
                        best = (gain, (f, s))
    if best[1] is None:
        return lambda row: weight
    f, s = best[1]
    left = x[:, f] <= s
    down, up = plain_tree(x[left], g[left], settings, depth + 1), plain_tree(x[~left], g[~left], settings, depth + 1)
    return lambda row: down(row) if row[f] <= s else up(row)


def test_boosting_equals_trees_grown_by_hand(spark, table):
    settings = d.Boosting(trees=3, depth=2, rate=0.5)
    rows = d.design_rows(table, series_cols=["name"], values="v", steps="steps", lags=4)
    base, trees = d.train_boosting(rows, settings)
    held = rows.collect()
    x, y = d.bins_of(np.array([r.features for r in held])), np.array([r.label for r in held])
    said = np.full(len(y), y.mean())
    for _ in range(3):
        tree = plain_tree(x, said - y, settings)
        said = said + 0.5 * np.array([tree(row) for row in x])
    assert d.predict(x, base, trees, settings) == pytest.approx(said, abs=1e-4)


def test_boosting_learns_and_does_not_follow_the_layout(spark, table):
    settings = d.Boosting(trees=12, depth=3)
    rows = d.design_rows(table, series_cols=["name"], values="v", steps="steps", lags=4)
    models = [d.train_boosting(rows.repartition(parts), settings) for parts in (1, 7)]
    for one, other in zip(models[0][1], models[1][1]):
        assert (one.feature == other.feature).all() and (one.split == other.split).all() and (one.weight == other.weight).all()
    held = rows.collect()
    x, y = d.bins_of(np.array([r.features for r in held])), np.array([r.label for r in held])
    assert np.mean((d.predict(x, *models[0], settings) - y) ** 2) < 0.35 * np.var(y)
    column = table.select("name", d.boosting_column(models[0], F.col("v"), F.col("steps"), 4, settings).alias("x")).collect()
    assert {r.name: r.x is None for r in column} == {"a": False, None: False, "short": False, "zero": False}
    assert d.train_boosting(rows.limit(0), settings) is None
    assert table.select(d.boosting_column(None, F.col("v"), F.col("steps"), 4, settings).alias("x")).where("x IS NOT NULL").count() == 0


def test_ties_and_pure_nodes():
    settings = d.Boosting()
    frame = pd.DataFrame({"node": [0] * 4, "feature": [0, 0, 1, 1], "bin": [1, 5, 1, 5], "g": [-(1 << 20), 1 << 20] * 2, "h": [1, 1, 1, 1]})
    feature, split, gain, weight, left, right = d.best_splits(frame, settings)[0]
    assert (feature, split, weight) == (0, 1, 0.0) and gain == pytest.approx(0.5) and (left, right) == (0.5, -0.5)
    assert d.best_splits(frame[frame["bin"] == 1], settings)[0][0] == -1
    assert d.bins_of(np.array([[-3.0, 1e9, 1.0], [0.1249, 0.125, 1 / 64]])).tolist() == [[0, 63, 63], [0, 1, 0]]
