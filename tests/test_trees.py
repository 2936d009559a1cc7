"""Trees of a forest that tasks grow whole: the same trees as Spark ML's, in its format, with few jobs."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from wavecut.operators import learn as M
from wavecut.operators import trees as T

ALL = {"bootstrap": False, "featureSubsetStrategy": "all"}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.normal(0, 1, 160), rng.integers(0, 5, 160), np.full(160, 2.0), rng.gamma(1.0, 3.0, 160)])
    y = 3 * x[:, 0] + x[:, 1] ** 2 - x[:, 3] + rng.normal(0, 0.3, 160)
    rows = [(i, Vectors.dense(v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame([*rows, rows[3], rows[3]], ["seg", "features", "label"])


def test_parts_are_not_fitted_level_by_level(spark, table, scratch, monkeypatch):
    """Spark ML's own fit, with jobs for every level, sees at most a row."""
    fit, seen = RandomForestRegressor.fit, []
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, df, *a: (seen.append(df.count()), fit(self, df, *a))[1])
    monkeypatch.setattr(M, "DRIVER_NODES", 500)
    model, held = M.fit_holdout(table, M.forest(trees=5, depth=20), 120, f"{scratch}/parts")
    assert sum(model.trees) == 5 and len(model.trees) > 2 and max(seen) <= 1
    label = table.where("seg < 120").agg(F.min("label").alias("low"), F.max("label").alias("high")).first()
    assert held.count() == 40 and held.where((F.col("prediction") < label.low) | (F.col("prediction") > label.high)).count() == 0
    trees = [t for p in model.paths for t in M.load_model(spark, p).trees]
    assert len(trees) == 5 and len({t.toDebugString.split("\n", 1)[1] for t in trees}) == 5 and max(t.depth for t in trees) > 8


@pytest.mark.parametrize("depth, params", [
    (30, {}), (3, {}), (30, {"minInstancesPerNode": 4}), (30, {"minInfoGain": 0.5}), (30, {"minWeightFractionPerNode": 0.1}),
])
def test_same_trees_as_spark_ml(spark, table, scratch, monkeypatch, depth, params):
    """Without anything drawn, every tree parts the training rows as the one that Spark ML fits (two features may part a node alike)."""
    monkeypatch.setattr(M, "DRIVER_NODES", 16)
    monkeypatch.setattr(M, "SCORED_NODES", depth)  # parts one by one, or together where trees are small
    estimator = M.forest(trees=2, depth=depth, bins=16, **ALL, **params)
    model, held = M.fit_holdout(table, estimator, 120, f"{scratch}/parts")
    want = estimator.copy({estimator.numTrees: 1}).fit(table.where("seg < 120"))
    for path in model.paths:
        got = M.load_model(spark, path)
        assert got.trees[0].numNodes == want.trees[0].numNodes and got.trees[0].depth == want.trees[0].depth
        assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray(), atol=1e-3)
        assert all(got.getOrDefault(k) == v for k, v in {**ALL, **params, "maxDepth": depth, "maxBins": 16}.items())
    train = table.where("seg < 120")
    expected = {r.seg: r.prediction for r in want.transform(train).collect()}
    assert all(abs(r.prediction - expected[r.seg]) < 1e-9 for r in model.transform(train).collect()) and len(expected) == 120
    assert held.count() == 40


def test_rows_and_features_are_drawn():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 8, (6, 400)).astype(np.uint8)
    data = T.Binned(x, rng.normal(5, 1, 400), [np.arange(7) + 0.5] * 6)
    rules = T.Rules(30, 1, 0.0, 0.0, True, 1.0, 2)
    nodes = [T.grow(data, rules, np.random.default_rng([1, t])) for t in range(30)]
    sizes = [n["count"][0] for n in nodes]
    assert 385 < np.mean(sizes) < 415 and len(set(sizes)) > 5
    assert {int(n["feature"][0]) for n in nodes} == set(range(6))
    for n in nodes:
        inner, leaf = n["feature"] >= 0, n["feature"] < 0
        assert n["count"][leaf].sum() == n["count"][0] and abs(n["sum"][leaf].sum() - n["sum"][0]) < 1e-6
        assert (n["count"][inner] == n["count"][n["left"][inner]] + n["count"][n["right"][inner]]).all() and (n["gain"][inner] > 0).all()
    half = T.grow(data, T.Rules(30, 1, 0.0, 0.0, False, 0.5, 6), np.random.default_rng(1))
    assert 150 < half["count"][0] < 250
    none = T.grow(T.Binned(x[:, :0], np.zeros(0), data.cuts), rules, np.random.default_rng(1))
    assert none["prediction"].tolist() == [0.0] and none["left"].tolist() == [-1]


def test_cuts_and_numbers_of_features():
    assert T.cuts_of(np.array([3.0, 1.0, 1.0, 2.0]), 31).tolist() == [1.5, 2.5]
    assert T.cuts_of(np.ones(5), 31).tolist() == []
    cuts = T.cuts_of(np.arange(1000.0), 9)
    assert len(cuts) == 9 and set(np.diff(cuts)) == {100.0}
    found = [T.features_per_node(s, 20) for s in ("auto", "all", "onethird", "sqrt", "log2", "7", "30", "0.25", "1.0")]
    assert found == [7, 20, 7, 5, 5, 7, 20, 5, 20]


def test_what_spark_ml_must_fit_itself(spark, table, scratch, monkeypatch):
    """More rows than a task should hold are fitted as before, and numbers that Spark ML refuses stay refused."""
    monkeypatch.setattr(M, "DRIVER_NODES", 500)
    assert T.binned_rows(table, M.forest(bins=300)) is None
    kinds = {"ml_attr": {"attrs": {"nominal": [{"idx": 1, "vals": list("abcde"), "name": "c"}]}, "num_attrs": 4}}
    named = table.withColumn("features", F.col("features").alias("features", metadata=kinds))
    assert T.binned_rows(named, M.forest()) is None
    model, held = M.fit_holdout(named, M.forest(trees=3, depth=9), 120, f"{scratch}/named")
    loaded = [M.load_model(spark, p).transform(named.where("seg >= 120")).select("seg", "prediction").collect() for p in model.paths]
    mean = {r[0].seg: sum(x.prediction * t for x, t in zip(r, model.trees)) / 3 for r in zip(*loaded)}
    assert all(abs(r.prediction - mean[r.seg]) < 1e-9 for r in held.collect()) and len(mean) == 40
    monkeypatch.setattr(T, "TASK_ROWS", 50)
    model, held = M.fit_holdout(table, M.forest(trees=3, depth=9), 120, f"{scratch}/many")
    assert sum(model.trees) == 3 and held.count() == 40
    missing = table.withColumn("label", F.when(F.col("seg") != 5, F.col("label")))
    with pytest.raises(Exception, match="(?i)null or nan"):
        M.fit_holdout(missing, M.forest(trees=3, depth=9), 120, f"{scratch}/missing")
