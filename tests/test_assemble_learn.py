import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from wavecut.operators import apply as U
from wavecut.operators import assemble as J
from wavecut.operators import learn as M
from wavecut.sources import tables


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s in range(120):
        a, b, c = rng.normal(0, 1, 3)
        rows.append((s, f"raw_{s:04d}", float(a), [float(b), float(c)], float(3 * a - 2 * b + 10)))
    df = spark.createDataFrame(rows, "seg long, name string, a double, bc array<double>, label double")
    return M.prepared(J.feature_vector(df, ["a", "bc"]))


NAMES = ["a", "b", "c"]


def baseline(df):
    mu = df.agg(F.avg("label")).first()[0]
    return df.agg(F.avg(F.abs(F.col("label") - mu))).first()[0]


def test_joins(spark):
    a = spark.createDataFrame([(0, 1.0, 9.0), (1, 2.0, 8.0)], "seg long, m double, target double")
    b = spark.createDataFrame([(1, 5.0, 8.0), (0, 4.0, 9.0)], "seg long, m double, target double")
    assert J.join_on_segment(a, b.select("seg", F.col("m").alias("k"))).count() == 2
    text = b.withColumn("seg", F.col("seg").cast("string"))
    assert J.join_on_cast_key(a.drop("target"), text.select("seg", F.col("m").alias("k"))).count() == 2
    both = J.join_suffixed(a, b).orderBy("seg").collect()
    assert [(r.m, r.m_denoised) for r in both] == [(1, 4), (2, 5)] and "target_denoised" not in both[0]
    assert J.feature_columns(J.join_suffixed(a, b)) == ["m", "m_denoised"]
    assert [r.seg for r in J.ordered_by_segment(b).collect()] == [0, 1]


def test_prediction_diff(spark):
    schema = "seg_id string, time_to_failure double"
    a = spark.createDataFrame([("s", 5.0), ("t", 2.0)], schema)
    b = spark.createDataFrame([("t", 3.0), ("s", 1.0)], schema)
    got = {r.seg_id: (r.diff, r.abs_diff) for r in J.prediction_diff(a, b).collect()}
    assert got == {"s": (4.0, 4.0), "t": (-1.0, 1.0)}


def test_sequences(spark):
    windows = spark.createDataFrame(
        [(s, *[[float(10 * s + j)] * 2 for j in range(8)]) for s in range(3)],
        "seg long, " + ", ".join(f"f_sl{j} array<double>" for j in range(8)),
    )
    targets = spark.createDataFrame(
        [(s, *[float(100 - 10 * s - j) for j in range(8)]) for s in (0, 2)],
        "seg long, " + ", ".join(f"y{j} double" for j in range(8)),
    )
    seq = J.sequence_table(windows, targets)
    assert seq.count() == 16 and seq.columns == ["seg", "win", "f", "y"]
    flat = {r.seg: r for r in J.flat_sequences(seq).collect()}
    assert flat[2].f == [v for j in range(8) for v in (20.0 + j,) * 2] and flat[2].label == 73.0
    assert J.target_scale(seq) == 100.0
    scaled = J.normalise_target(seq, 100.0).agg(F.max("y")).first()[0]
    assert scaled == 1.0 and J.restore_target(seq, 2.0, "y").agg(F.max("y")).first()[0] == 200.0


def test_top_features(spark):
    rows = [("a", 3.0, 0), ("a", 1.0, 1), ("b", 2.0, 0), ("b", 2.0, 1), ("c", 9.0, 0), ("c", 0.0, 1)]
    imp = spark.createDataFrame(rows, "feature string, importance double, fold int")
    assert [r.feature for r in J.top_features(imp, 2).collect()] == ["c", "a"]  # a before b by name
    assert J.best_feature_rows(imp, 1).count() == 2


def test_folds_are_balanced_and_repeatable(features):
    folded = M.kfold_assign(features, 5, 42)
    sizes = [r["count"] for r in folded.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    pick = lambda df: {r.seg: r.fold for r in df.collect()}
    assert pick(folded) == pick(M.kfold_assign(features.repartition(3), 5, 42))
    assert pick(folded) != pick(M.kfold_assign(features, 5, 51))


def test_cross_fit(features):
    folded = M.prepared(M.kfold_assign(features, 3))
    fit = M.cross_fit(folded, NAMES, lambda: M.boosted(rounds=15, depth=3), 3)
    assert fit.oof.count() == 120 and fit.oof.select("seg").distinct().count() == 120
    assert M.score_mae(fit.oof) < baseline(features)
    assert fit.scores().count() == 3
    top = J.top_features(fit.importances, 1).first()
    assert top.feature == "a" and fit.importances.count() == 9
    predictions = fit.predict(features.where("seg < 10"))
    assert predictions.count() == 30
    assert M.fold_average(predictions).count() == 10
    trees = M.cross_fit(folded, NAMES, lambda: M.forest(trees=5, depth=4), 3)
    assert M.score_mae(trees.oof) < baseline(features)


def test_holdout_forest_and_batch_scoring(spark, features, scratch):
    model, held = M.fit_holdout(features, M.forest(trees=10, depth=6), 90)
    assert held.count() == 30 and M.score_mae(held) < baseline(features)
    keys = spark.createDataFrame([("raw_0003",), ("raw_0007",)], "name string")
    scored = M.batch_score(model, features, keys, scale=2.0)
    assert scored.columns == ["seg_id", "time_to_failure"] and scored.count() == 2
    tables.write_result(scored, f"{scratch}/s", single_file=True)
    assert spark.read.csv(f"{scratch}/s", header=True).count() == 2


def test_candidates_stay_in_range():
    for package, space in M.SPACES.items():
        drawn = M.candidates(package, 200, seed=3)
        assert drawn == M.candidates(package, 200, seed=3)
        assert {p["family"] for p in drawn} == set(space.branches)
        for p in drawn:
            for name, dist in {**space.common, **space.branches[p["family"]]}.items():
                if isinstance(dist, M.Choice):
                    assert p[name] in dist.options
                else:
                    assert dist.low - 1e-9 <= p[name] <= dist.high + 1e-9
            assert ("stepSize" in p) == (p["family"] == "gbt")
    with pytest.raises(ValueError):
        M.candidates("other", 1)


def test_param_search(features):
    folded = M.prepared(M.kfold_assign(features, 2))
    wide = M.SPACES["xgb"]
    space = M.Space({**wide.common, "maxDepth": M.Quantised(2, 3, 1)}, wide.branches)
    best, trials = M.param_search(folded, "xgb", 3, diagnostic=True, rounds=2, space=space)
    assert trials.count() == 6 and best["maxDepth"] <= 3
    means = trials.groupBy("trial").agg(F.avg("error").alias("e"))
    assert M.best_trial(trials).first().error == means.agg(F.min("e")).first()[0]
    assert M.param_search(folded, "xgb", 3, rounds=2, space=space) == best
    assert M.candidates("xgb", 5) == M.candidates("xgb", 5)
    rmse = M.param_search(folded, "xgb", 2, diagnostic=True, rounds=2, space=space, metric="rmse")[1]
    assert rmse.where("error > 0").count() == 4


def test_folds_of_a_linear_model(features):
    folded = M.kfold_assign(features, 2)
    fit = M.cross_fit(folded, [f"f{i}" for i in range(2)], lambda: LinearRegression(regParam=0.1), 2)
    assert fit.oof.count() == features.count() and fit.importances.where("importance >= 0").count() == 4


def test_sequence_regression(features):
    model, scale, held = M.sequence_regress(features, 90, LinearRegression(regParam=0.0))
    assert held.count() == 30 and held.agg(F.max(F.abs(F.col("label") - F.col("prediction")))).first()[0] < 1e-6
    per_window = held.withColumn("win", F.pmod("seg", F.lit(2)))
    assert M.window_errors(per_window).count() == 2 and scale > 0


def test_window_regression(spark):
    rng = np.random.default_rng(4)
    rows = [(s, j, [float(v)], float(5 * v + 2 * j)) for s in range(30) for j, v in enumerate(rng.normal(0, 1, 8))]
    sequence = spark.createDataFrame(rows, "seg long, win int, f array<double>, y double")
    held = M.window_regress(sequence, 20, LinearRegression(regParam=0.0))
    assert held.count() == 80
    errors = {r.win: r.mae for r in M.window_errors(held).collect()}
    assert sorted(errors) == list(range(8)) and max(errors.values()) < 1e-6


def test_segment_apply_bounds_its_groups(segment_frame):
    df = segment_frame(list(range(10)), list(range(25)))
    got = U.segment_apply(df, lambda x: {"s": x.sum(), "n": len(x)}, ["s", "n"], chunk_rows=10)
    rows = {(r.seg, r.chunk): (r.target, r.s, r.n) for r in got.collect()}
    assert rows == {
        (0, 0): (1.0, 45.0, 10.0), (1, 0): (16.0, 45.0, 10.0), (1, 1): (6.0, 145.0, 10.0), (1, 2): (1.0, 110.0, 5.0),
    }


def test_forest_in_parts_holds_few_trees_at_once(spark, monkeypatch, scratch):
    """The parts have all trees with the forest's own options, and predict as their mean, repeated rows included."""
    rows = [(i, float(i % 7), float(i * i % 11), float(i % 7) * 3 + i % 2) for i in range(120)]
    table = spark.createDataFrame([*rows, rows[-1]], "seg long, a double, b double, label double")
    features = J.feature_vector(table, ["a", "b"]).select("seg", "features", "label")
    monkeypatch.setattr(M, "DRIVER_NODES", 600)
    model, held = M.fit_holdout(features, M.forest(trees=7, depth=12), 90, f"{scratch}/parts")
    assert model.trees == [3, 3, 1]
    loaded = [M.load_model(spark, p) for p in model.paths]
    assert [m.getNumTrees for m in loaded] == model.trees and len({m.getSeed() for m in loaded}) == 3
    assert {m.getOrDefault("featureSubsetStrategy") for m in loaded} == {"onethird"}
    want = [m.transform(features.where("seg >= 90")).select("seg", "prediction").collect() for m in loaded]
    mean = {r[0].seg: sum(x.prediction * t for x, t in zip(r, model.trees)) / 7 for r in zip(*want)}
    got = held.collect()
    assert len(got) == 31 and all(abs(r.prediction - mean[r.seg]) < 1e-9 for r in got)
