import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from wavecut.operators import learn as M
from wavecut.operators import leafwise as LW


def table(spark, n=300, width=4, seed=1, values=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) if values is None else rng.integers(0, values, (n, width)).astype(float)
    y = 3 * (x[:, 0] > 0.3) + x[:, 1 % width] * (x[:, 2 % width] > 0) + 0.1 * rng.normal(size=n)
    rows = [(k, Vectors.dense(x[k]), float(y[k]), k % 3) for k in range(n)]
    df = spark.createDataFrame(rows, ["seg", "features", "label", "fold"])
    return df.withColumn("fold", F.col("fold").cast("int")).repartition(3), x, y


def numpy_tree(bins, g, h, w, edges, p, used):
    """The tree by definition: best leaf first, every cut of every feature tried."""
    leaves, out = {(): np.flatnonzero(w > 0)}, np.zeros(len(bins))
    where = {(): np.arange(len(bins))}

    def best(rows):
        found = (-np.inf, 0, 0)
        G, H = (g * w)[rows].sum(), (h * w)[rows].sum()
        for f in used:
            for b in range(len(edges[f])):
                left = rows[bins[rows, f] <= b]
                right = rows[bins[rows, f] > b]
                if min(len(left), len(right)) < max(1, p.min_data_in_leaf):
                    continue
                parts = [((g * w)[r].sum(), (h * w)[r].sum()) for r in (left, right)]
                if min(x[1] for x in parts) < p.min_sum_hessian:
                    continue
                gain = sum(float(LW.score(np.array(a), np.array(c), p)) for a, c in parts) - float(LW.score(np.array(G), np.array(H), p))
                if gain > found[0] + 1e-12:
                    found = (gain, f, b)
        return found

    cuts = {k: best(r) for k, r in leaves.items()}
    while len(leaves) < p.num_leaves:
        can = [k for k in leaves if cuts[k][0] > p.min_split_gain and (p.max_depth < 0 or len(k) < p.max_depth)]
        if not can:
            break
        k = max(can, key=lambda k: cuts[k][0])
        _, f, b = cuts[k]
        for side, name in ((0, "l"), (1, "r")):
            for group in (leaves, where):
                rows = group[k]
                group[(*k, name)] = rows[(bins[rows, f] > b) == side]
            cuts[(*k, name)] = best(leaves[(*k, name)])
        del leaves[k], where[k]
    for k, rows in leaves.items():
        out[where[k]] = LW.leaf_value((g * w)[rows].sum(), (h * w)[rows].sum(), p)
    return out, len(leaves)


def numpy_fit(x, y, keys, edges, p):
    bins = LW.bin_values(x, [np.array(e) for e in edges])
    base = y.mean() if p.objective == "squared" else np.median(y)
    trees, weights = [], []
    for r in range(p.rounds):
        rng = np.random.default_rng([p.seed, r])
        width = x.shape[1]
        used = sorted(rng.choice(width, max(1, round(p.feature_fraction * width)), replace=False).tolist()) if p.feature_fraction < 1 else range(width)
        dropped = [k for k in range(r) if rng.random() < p.drop_rate] if p.drop_rate else []
        f = base + sum((wt * t for k, (t, wt) in enumerate(zip(trees, weights)) if k not in dropped), np.zeros(len(y)))
        g = f - y if p.objective == "squared" else np.sign(f - y)
        w = np.ones(len(y))
        if p.top_rate:
            top = np.sort(np.abs(g))[::-1][int(np.ceil(p.top_rate * len(g))) - 1]
            drawn = LW.unit_hash(keys, p.seed, r, 1) < p.other_rate / (1 - p.top_rate)
            w = np.where(np.abs(g) >= top, 1.0, np.where(drawn, (1 - p.top_rate) / p.other_rate, 0.0))
        if p.bagging_fraction < 1:
            w = w * (LW.unit_hash(keys, p.seed, r, 2) < p.bagging_fraction)
        tree, _ = numpy_tree(bins, g, np.ones(len(g)), w, edges, p, used)
        for k in dropped:
            weights[k] *= len(dropped) / (1 + len(dropped))
        trees.append(tree)
        weights.append(p.learning_rate / (1 + len(dropped)))
    return base + sum(wt * t for t, wt in zip(trees, weights))


@pytest.mark.parametrize("options", [
    {"rounds": 10, "num_leaves": 6, "min_data_in_leaf": 5, "lambda_l1": 0.3, "lambda_l2": 1.5},
    {"rounds": 3, "num_leaves": 20, "min_data_in_leaf": 3, "max_depth": 3, "bagging_fraction": 0.7, "feature_fraction": 0.5},
    {"rounds": 4, "num_leaves": 5, "min_data_in_leaf": 4, "top_rate": 0.2, "other_rate": 0.3},
    {"rounds": 5, "num_leaves": 4, "min_data_in_leaf": 8, "drop_rate": 0.5},
    {"rounds": 3, "num_leaves": 5, "min_data_in_leaf": 9, "objective": "absolute"},
])
def test_equals_the_definition(spark, options):
    df, x, y = table(spark, n=200)
    p = LW.Params(max_bin=32, **options)
    model = LW.fit_leafwise(df, p)
    want = numpy_fit(x, y, np.arange(len(y)), model.edges, p)
    got = {r.seg: r.prediction for r in model.transform(df).collect()}
    assert np.allclose([got[k] for k in range(len(y))], want, rtol=1e-9, atol=1e-9)
    assert all(t.left.count(-1) <= p.num_leaves for t in model.trees) and len(model.trees) == p.rounds


def test_first_tree_is_the_best_split(spark):
    df, x, y = table(spark, n=120, width=1, values=40)
    model = LW.fit_leafwise(df, rounds=1, num_leaves=2, min_data_in_leaf=1, learning_rate=1.0)
    best = min(
        (((y[x[:, 0] <= c] - y[x[:, 0] <= c].mean()) ** 2).sum() + ((y[x[:, 0] > c] - y[x[:, 0] > c].mean()) ** 2).sum(), c)
        for c in np.unique(x)[:-1]
    )
    tree = model.trees[0]
    assert tree.threshold[0] == best[1] and tree.rows == [120, int((x <= best[1]).sum()), int((x > best[1]).sum())]
    assert np.isclose(model.base + tree.value[1], y[x[:, 0] <= best[1]].mean())
    assert np.isclose(tree.gain[0], ((y - y.mean()) ** 2).sum() - best[0])


def test_importances_save_and_going_on(spark, scratch):
    df, x, y = table(spark, n=200)
    p = LW.Params(rounds=4, num_leaves=4, max_bin=32, feature_fraction=0.8, bagging_fraction=0.8)
    prepared = LW.prepare(df, 32)
    whole, half = LW.boost(prepared, p), LW.boost(prepared, LW.replace(p, rounds=2))
    on = LW.boost(prepared, p, half)
    assert [t.value for t in on.trees] == [t.value for t in whole.trees]
    gain, split = whole.importances("gain"), whole.importances("split")
    assert np.isclose(gain.sum(), 1) and np.isclose(split.sum(), 1) and gain[0] == gain.max()
    assert round(split.min() * sum(len(t.left) // 2 for t in whole.trees)) >= 0
    whole.save(spark, f"{scratch}/m")
    loaded = LW.LeafwiseModel.load(spark, f"{scratch}/m")
    a, b = ([r.prediction for r in m.transform(df).orderBy("seg").collect()] for m in (whole, loaded))
    assert a == b and loaded.params == p


def test_early_stopping_and_folds(spark):
    df, x, y = table(spark, n=150)
    noise = df.withColumn("label", F.rand(3)).withColumn("held", F.col("fold") == 0)
    model = LW.fit_leafwise(noise, rounds=12, num_leaves=4, learning_rate=0.8, min_data_in_leaf=3, max_bin=16, valid="held", early_stopping_rounds=2)
    assert len(model.trees) == int(np.argmin(model.history)) + 1 and len(model.history) < 12
    fit = M.cross_fit(df, ["a", "b", "c", "d"], lambda: LW.leafwise(rounds=2, num_leaves=3, max_bin=16), 3)
    assert fit.oof.count() == 150 and fit.importances.count() == 12
    assert fit.importances.groupBy("fold").agg(F.sum("importance").alias("s")).where("abs(s - 1) < 1e-9").count() == 3


def test_odd_features_and_refusals(spark):
    rows = [(k, [1.0, None if k % 5 == 0 else float("nan") if k % 7 == 0 else float(k)], float(k > 20)) for k in range(60)]
    df = spark.createDataFrame(rows, "seg long, features array<double>, label double")
    model = LW.fit_leafwise(df, rounds=2, num_leaves=3, min_data_in_leaf=2)
    assert model.importances()[0] == 0 and model.importances()[1] == 1
    constant = LW.fit_leafwise(df.withColumn("label", F.lit(2.0)), rounds=3)
    assert not constant.trees and {r.prediction for r in constant.transform(df).collect()} == {2.0}
    with pytest.raises(ValueError, match="no label"):
        LW.fit_leafwise(df.withColumn("label", F.when(F.col("seg") > 3, F.col("label"))), rounds=1)
    with pytest.raises(ValueError, match="no rows"):
        LW.fit_leafwise(df.where("false"), rounds=1)
    for bad in ({"objective": "gamma"}, {"num_leaves": 1}, {"top_rate": 0.7, "other_rate": 0.6}, {"drop_rate": 1.0}):
        with pytest.raises(ValueError):
            LW.Params(**bad).check()


def test_threshold_of_the_top_gradients(spark):
    df, x, y = table(spark, n=500, seed=9)
    model = LW.LeafwiseModel(LW.Params(), LW.prepare(df, 32).edges, float(y.mean()))
    prepared = LW.prepare(df, 32)
    passes = LW._Passes(prepared.data, model)
    g = np.abs(y.mean() - y)
    for rate in (0.01, 0.2, 0.5, 1.0):
        found = LW.top_threshold(passes, (), rate)
        assert (g >= found).sum() == int(np.ceil(rate * len(g)))
    # the weighted sample's sums stay near the full ones
    p = LW.Params(top_rate=0.3, other_rate=0.3)
    top = np.sort(g)[::-1][149]
    sums = []
    for seed in range(40):
        drawn = LW.unit_hash(np.arange(500), seed, 0, 1) < p.other_rate / (1 - p.top_rate)
        sums.append(np.where(g >= top, g, np.where(drawn, g * (1 - p.top_rate) / p.other_rate, 0)).sum())
    assert abs(np.mean(sums) / g.sum() - 1) < 0.02 and np.std(sums) / g.sum() < 0.05


def test_race_drops_by_error(spark):
    df, x, y = table(spark, n=120)
    two = df.withColumn("fold", (F.col("seg") % 2).cast("int"))
    drawn = [LW.Params(num_leaves=n, learning_rate=r, min_data_in_leaf=3, max_bin=16) for n, r in ((2, 0.01), (4, 0.3), (3, 0.1), (4, 0.02))]
    best, trials = LW.race(two, drawn, (1, 2, 4))
    rows = [r.asDict() for r in trials.collect()]
    assert [sum(r["rung"] == k for r in rows) for k in range(3)] == [4, 2, 1]
    for k in range(3):
        mine = [r for r in rows if r["rung"] == k]
        kept = [r["error"] for r in mine if r["kept"]]
        assert max(kept) <= min([r["error"] for r in mine if not r["kept"]] or [np.inf])
    winner = next(r["trial"] for r in rows if r["reason"] == "best")
    assert best == LW.replace(drawn[winner], rounds=4)
    # carried on from rung to rung, the winner's error is that of one fit of four rounds
    straight = [LW.fit_leafwise(two.withColumn("h", F.col("fold") == f), best, valid="h").history[-1] for f in (0, 1)]
    assert np.isclose(next(r["error"] for r in rows if r["reason"] == "best"), np.mean(straight), rtol=1e-9)
    assert len(LW.boosted_draws(5)) == 5 and LW.boosted_draws(5) == LW.boosted_draws(5)
    for p in LW.boosted_draws(30):
        p.check()
