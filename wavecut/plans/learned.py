"""Registered queries of fits that SQL can repeat: trees with one split, their folds, importances, errors and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecut.operators import learn as M
from wavecut.operators import leafwise as LW
from wavecut.operators import reservoir as RS
from wavecut.operators import stats as A
from wavecut.plans.catalog import _cut, _learning_table, _sequence, rounded
from wavecut.plans.signal import SMALL
from wavecut.sources.storage import run_folder

#: More bins than segments: every cut between two values of a feature is tried.
BINS = 4096
#: The search draws the least number of rows on either side of the split.
LEAST_ROWS = (1, 3, 9, 18)
SPACE = M.Space(
    common={
        "minInstancesPerNode": M.Choice(LEAST_ROWS), "maxBins": M.Choice((BINS,)), "maxDepth": M.Choice((1,)), "lossType": M.Choice(("squared",)),
    },
    branches={"gbt": {}},
)
TRIALS, FOLDS = 3, 3
RACE_RUNGS = (1, 2, 4)
#: The recurrent layer over the window bands.
NET = RS.reservoir(SMALL.band_slice[1] - SMALL.band_slice[0] + 1, units=8)


def _stump(**params):
    return M.boosted(rounds=1, depth=1, lossType="squared", maxBins=BINS, **params)


def forest_stump(spark: SparkSession, d: str) -> DataFrame:
    """Held-out predictions of a forest of one tree with one split, without resampling."""
    table, _ = _learning_table(spark, d, "forest-stump")
    tree = M.forest(trees=1, depth=1, bins=BINS, bootstrap=False, featureSubsetStrategy="all")
    return rounded(M.fit_holdout(table, tree, _cut(spark, d, 100))[1])


def _stump_folds(spark: SparkSession, d: str, name: str) -> M.FoldFit:
    table, names = _learning_table(spark, d, name)
    folded = M.prepared(M.kfold_assign(table, 5, 42), f"{run_folder(spark, name, d)}/folded")
    return M.cross_fit(folded, names, _stump, 5, early_stop_tol=None)


def boosted_stump_oof(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold predictions of one round with one split."""
    return rounded(_stump_folds(spark, d, "stump-oof").oof)


def boosted_stump_importance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_stump_folds(spark, d, "stump-importance").importances)


def fold_errors(spark: SparkSession, d: str) -> DataFrame:
    """Mean absolute error of each fold, from the out-of-fold predictions."""
    return rounded(_stump_folds(spark, d, "stump-errors").scores())


def search_trials(spark: SparkSession, d: str) -> DataFrame:
    """Every trial of a search over the least number of rows in a leaf: mean error over the folds, and the best one."""
    table, _ = _learning_table(spark, d, "stump-search")
    folded = M.prepared(M.kfold_assign(table, FOLDS, 42), f"{run_folder(spark, 'stump-search', d)}/folded")
    _, trials = M.param_search(folded, "", TRIALS, diagnostic=True, rounds=1, space=SPACE, early_stop_tol=None)
    best = M.best_trial(trials).select("trial", F.lit(True).alias("best"))
    least = F.get_json_object("params", "$.minInstancesPerNode").cast("bigint")
    means = trials.groupBy("trial", least.alias("least_rows")).agg(F.avg("error").alias("error"))
    return rounded(means.join(best, "trial", "left").na.fill(False, ["best"]))


def leafwise_stump(spark: SparkSession, d: str) -> DataFrame:
    """Held-out predictions of two rounds of leaf-wise boosting with two leaves, shrinkage and an L2 penalty."""
    table, _ = _learning_table(spark, d, "leafwise-stump")
    cut = _cut(spark, d, 100)
    model = LW.fit_leafwise(
        table.where(F.col("seg") < cut), rounds=2, num_leaves=2, learning_rate=0.5, lambda_l2=1.0, min_data_in_leaf=2,
        folder=f"{run_folder(spark, 'leafwise-stump', d)}/fit",
    )
    return rounded(model.transform(table.where(F.col("seg") >= cut)).select("seg", "label", "prediction"))


def leafwise_tree(spark: SparkSession, d: str) -> DataFrame:
    """Cut, share of the variance it explains, rows and leaf values of the first split over all segments, with its importance."""
    table, names = _learning_table(spark, d, "leafwise-tree")
    model = LW.fit_leafwise(
        table, rounds=1, num_leaves=2, learning_rate=1.0, min_data_in_leaf=1, folder=f"{run_folder(spark, 'leafwise-tree', d)}/fit"
    )
    t, squares = model.trees[0], table.agg((F.var_pop("label") * F.count("label")).alias("s")).first()["s"]
    row = (names[t.feature[0]], t.threshold[0], t.gain[0] / squares, t.rows[1], t.rows[2], model.base + t.value[1], model.base + t.value[2], float(model.importances()[t.feature[0]]))
    return rounded(spark.createDataFrame([row], "feature string, threshold double, explained double, left_rows long, right_rows long, left_value double, right_value double, importance double"))


def leafwise_oof(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold table of leaf-wise trees with the sampling of the tuned ones; one row for each segment."""
    table, names = _learning_table(spark, d, "leafwise-oof")
    folded = M.prepared(M.kfold_assign(table, 2, 42), f"{run_folder(spark, 'leafwise-oof', d)}/folded")
    fit = M.cross_fit(folded, names, lambda: LW.leafwise(rounds=3, num_leaves=6, min_data_in_leaf=5, lambda_l1=0.1, top_rate=0.3, other_rate=0.3), 2)
    return rounded(fit.oof)


def racing_search(spark: SparkSession, d: str) -> DataFrame:
    """Four drawn parameter sets raced over one, two and four rounds."""
    table, _ = _learning_table(spark, d, "race")
    folded = M.prepared(M.kfold_assign(table, 2, 42), f"{run_folder(spark, 'race', d)}/folded")
    drawn = [LW.replace(p, num_leaves=min(p.num_leaves, 6), min_data_in_leaf=min(p.min_data_in_leaf, 10)) for p in LW.boosted_draws(4)]
    return rounded(LW.race(folded, drawn, RACE_RUNGS)[1])


def reservoir_states(spark: SparkSession, d: str) -> DataFrame:
    """State of every unit after each window of every segment."""
    states = RS.reservoir_states(_sequence(spark, d), NET)
    return rounded(states.select("seg", "win", "y", F.posexplode("h").alias("unit", "h")))


def reservoir_readout(spark: SparkSession, d: str) -> DataFrame:
    """What the residual of the readout of all windows shares with each unit: nothing; with the unit's mean and the target's."""
    states = M.prepared(RS.reservoir_states(_sequence(spark, d), NET), f"{run_folder(spark, 'reservoir', d)}/states")
    readout = RS.fit_readout(states, len(NET.bias), penalty=0.0)
    rows = states.select("y", readout.column().alias("p"), F.posexplode("h").alias("unit", "h"))
    return rounded(rows.groupBy("unit").agg(
        F.count(F.lit(1)).alias("n"), F.avg("h").alias("mean_state"), (F.avg("p") / F.avg("y")).alias("mean_share"),
        (F.round(F.covar_pop(F.col("y") - F.col("p"), "h") / F.stddev_pop("y"), 6) + F.lit(0.0)).alias("shared"),
    ))


QUERIES = {
    f.__name__: f
    for f in (
        forest_stump, boosted_stump_oof, boosted_stump_importance, fold_errors, search_trials, leafwise_stump, leafwise_tree,
        leafwise_oof, racing_search, reservoir_states, reservoir_readout,
    )
}
