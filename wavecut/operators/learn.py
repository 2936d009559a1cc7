"""Regression on feature tables: folds, fitting, out-of-fold predictions, search, scoring.

Estimators are Spark ML's distributed trees and linear regression.  A feature
table is read several times by an iterative fit, so it is written once to the
shared folder (``cut_lineage``) before the first of them.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.ml.base import Estimator, Model
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecut.operators.assemble import feature_vector, normalise_target, restore_target, target_scale
from wavecut.operators.segments import consecutive_index, restrict_to_keys, union_sets
from wavecut.operators.stats import mae
from wavecut.operators.trees import add_sums, binned_rows, load_scorer, save_forests
from wavecut.sources.storage import cut_lineage
from wavecut.sources.tables import load_model


#: Nodes of a forest that the driver holds at once.
DRIVER_NODES = 1_000_000
#: Nodes of saved parts that are applied at once; as arrays they take 28 bytes each.
SCORED_NODES = 2_000_000


# -------------------------------------------------------------------- folds
def kfold_assign(df: DataFrame, k: int = 5, seed: int = 42, key: str = "seg") -> DataFrame:
    """Shuffled, balanced folds: rows ranked by a seeded hash of the key, modulo ``k``."""
    digest = F.md5(F.concat_ws("_", F.lit(str(seed)), F.col(key).cast("string")))
    hashed = df.withColumn("_h", F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"))
    ranked = consecutive_index(hashed, "_h", "_rank", block_bits=40, ties=(key,))
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_h", "_rank")


# --------------------------------------------------------------- estimators
def forest(trees: int = 200, depth: int = 30, bins: int = 32, seed: int = 42, **params) -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, maxBins=bins, seed=seed, **params
    )


def boosted(rounds: int = 100, depth: int = 5, step: float = 0.1, seed: int = 42, **params) -> GBTRegressor:
    """Boosted trees on absolute error."""
    params.setdefault("lossType", "absolute")
    return GBTRegressor(
        featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed, **params
    )


@dataclass(frozen=True)
class ForestParts:
    """A forest saved in parts, of which the driver holds one at a time: their paths and numbers of trees."""

    paths: list[str]
    trees: list[int]

    def transform(self, df: DataFrame) -> DataFrame:
        """``prediction``: the mean over the trees of all parts, as many of which are applied at once as a task should hold; the next one is read meanwhile."""
        spark, done, held, features = df.sparkSession, df.withColumn("_sum", F.lit(0.0)), [], ""
        load = inheritable_thread_target(spark)(load_scorer)
        with ThreadPool(1) as ahead:
            coming = ahead.apply_async(load, (spark, self.paths[0]))
            for i, (path, trees) in enumerate(zip(self.paths, self.trees)):
                found = coming.get()
                if i + 1 < len(self.paths):
                    coming = ahead.apply_async(load, (spark, self.paths[i + 1]))
                if found is None:
                    more = load_model(spark, path).transform(done).withColumn("_sum", F.col("_sum") + F.col("prediction") * trees)
                    done = cut_lineage(more.drop("prediction"))
                    continue
                scorer, features = found
                if held and sum(map(len, held)) + len(scorer) > SCORED_NODES:
                    done, held = add_sums(done, held, features, "_sum"), []
                held.append(scorer)
            if held:
                done = add_sums(done, held, features, "_sum")
        return done.withColumn("prediction", F.col("_sum") / sum(self.trees)).drop("_sum")


def fit_forest_parts(train: DataFrame, estimator: RandomForestRegressor, trees: int, folder: str) -> ForestParts:
    """Fits ``trees`` trees at a time, with a seed for each part, and saves each part before the next.

    Where a task can hold the binned rows, tasks grow and save whole trees, several parts at a time; else Spark ML fits the parts.
    """
    total, rng = estimator.getNumTrees(), random.Random(estimator.getSeed())
    strategy, parts = estimator.getFeatureSubsetStrategy(), ForestParts([], [])
    if strategy == "auto" and total > 1:
        strategy = "onethird"  # what it stands for in a regression forest, also where a part has one tree
    fits = []
    for first in range(0, total, trees):
        own = {estimator.numTrees: min(trees, total - first), estimator.featureSubsetStrategy: strategy, estimator.seed: rng.getrandbits(31)}
        fits.append((estimator.copy(own), f"{folder}/part={len(parts.paths)}"))
        parts.paths.append(fits[-1][1])
        parts.trees.append(own[estimator.numTrees])
    rows = binned_rows(train, estimator)
    if rows is not None:
        save_forests(train, rows, fits)
        return parts
    for own, path in fits:
        model = own.fit(train)
        model.write().overwrite().save(path)
        del model
        train.sparkSession._jvm.System.gc()  # broadcasts and nodes of the part go before the next
    return parts


def fit_holdout(
    features: DataFrame, estimator: Estimator, cut: int, folder: str | None = None
) -> tuple[Model | ForestParts, DataFrame]:
    """Time-ordered holdout: fit below ``cut``, predict the rest.

    With a ``folder`` a forest whose trees could have more than ``DRIVER_NODES`` nodes together is fitted in parts.
    """
    train = features.where(F.col("seg") < cut)
    if folder is not None and isinstance(estimator, RandomForestRegressor):
        nodes = min(2 * max(1, train.count()), 2 ** (estimator.getMaxDepth() + 1))
        trees = max(1, DRIVER_NODES // nodes)
        model = fit_forest_parts(train, estimator, trees, folder) if trees < estimator.getNumTrees() else estimator.fit(train)
    else:
        model = estimator.fit(train)
    held = model.transform(features.where(F.col("seg") >= cut))
    return model, held.select("seg", "label", "prediction")


def score_mae(predictions: DataFrame) -> float:
    return RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName="mae").evaluate(predictions)


# ------------------------------------------------------------- fold fitting
@dataclass(frozen=True)
class FoldFit:
    """Tables of a k-fold fit, and the fitted models in fold order."""

    oof: DataFrame
    importances: DataFrame
    models: list[Model]

    def scores(self) -> DataFrame:
        return self.oof.groupBy("fold").agg(mae().alias("mae"))

    def predict(self, test: DataFrame, key: str = "seg") -> DataFrame:
        """``(key, fold, prediction)``: every fold model on every test row."""
        parts = [
            m.transform(test).select(key, F.lit(i).alias("fold"), "prediction") for i, m in enumerate(self.models)
        ]
        return union_sets(*parts)


def cross_fit(
    folded: DataFrame, names: Sequence[str], estimator: Callable[[], Estimator], k: int = 5,
    key: str = "seg", early_stop_tol: float | None = 0.01,
) -> FoldFit:
    """Fits one model per fold on the other folds.

    ``folded`` has ``key, fold, features, label``.  With boosted trees the fold's
    own rows are the validation set that stops the boosting early.
    """
    spark = folded.sparkSession
    held, rows, models = [], [], []
    for fold in range(k):
        est = estimator()
        inside = F.col("fold") == fold
        if early_stop_tol is not None and isinstance(est, GBTRegressor):
            est.setParams(validationIndicatorCol="held", validationTol=early_stop_tol)
            model = est.fit(folded.withColumn("held", inside))
        else:
            model = est.fit(folded.where(~inside))
        models.append(model)
        held.append(model.transform(folded.where(inside)).select(key, "fold", "label", "prediction"))
        rows += importance_rows(model, names, fold)
    return FoldFit(union_sets(*held), importance_table(spark, rows), models)


def importance_rows(model: Model, names: Sequence[str], fold: int) -> list[tuple[str, float, int]]:
    """Importances of tree models; the absolute coefficients of linear ones; nothing for others."""
    for attribute in ("featureImportances", "coefficients"):
        if hasattr(model, attribute):
            values = abs(getattr(model, attribute).toArray())
            break
    else:
        return []
    return [(name, float(values[i]), fold) for i, name in enumerate(names)]


def importance_table(spark: SparkSession, rows: Sequence[tuple[str, float, int]]) -> DataFrame:
    """``(feature, importance, fold)``; as long as features x folds."""
    return spark.createDataFrame(list(rows), "feature string, importance double, fold int")


def fold_average(predictions: DataFrame, key: str = "seg") -> DataFrame:
    """Plain mean of the fold predictions of each row."""
    return predictions.groupBy(key).agg(F.avg("prediction").alias("prediction"))


# ------------------------------------------------------------------- search
@dataclass(frozen=True)
class Uniform:
    low: float
    high: float

    def draw(self, rng: random.Random) -> float:
        return rng.uniform(self.low, self.high)


@dataclass(frozen=True)
class LogUniform:
    low: float
    high: float

    def draw(self, rng: random.Random) -> float:
        return math.exp(rng.uniform(math.log(self.low), math.log(self.high)))


@dataclass(frozen=True)
class Quantised:
    low: float
    high: float
    step: float

    def draw(self, rng: random.Random) -> float:
        value = round(rng.uniform(self.low, self.high) / self.step) * self.step
        value = min(max(value, self.low), self.high)
        return int(value) if float(self.step).is_integer() else round(value, 6)


@dataclass(frozen=True)
class Choice:
    options: tuple

    def draw(self, rng: random.Random):
        return rng.choice(self.options)


@dataclass(frozen=True)
class Space:
    """Common parameters plus one conditional branch per estimator family."""

    common: Mapping[str, object]
    branches: Mapping[str, Mapping[str, object]] = field(default_factory=dict)

    def draw(self, rng: random.Random) -> dict[str, object]:
        family = rng.choice(sorted(self.branches))
        params = {n: d.draw(rng) for n, d in {**self.common, **self.branches[family]}.items()}
        return {"family": family, **params}


# Search ranges, under the names of the matching Spark ML parameters.
SPACES: dict[str, Space] = {
    "lgbm": Space(
        common={
            "maxDepth": Quantised(2, 25, 1),
            "maxBins": Quantised(32, 255, 1),
            "minInstancesPerNode": Quantised(1, 256, 1),
            "featureSubsetStrategy": Quantised(0.5, 1, 0.01),
            "subsamplingRate": Quantised(0.5, 1, 0.01),
        },
        branches={
            "gbt": {"stepSize": LogUniform(0.005, 0.2), "lossType": Choice(("squared", "absolute"))},
            "forest": {},
        },
    ),
    "xgb": Space(
        common={
            "maxDepth": Quantised(2, 25, 1),
            "maxBins": Quantised(8, 128, 1),
            "minWeightFractionPerNode": Uniform(0, 0.4),
            "minInfoGain": Uniform(0, 5),
            "featureSubsetStrategy": Quantised(0.1, 1, 0.01),
            "subsamplingRate": Quantised(0.5, 1, 0.05),
        },
        branches={
            "gbt": {"stepSize": LogUniform(0.005, 0.2), "lossType": Choice(("squared", "absolute"))},
            "forest": {},
        },
    ),
    "cb": Space(
        common={
            "maxDepth": Quantised(2, 8, 1),
            "maxBins": Quantised(2, 32, 1),
            "minInstancesPerNode": Quantised(1, 50, 1),
        },
        branches={
            "gbt": {"stepSize": Uniform(0.05, 0.25), "lossType": Choice(("absolute",))},
            "forest": {"subsamplingRate": Uniform(0.5, 1)},
        },
    ),
}


def candidates(package: str, count: int, seed: int = 42, space: Space | None = None) -> list[dict[str, object]]:
    """Seeded draws from the search space of a package, or from the given one."""
    if space is None and package not in SPACES:
        raise ValueError(f"unknown package {package!r}: use one of {sorted(SPACES)}")
    rng = random.Random(seed)
    return [(space or SPACES[package]).draw(rng) for _ in range(count)]


def _param_map(estimator: Estimator, params: Mapping[str, object]) -> dict:
    convert = {"featureSubsetStrategy": str}
    return {
        estimator.getParam(n): convert.get(n, lambda v: v)(v) for n, v in params.items() if n != "family"
    }


def param_search(
    folded: DataFrame, package: str = "lgbm", num_evals: int = 1000, diagnostic: bool = False,
    seed: int = 42, rounds: int = 100, parallelism: int = 4, space: Space | None = None, metric: str = "mae",
    early_stop_tol: float | None = 0.01,
):
    """Random search by k-fold error, ``metric`` ``mae`` or ``rmse``.

    ``folded`` has ``fold, features, label``.  Every candidate is fitted on all folds but one and judged
    on that one; fits of different candidates run side by side.  Boosting stops early by the error on the
    judged fold.  Returns the best parameters, with ``diagnostic`` also the table
    ``(trial, family, params, fold, error)``.
    """
    if metric not in ("mae", "rmse"):
        raise ValueError("metric is mae or rmse")
    drawn = candidates(package, num_evals, seed, space)
    evaluator = RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName=metric)
    k = folded.agg(F.max("fold")).first()[0] + 1
    data = folded.select("fold", "features", "label")
    rows = []
    for family, base in (("gbt", boosted(rounds=rounds, seed=seed)), ("forest", forest(trees=rounds, seed=seed))):
        trials = [(i, p) for i, p in enumerate(drawn) if p["family"] == family]
        if not trials:
            continue
        maps = [_param_map(base, p) for _, p in trials]
        for fold in range(k):
            inside = F.col("fold") == fold
            judged = data.where(inside)
            if family == "gbt" and early_stop_tol is not None:
                base.setParams(validationIndicatorCol="held", validationTol=early_stop_tol)
                train = data.withColumn("held", inside)
            else:
                train = data.where(~inside)
            fitted = base.fitMultiple(train, maps)

            def one(_: int) -> tuple[int, float]:
                at, model = next(fitted)  # the iterator may be shared by threads
                return at, evaluator.evaluate(model.transform(judged))

            with ThreadPool(min(parallelism, len(maps))) as pool:
                for at, error in pool.imap_unordered(inheritable_thread_target(data.sparkSession)(one), range(len(maps))):
                    i, p = trials[at]
                    rows.append((i, family, json.dumps(p, sort_keys=True), fold, float(error)))
    table = data.sparkSession.createDataFrame(
        rows, "trial int, family string, params string, fold int, error double"
    )
    best = json.loads(best_trial(table).first()["params"])
    return (best, table) if diagnostic else best


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial with the smallest mean error over its folds; the earlier one wins a tie."""
    means = trials.groupBy("trial", "family", "params").agg(F.avg("error").alias("error"))
    return means.orderBy("error", "trial").limit(1)


# --------------------------------------------------------- sequences, scoring
def sequence_regress(
    flat: DataFrame, cut: int, estimator: Estimator | None = None
) -> tuple[Model, float, DataFrame]:
    """Regression of the last-window target on the features of all windows.

    ``flat`` has ``seg, features, label``.  The target is scaled by the largest
    training value and scaled back in the predictions ``(seg, label, prediction)``.
    """
    scale = target_scale(flat.where(F.col("seg") < cut), "label")
    estimator = estimator or LinearRegression(regParam=0.1, elasticNetParam=0.0)
    model, held = fit_holdout(normalise_target(flat, scale, "label"), estimator, cut)
    return model, scale, restore_target(restore_target(held, scale), scale, "label")


def window_regress(sequence: DataFrame, cut: int, estimator: Estimator | None = None) -> DataFrame:
    """One regression pooled over all windows: ``(seg, win, label, prediction)`` of the
    held-out segments, for an error per window.

    ``sequence`` has ``seg, win, f, y``; the window number is a feature of its own.
    """
    rows = feature_vector(sequence, ["f", "win"]).select("seg", "win", "features", F.col("y").alias("label"))
    scale = target_scale(rows.where(F.col("seg") < cut), "label")
    scaled = normalise_target(rows, scale, "label")
    estimator = estimator or LinearRegression(regParam=0.1, elasticNetParam=0.0)
    model = estimator.fit(scaled.where(F.col("seg") < cut))
    held = model.transform(scaled.where(F.col("seg") >= cut)).select("seg", "win", "label", "prediction")
    return restore_target(restore_target(held, scale), scale, "label")


def window_errors(predictions: DataFrame, window: str = "win") -> DataFrame:
    """Mean absolute error per window, next to the default last-window metric."""
    return predictions.groupBy(window).agg(mae().alias("mae"))


def batch_score(
    model: Model, test: DataFrame, key_list: DataFrame, key: str = "name", scale: float = 1.0,
) -> DataFrame:
    """Submission table ``(seg_id, time_to_failure)`` for the listed segments."""
    scored = model.transform(restrict_to_keys(test, key_list, key))
    return restore_target(scored, scale).select(
        F.col(key).alias("seg_id"), F.col("prediction").alias("time_to_failure")
    )


def prepared(features: DataFrame, path: str | None = None) -> DataFrame:
    """The feature table, written once so that iterative fits do not recompute it."""
    return cut_lineage(features, path)


def save_folds(fit: FoldFit, path: str) -> None:
    """Every fold's model below one folder."""
    for fold, model in enumerate(fit.models):
        model.write().overwrite().save(f"{path}/fold={fold}")


def load_folds(spark: SparkSession, path: str, k: int) -> list[Model]:
    return [load_model(spark, f"{path}/fold={fold}") for fold in range(k)]


def score_folds(models: Sequence[Model], test: DataFrame, key_list: DataFrame, key: str = "name", scale: float = 1.0) -> DataFrame:
    """Submission table ``(seg_id, time_to_failure)``: the fold models' mean for the listed segments."""
    listed = restrict_to_keys(test, key_list, key)
    parts = [m.transform(listed).select(key, F.lit(i).alias("fold"), "prediction") for i, m in enumerate(models)]
    scored = restore_target(fold_average(union_sets(*parts), key), scale)
    return scored.select(F.col(key).alias("seg_id"), F.col("prediction").alias("time_to_failure"))
