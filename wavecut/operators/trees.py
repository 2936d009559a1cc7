"""Regression trees of a random forest, each grown and applied inside one task.

Spark ML grows a forest level by level, with jobs for every level; each task sends a histogram of every open node, and deep
trees have about as many nodes as rows.  Where the binned training rows fit one task, trees are independent work instead:
a task draws the rows of a tree, sums histograms of all nodes of a level at once and puts out the nodes in Spark ML's own layout,
so that the saved forest is a ``RandomForestRegressionModel``.  Cuts, gains, stopping rules and parameters are Spark ML's.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle, inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from wavecut.sources.storage import cut_lineage

# Workers get this module with the job and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows, and bytes of their bins and labels, from which a task grows a tree.
TASK_ROWS, TASK_BYTES = 500_000, 32 << 20
#: Cells of the histograms of nodes that are looked at together.
CELLS = 1 << 18
#: Forests that are grown at the same time; the driver holds none of their nodes.
TOGETHER = 4
#: Nodes of one Arrow batch.
BATCH = 50_000
NODES = (
    "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, "
    "leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"
)


@dataclass(frozen=True)
class Rules:
    """How the trees of a forest are grown; names as in Spark ML."""

    maxDepth: int
    minInstancesPerNode: int
    minWeightPerNode: float
    minInfoGain: float
    bootstrap: bool
    subsamplingRate: float
    features: int


@dataclass(frozen=True)
class Binned:
    """Training rows: bins by feature and row, labels, and the cuts between the bins of each feature."""

    bins: np.ndarray
    label: np.ndarray
    cuts: list[np.ndarray]


def features_per_node(strategy: str, features: int) -> int:
    named = {
        "auto": features / 3, "all": features, "onethird": features / 3, "sqrt": math.sqrt(features), "log2": max(1.0, math.log2(features)),
    }
    if strategy in named:
        return math.ceil(named[strategy])
    return min(int(strategy), features) if strategy.isdigit() else math.ceil(float(strategy) * features)


def cuts_of(values: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` cuts between the distinct values, with about as many values between any two."""
    distinct, counts = np.unique(values, return_counts=True)
    middle = (distinct[:-1] + distinct[1:]) / 2
    if len(middle) <= most:
        return middle
    stride, found = len(values) / (most + 1), []
    target, sums = stride, np.cumsum(counts)
    for i in range(1, len(distinct)):
        if abs(sums[i - 1] - target) < abs(sums[i] - target):
            found.append(middle[i - 1])
            target += stride
    return np.array(found)


def binned_rows(train: DataFrame, estimator: RandomForestRegressor) -> Binned | None:
    """The training rows in bins; None where a task should not hold them, or Spark ML alone knows what to do with them:
    categories, weights, more than 256 bins, missing or infinite numbers (which it refuses)."""
    column, label = estimator.getFeaturesCol(), estimator.getLabelCol()
    kinds = train.schema[column].metadata.get("ml_attr", {}).get("attrs", {})
    if {"nominal", "binary"} & set(kinds) or estimator.getMaxBins() > 256 or (estimator.isDefined("weightCol") and estimator.getWeightCol()):
        return None
    plain = train.select(vector_to_array(column).alias("x"), F.col(label).cast("double").alias("y"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    width = F.size("x")
    seen = plain.agg(
        F.count(F.lit(1)).alias("n"), F.min(width).alias("low"), F.max(width).alias("high"),
        F.count_if(F.col("x").isNull() | ~finite(F.col("y")) | ~F.forall("x", finite)).alias("odd"),
    ).first()
    n, k = seen["n"], seen["high"] or 0
    sample = max(estimator.getMaxBins() ** 2, 10_000)
    if not n or not k or k != seen["low"] or seen["odd"] or n > TASK_ROWS or n * (k + 8) > TASK_BYTES or min(n, sample) * k * 8 > TASK_BYTES:
        return None
    some = plain if n <= sample else plain.sample(sample / n, estimator.getSeed())
    values = matrix(some.select("x").toArrow().column("x").combine_chunks(), k)
    cuts = [cuts_of(values[:, j], min(estimator.getMaxBins(), n) - 1) for j in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"), k)
            rows = np.stack([np.searchsorted(c, x[:, j], "left").astype(np.uint8) for j, c in enumerate(cuts)], axis=1)
            flat = pa.py_buffer(np.ascontiguousarray(rows))
            bins = pa.Array.from_buffers(pa.binary(k), len(rows), [None, flat]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([bins, b.column("y")], ["bins", "y"])

    table = plain.mapInArrow(run, "bins binary, y double").toArrow()
    bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), dtype=np.uint8).reshape(-1, k)
    return Binned(np.ascontiguousarray(bins.T), table.column("y").to_numpy(), cuts)


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow batch as rows."""
    if lists.null_count:
        raise ValueError("a row has no features")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def grow(data: Binned, rules: Rules, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Columns of the nodes of one tree, level by level from the root."""
    n = len(data.label)
    if rules.bootstrap:
        weight = rng.poisson(rules.subsamplingRate, n)
    else:
        weight = (rng.random(n) < rules.subsamplingRate).astype(np.int64)
    rows = np.flatnonzero(weight)
    w, y, node = weight[rows].astype(np.float64), data.label[rows], np.zeros(len(rows), dtype=np.int64)
    width, levels, first, depth = max((len(c) for c in data.cuts), default=0) + 1, [], 0, 0
    size = 1
    while size:
        count, total = np.bincount(node, w, size), np.bincount(node, w * y, size)
        mean = np.divide(total, count, out=np.zeros(size), where=count > 0)
        off = y - mean[node]
        impurity = np.divide(np.bincount(node, w * off * off, size), count, out=np.zeros(size), where=count > 0)
        feature, bin_, gain = np.full(size, -1), np.zeros(size, dtype=np.int64), np.full(size, -1.0)
        start = np.searchsorted(node, np.arange(size + 1))
        mixed = np.zeros(size, dtype=bool)
        if len(y):
            mixed[node[y != y[start[:-1]][node]]] = True
        if depth < rules.maxDepth and width > 1:
            open_ = np.flatnonzero(mixed)
            step = max(1, CELLS // (rules.features * width))
            for at in range(0, len(open_), step):
                some = open_[at : at + step]
                found = best_cuts(data, rules, rng, some, start, rows, w, off, count[some], width)
                good = (found[2] > 0) & (found[2] >= rules.minInfoGain)
                for column, values in zip((feature, bin_, gain), found):
                    column[some[good]] = values[good]
        parents = feature >= 0
        rank = np.cumsum(parents) - 1
        left = np.where(parents, first + size + 2 * rank, -1)
        threshold = np.full(size, np.nan)
        for j in np.unique(feature[parents]):
            threshold[feature == j] = data.cuts[j][bin_[feature == j]]
        levels.append({
            "id": first + np.arange(size), "prediction": mean, "impurity": impurity, "count": count, "sum": total,
            "squares": np.bincount(node, w * y * y, size), "gain": gain, "left": left, "right": np.where(parents, left + 1, -1),
            "feature": feature, "threshold": threshold,
        })
        on = parents[node]
        rows, w, y, node = rows[on], w[on], y[on], node[on]
        node = 2 * rank[node] + (data.bins[feature[node], rows] > bin_[node])
        order = np.argsort(node, kind="stable")
        rows, w, y, node = rows[order], w[order], y[order], node[order]
        first, size, depth = first + size, 2 * int(parents.sum()), depth + 1
    return {c: np.concatenate([x[c] for x in levels]) for c in levels[0]}


def best_cuts(
    data: Binned, rules: Rules, rng: np.random.Generator, some: np.ndarray, start: np.ndarray, rows: np.ndarray,
    w: np.ndarray, off: np.ndarray, count: np.ndarray, width: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, bin and gain of the best cut of each of some nodes, among features drawn for each of them.

    ``rows`` are in the order of their nodes, of which ``start`` has the bounds; ``off`` is the distance from the node's mean.
    """
    k, m = len(data.cuts), len(some)
    drawn = np.argsort(rng.random((m, k)), axis=1)[:, : rules.features] if rules.features < k else np.tile(np.arange(k), (m, 1))
    sizes = start[some + 1] - start[some]
    place = np.repeat(np.arange(m), sizes)
    at = np.arange(len(place)) + np.repeat(start[some] - (np.cumsum(sizes) - sizes), sizes)
    own, weight = rows[at], w[at]
    pull, cells = weight * off[at], m * width
    best, feature, bin_ = np.full(m, -np.inf), np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
    total = count[:, None]
    for j in range(rules.features):
        key = place * width + data.bins[drawn[place, j], own]
        below = np.bincount(key, weight, cells).reshape(m, width).cumsum(axis=1)[:, :-1]
        sums = np.bincount(key, pull, cells).reshape(m, width).cumsum(axis=1)[:, :-1]
        above, least = total - below, max(rules.minInstancesPerNode, rules.minWeightPerNode, 1)
        valid = (below >= least) & (above >= least)
        gains = np.where(valid, sums * sums / np.where(valid, below * above, 1.0), -np.inf)  # its mean square distance to both means
        cut = gains.argmax(axis=1)
        gain = gains[np.arange(m), cut]
        more = gain > best
        best[more], feature[more], bin_[more] = gain[more], drawn[more, j], cut[more]
    return feature, bin_, best


def node_batches(tree: int, nodes: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The nodes of a tree as Spark ML saves them."""
    for at in range(0, len(nodes["id"]), BATCH):
        c = {name: v[at : at + BATCH] for name, v in nodes.items()}
        m, inner = len(c["id"]), c["feature"] >= 0
        stats = pa.ListArray.from_arrays(np.arange(0, 3 * m + 1, 3, dtype=np.int32), np.stack([c["count"], c["sum"], c["squares"]], axis=1).ravel())
        thresholds = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(inner)]).astype(np.int32), c["threshold"][inner])
        ints = lambda v: pa.array(v.astype(np.int32))
        split = pa.StructArray.from_arrays(
            [ints(c["feature"]), thresholds, ints(np.full(m, -1))], ["featureIndex", "leftCategoriesOrThreshold", "numCategories"]
        )
        data = pa.StructArray.from_arrays(
            [ints(c["id"]), pa.array(c["prediction"]), pa.array(c["impurity"]), stats, pa.array(c["count"].astype(np.int64)), pa.array(c["gain"]),
             ints(c["left"]), ints(c["right"]), split],
            ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"],
        )
        yield pa.RecordBatch.from_arrays([ints(np.full(m, tree)), data], ["treeID", "nodeData"])


def empty_forest(train: DataFrame, estimator: RandomForestRegressor, trees: int) -> RandomForestRegressionModel:
    """A model of so many trees of one leaf each, to be saved with the parameters of any forest."""
    whole = {estimator.numTrees: trees, estimator.bootstrap: False, estimator.subsamplingRate: 1.0}
    model = estimator.copy(whole).fit(train.limit(1))
    for p in whole:
        model.clear(model.getParam(p.name))
    return model


def save_forests(train: DataFrame, data: Binned, fits: Sequence[tuple[RandomForestRegressor, str]]) -> None:
    """Grows the forests of some estimators over the same rows, one tree a task, and saves them as Spark ML would.

    Their parameters are saved by Spark ML, with empty trees; then the nodes take the place of those.
    """
    spark = train.sparkSession
    empty = {n: empty_forest(train, fits[0][0], n) for n in {e.getNumTrees() for e, _ in fits}}
    rows = spark.sparkContext.broadcast((data.bins, data.label, data.cuts))  # plain: a worker has no package to read a class from

    def save_empty(estimator: RandomForestRegressor, path: str) -> None:
        model = empty[estimator.getNumTrees()]
        own = {model.getParam(p.name): estimator.getOrDefault(p) for p in estimator.params if estimator.isSet(p) and model.hasParam(p.name)}
        model.copy(own).write().overwrite().save(path)

    def save_nodes(estimator: RandomForestRegressor, path: str) -> None:
        strategy, trees, seed = estimator.getFeatureSubsetStrategy(), estimator.getNumTrees(), estimator.getSeed() % (1 << 64)
        rules = Rules(
            estimator.getMaxDepth(), estimator.getMinInstancesPerNode(), estimator.getMinWeightFractionPerNode() * len(data.label), estimator.getMinInfoGain(),
            estimator.getBootstrap(), estimator.getSubsamplingRate(), features_per_node("all" if strategy == "auto" and trees == 1 else strategy, len(data.cuts)),
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            binned = Binned(*rows.value)
            for b in batches:
                for tree in b.column("id").to_pylist():
                    yield from node_batches(tree, grow(binned, rules, np.random.default_rng([seed, tree])))

        spark.range(0, trees, 1, trees).mapInArrow(run, NODES).write.mode("overwrite").parquet(f"{path}/data")

    with ThreadPool(TOGETHER) as pool:
        for step in (save_empty, save_nodes):
            pool.starmap(inheritable_thread_target(spark)(step), fits, chunksize=1)
    rows.destroy()


# ------------------------------------------------------------------- scoring
@dataclass(frozen=True)
class Scorer:
    """Nodes of several trees one after the other; a leaf is its own child."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    width: int

    def fields(self) -> tuple:
        return self.roots, self.feature, self.threshold, self.left, self.right, self.value, self.width

    def __len__(self) -> int:
        return len(self.left)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sum of the trees' predictions for each row."""
        out = np.zeros(len(x))
        for root in self.roots:
            at, rows = np.full(len(x), root), np.arange(len(x))
            while len(rows):
                node = at[rows]
                inner = self.left[node] != node
                rows, node = rows[inner], node[inner]
                at[rows] = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[at]
        return out


def load_scorer(spark: SparkSession, path: str) -> tuple[Scorer, str] | None:
    """The trees of a saved forest and the name of its features' column; None if a split is one of categories."""
    n = F.col("nodeData")
    table = spark.read.schema(NODES).parquet(f"{path}/data").select(
        "treeID", n["id"].alias("id"), n["prediction"].alias("value"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        n["split"]["featureIndex"].alias("feature"), F.get(n["split"]["leftCategoriesOrThreshold"], 0).alias("threshold"),
        n["split"]["numCategories"].alias("categories"),
    ).toArrow()
    c = {name: table.column(name).to_numpy() for name in table.column_names}
    if (c["categories"] >= 0).any():
        return None
    order = np.argsort((c["treeID"].astype(np.int64) << 32) + c["id"], kind="stable")
    c = {name: v[order] for name, v in c.items()}
    roots = np.flatnonzero(c["id"] == 0)
    base, own = np.repeat(roots, np.diff(np.append(roots, len(order)))), np.arange(len(order))
    left, right = (np.where(c[s] < 0, own, base + c[s]).astype(np.int32) for s in ("left", "right"))
    saved = DefaultParamsReader.loadMetadata(path, spark)
    scorer = Scorer(roots, np.maximum(c["feature"], 0).astype(np.int32), c["threshold"].astype(np.float64), left, right, c["value"], saved["numFeatures"])
    return scorer, (saved["defaultParamMap"] | saved["paramMap"])["featuresCol"]


def tree_sums(nodes: Broadcast, vector: str) -> Column:
    """Sum of the predictions of the trees of some ``Scorer``s, of which the fields are broadcast."""

    @F.arrow_udf(DoubleType())
    def sums(lists: pa.Array) -> pa.Array:
        forests = [Scorer(*fields) for fields in nodes.value]
        x = matrix(lists, forests[0].width)
        return pa.array(sum(f.sums(x) for f in forests))

    return sums(vector_to_array(vector))


def add_sums(df: DataFrame, scorers: Sequence[Scorer], vector: str, column: str) -> DataFrame:
    """The rows, written, with the sums of the trees' predictions added to a column."""
    nodes = df.sparkSession.sparkContext.broadcast([s.fields() for s in scorers])
    done = cut_lineage(df.withColumn(column, F.col(column) + tree_sums(nodes, vector)))
    nodes.destroy()
    return done
