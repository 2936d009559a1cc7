"""Leaf-wise histogram boosting: trees grown leaf by leaf, best gain first, up to a number of leaves.

Features are cut into bins once and kept as one byte each.  A task sums gradients and hessians of its rows by node,
feature and bin; what is shuffled is one histogram for a task, node and feature.  Of two children the one with fewer rows is
summed, the other is the difference to the parent.  The children of all leaves that may come next are done in one pass,
so a tree takes about as many passes as it has levels, not leaves.  Predictions of earlier trees are computed in the
passes from the model, which is all that lives on the driver besides the best split of each node.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from wavecut.operators.segments import union_sets
from wavecut.sources.storage import cut_lineage, table_root

# Workers get this module with the job and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HIST = "parent long, node long, feature int, g array<double>, h array<double>, n array<long>, gain double, bin int, gl double, hl double, nl long"
_UNIT = float(1 << 64)


@dataclass(frozen=True)
class Params:
    """Names and meanings follow the boosted-tree packages; ``top_rate`` 0 samples nothing, ``drop_rate`` 0 drops no tree."""

    rounds: int = 100
    num_leaves: int = 31
    learning_rate: float = 0.1
    max_depth: int = -1
    max_bin: int = 255
    min_data_in_leaf: int = 20
    min_sum_hessian: float = 1e-3
    min_split_gain: float = 0.0
    lambda_l1: float = 0.0
    lambda_l2: float = 0.0
    feature_fraction: float = 1.0
    bagging_fraction: float = 1.0
    top_rate: float = 0.0
    other_rate: float = 0.1
    drop_rate: float = 0.0
    max_drop: int = 50
    objective: str = "squared"
    early_stopping_rounds: int = 0
    seed: int = 42

    def check(self) -> None:
        if self.objective not in ("squared", "absolute"):
            raise ValueError("objective is squared or absolute")
        if self.num_leaves < 2 or not 2 <= self.max_bin <= 255:
            raise ValueError("num_leaves from 2 on, max_bin from 2 to 255")
        if self.top_rate and not 0 < self.top_rate + self.other_rate <= 1:
            raise ValueError("top_rate + other_rate is at most 1")
        if not 0 <= self.drop_rate < 1:
            raise ValueError("drop_rate is below 1")


@dataclass
class Tree:
    """Nodes in the order they were made; ``left`` is -1 at a leaf.  A row with a bin up to ``bin`` goes left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [float("nan")])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])
    weight: float = 1.0

    def add(self, value: float, rows: int) -> int:
        for column, v in ((self.feature, -1), (self.bin, -1), (self.threshold, float("nan")), (self.left, -1), (self.right, -1), (self.value, value), (self.gain, 0.0), (self.rows, rows)):
            column.append(v)
        return len(self.value) - 1

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """Leaf of each row of a matrix of bins."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        at, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        while len(rows):
            rows = rows[left[at[rows]] >= 0]
            node = at[rows]
            at[rows] = np.where(bins[rows, feature[node]] <= cut[node], left[node], right[node])
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.weight * np.array(self.value)[self.nodes(bins)]


def bin_values(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of a matrix of features; missing values go to the first bin."""
    out = np.empty(x.shape, dtype=np.uint8)
    for j, cuts in enumerate(edges):
        out[:, j] = np.searchsorted(cuts, np.where(np.isnan(x[:, j]), -np.inf, x[:, j]), "left")
    return out


def unit_hash(keys: np.ndarray, *salt: int) -> np.ndarray:
    """A number in [0, 1) for each key, drawn anew for each salt."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.int64).view(np.uint64)
        for s in salt:
            z = (z + np.uint64((0x9E3779B97F4A7C15 * (2 * s + 1)) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            z = z ^ (z >> np.uint64(29))
            z = z * np.uint64(0x94D049BB133111EB)
            z = z ^ (z >> np.uint64(32))
    return z.astype(np.float64) / _UNIT


def shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def score(g: np.ndarray, h: np.ndarray, p: Params) -> np.ndarray:
    return shrunk(g, p.lambda_l1) ** 2 / np.maximum(h + p.lambda_l2, 1e-300)


def leaf_value(g: float, h: float, p: Params) -> float:
    return float(-shrunk(np.array(g), p.lambda_l1) / max(h + p.lambda_l2, 1e-300))


def best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray, p: Params) -> tuple[float, int, float, float, int]:
    """Gain, bin and left sums of the best split of one histogram; a gain of -inf if none is allowed."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    G, H, N = g.sum(), h.sum(), n.sum()
    ok = (nl >= p.min_data_in_leaf) & (N - nl >= p.min_data_in_leaf) & (hl >= p.min_sum_hessian) & (H - hl >= p.min_sum_hessian)
    ok &= (nl > 0) & (nl < N)
    if not ok.any():
        return float("-inf"), -1, 0.0, 0.0, 0
    gain = np.where(ok, score(gl, hl, p) + score(G - gl, H - hl, p) - score(np.array(G), np.array(H), p), -np.inf)
    k = int(np.argmax(gain))
    return float(gain[k]), k, float(gl[k]), float(hl[k]), int(nl[k])


@dataclass
class LeafwiseModel:
    params: Params
    edges: list[list[float]]
    base: float
    trees: list[Tree] = field(default_factory=list)
    history: list[float] = field(default_factory=list)

    def raw(self, bins: np.ndarray, dropped: Sequence[int] = ()) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for k, tree in enumerate(self.trees):
            if k not in dropped:
                out += tree.predict(bins)
        return out

    def transform(self, df: DataFrame, features: str = "features", prediction: str = "prediction") -> DataFrame:
        """Adds the prediction; ``features`` is a vector or an array of doubles."""
        edges, raw = [np.array(e) for e in self.edges], self.raw

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            return pd.Series(raw(bin_values(np.stack(x.to_numpy()).astype(float), edges)) if len(x) else [], dtype=float)

        return df.withColumn(prediction, predict(as_array(df, features)))

    def importances(self, kind: str = "gain") -> np.ndarray:
        """Gain or number of splits by feature, one in sum if there is any split."""
        total = np.zeros(len(self.edges))
        for t in self.trees:
            for f, g, left in zip(t.feature, t.gain, t.left):
                if left >= 0:
                    total[f] += g if kind == "gain" else 1
        return total / total.sum() if total.sum() > 0 else total

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - the name that Spark ML's models have
        return DenseVector(self.importances())

    def save(self, spark: SparkSession, path: str) -> None:
        text = json.dumps({"params": asdict(self.params), "edges": self.edges, "base": self.base, "trees": [asdict(t) for t in self.trees], "history": self.history})
        spark.createDataFrame([(text,)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LeafwiseModel:
        d = json.loads(spark.read.text(path, wholetext=True).first()[0])
        return cls(Params(**d["params"]), d["edges"], d["base"], [Tree(**t) for t in d["trees"]], d["history"])


def as_array(df: DataFrame, features: str):
    kind = df.schema[features].dataType
    return F.col(features).cast("array<double>") if isinstance(kind, ArrayType) else vector_to_array(features)


def find_edges(values: DataFrame, width: int, max_bin: int, accuracy: int = 10_000) -> list[list[float]]:
    """Upper borders of the bins of each feature of ``x`` (an array): all values if they are few, else quantiles.

    What comes to the driver is bounded by ``width * max_bin``.
    """
    long = values.select(F.posexplode("x").alias("feature", "v")).where("v is not null and not isnan(v)")
    few = cut_lineage(long.groupBy("feature").agg(F.approx_count_distinct("v", 0.02).alias("d")))
    small = long.join(F.broadcast(few.where(F.col("d") <= max_bin * 9 // 10)), "feature")
    listed = small.select("feature", "v").distinct().groupBy("feature").agg(F.array_sort(F.collect_list("v")).alias("cuts"))
    steps = F.array(*(F.lit(k / max_bin) for k in range(1, max_bin)))
    large = long.join(F.broadcast(few.where(F.col("d") > max_bin * 9 // 10)), "feature")
    ranked = large.groupBy("feature").agg(F.percentile_approx("v", steps, accuracy).alias("cuts"))
    found = {r.feature: sorted(set(r.cuts))[: max_bin - 1] for r in listed.union(ranked).collect()}
    return [found.get(j, []) for j in range(width)]


@dataclass
class _Rows:
    """What a task computes for its rows, by a model that is not yet complete."""

    model: LeafwiseModel

    def read(self, batch: pa.RecordBatch, dropped: Sequence[int]) -> tuple[np.ndarray, ...]:
        """Bins, gradients, hessians, errors, validation marks and keys of a batch."""
        bins = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
        y, valid = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
        off = self.model.raw(bins, dropped) - y
        g = off if self.model.params.objective == "squared" else np.sign(off)
        return bins, g, np.ones(len(g)), off, valid, batch.column(0).to_numpy()

    def weights(self, g: np.ndarray, keys: np.ndarray, valid: np.ndarray, sample) -> np.ndarray:
        """Weight of each row in this round: 0 for validation rows and those not drawn."""
        p, (round_, threshold) = self.model.params, sample
        w = np.where(valid, 0.0, 1.0)
        if threshold is not None:
            # of the rows with small gradients a part is drawn, and weighs for all of them
            drawn = unit_hash(keys, p.seed, round_, 1) < p.other_rate / (1 - p.top_rate)
            w = w * np.where(np.abs(g) >= threshold, 1.0, np.where(drawn, (1 - p.top_rate) / p.other_rate, 0.0))
        if p.bagging_fraction < 1:
            w = w * (unit_hash(keys, p.seed, round_, 2) < p.bagging_fraction)
        return w


class _Passes:
    """Sums over the binned table."""

    def __init__(self, table: DataFrame, model: LeafwiseModel):
        self.table, self.model, self.source = table, model, _Rows(model)
        self.bins = [len(e) + 1 for e in model.edges]
        self.width = max(self.bins)

    def gradient_counts(self, dropped: Sequence[int], low: float, high: float, cells: int = 1024) -> np.ndarray:
        """How many absolute gradients lie below ``low``, in each of the cells up to ``high``, and from there on."""

        source = self.source

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(cells + 2, dtype=np.int64)
            for batch in batches:
                if batch.num_rows:
                    _, g, _, _, valid, _ = source.read(batch, dropped)
                    at = np.floor((np.abs(g[~valid]) - low) / (high - low) * cells).clip(-1, cells).astype(np.int64) + 1
                    total += np.bincount(at, minlength=cells + 2)
            yield pa.RecordBatch.from_arrays([pa.array(range(cells + 2), pa.int32()), pa.array(total)], names=["i", "n"])

        sums = self.table.mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
        out = np.zeros(cells + 2, dtype=np.int64)
        for r in sums:
            out[r.i] = r.n
        return out

    def histograms(self, expand: Sequence[tuple[int, int, int]], tree: Tree, parents: DataFrame | None, dropped, sample, used: Sequence[int], path: str) -> DataFrame:
        """Histograms with their best splits for the children of each ``(parent, summed child, other child)``.

        The root is its own parent and has no other.  ``used``: the features of this tree.
        """
        p, width, lengths, source, order = self.model.params, self.width, self.bins, self.source, {c: i for i, (_, c, _) in enumerate(expand)}
        small, mother = [c for _, c, _ in expand], {c: q for q, c, _ in expand}
        sibling = {q: (c, o) for q, c, o in expand}
        used = np.array(used)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((3, len(small), len(used), width))
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins, g, h, _, valid, keys = source.read(batch, dropped)
                w = source.weights(g, keys, valid, sample)
                at = np.array([order.get(n, -1) for n in range(len(tree.left))])[tree.nodes(bins)]
                keep = (at >= 0) & (w > 0)
                cell = at[keep][:, None] * (len(used) * width) + (np.arange(len(used)) * width)[None, :] + bins[keep][:, used]
                for k, v in enumerate((g * w, h * w, np.ones(len(g)))):
                    sums[k] += np.bincount(cell.ravel(), np.repeat(v[keep], len(used)), len(small) * len(used) * width).reshape(sums.shape[1:])
            rows = [(i, j) for i in range(len(small)) for j in range(len(used)) if sums[2, i, j].any()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([mother[small[i]] for i, _ in rows], pa.int64()), pa.array([0] * len(rows), pa.int8()), pa.array([int(used[j]) for _, j in rows], pa.int32()),
                 *(pa.array([sums[k, i, j] for i, j in rows], pa.list_(pa.float64())) for k in range(3))],
                names=["parent", "kind", "feature", "g", "h", "n"],
            )

        parts = self.table.mapInArrow(partial, "parent long, kind byte, feature int, g array<double>, h array<double>, n array<double>")
        if parents is not None:
            stored = parents.where(F.col("node").isin(list(sibling))).select(
                F.col("node").alias("parent"), F.lit(1).cast("byte").alias("kind"), "feature", "g", "h", F.col("n").cast("array<double>").alias("n")
            )
            parts = union_sets(parts, stored)

        def settle(rows: pa.Table) -> pa.Table:
            parent, feature, kinds = rows.column("parent")[0].as_py(), rows.column("feature")[0].as_py(), rows.column("kind").to_numpy()
            whole = [np.zeros(width), np.zeros(width), np.zeros(width)]
            child = [np.zeros(width), np.zeros(width), np.zeros(width)]
            for k, name in enumerate(("g", "h", "n")):
                for kind, values in zip(kinds, rows.column(name).to_pylist()):
                    (whole if kind else child)[k] += np.array(values)
            first, other = sibling[parent]
            found = [(first, child)]
            if other is not None:
                found.append((other, [a - b for a, b in zip(whole, child)]))
            cut = [best_cut(g, h, np.rint(n), p) for _, (g, h, n) in found]
            size = lengths[feature]
            return pa.table(
                [pa.array([parent] * len(found), pa.int64()), pa.array([n for n, _ in found], pa.int64()), pa.array([feature] * len(found), pa.int32()),
                 *(pa.array([x[k][:size] for _, x in found], pa.list_(pa.float64())) for k in range(2)),
                 pa.array([np.rint(x[2][:size]).astype(np.int64) for _, x in found], pa.list_(pa.int64())),
                 *(pa.array([c[k] for c in cut], t) for k, t in enumerate((pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.int64())))],
                names=[c.split()[0] for c in HIST.split(", ")],
            )

        padded = F.expr(f"concat(g, array_repeat(0D, {width} - size(g)))"), F.expr(f"concat(h, array_repeat(0D, {width} - size(h)))"), F.expr(f"concat(n, array_repeat(0D, {width} - size(n)))")
        wide = parts.select("parent", "kind", "feature", padded[0].alias("g"), padded[1].alias("h"), padded[2].alias("n"))
        return cut_lineage(wide.groupBy("parent", "feature").applyInArrow(settle, HIST), path)

    def best(self, hist: DataFrame) -> dict[int, tuple]:
        """The best split of every node, and its sums: one small row for each."""
        total = [F.expr(f"aggregate({c}, CAST(0 AS {t}), (a, x) -> a + x)").alias(c.upper()) for c, t in (("g", "double"), ("h", "double"), ("n", "bigint"))]
        rows = hist.select("node", *total, F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "gl", "hl", "nl").alias("s"))
        found = rows.groupBy("node").agg(F.max("s").alias("s"), *(F.max_by(c, "s").alias(c) for c in "GHN")).collect()
        return {r.node: (r.s.gain, -r.s.f, -r.s.b, r.s.gl, r.s.hl, r.s.nl, r.G, r.H, r.N) for r in found}

    def errors(self) -> tuple[float, int]:
        """Sum of the absolute errors of the validation rows, and their number."""

        source = self.source

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            e, n = 0.0, 0
            for batch in batches:
                if batch.num_rows:
                    _, _, _, off, valid, _ = source.read(batch, ())
                    e, n = e + float(np.abs(off[valid]).sum()), n + int(valid.sum())
            yield pa.RecordBatch.from_arrays([pa.array([e]), pa.array([n], pa.int64())], names=["e", "n"])

        r = self.table.mapInArrow(run, "e double, n long").agg(F.sum("e").alias("e"), F.sum("n").alias("n")).first()
        return r.e or 0.0, r.n or 0


def top_threshold(passes: _Passes, dropped: Sequence[int], rate: float) -> float:
    """The absolute gradient that a share ``rate`` of the training rows reaches, by refining the range that holds it."""
    low, high, above = 0.0, 1.0, 0
    counts = passes.gradient_counts(dropped, low, high)
    total = int(counts.sum())
    while counts[-1] > 0:  # find an upper end first
        high *= 1024.0
        counts = passes.gradient_counts(dropped, low, high)
    wanted, cells = max(1, int(np.ceil(rate * total))), len(counts) - 2
    for _ in range(12):
        reached = above + np.cumsum(counts[1:-1][::-1])[::-1]  # rows from each cell on
        k = int(np.flatnonzero(reached >= wanted)[-1])
        if reached[k] == wanted or counts[1 + k] <= 1:
            return low + (high - low) * k / cells
        above += int(counts[2 + k:-1].sum())
        low, high = low + (high - low) * k / cells, low + (high - low) * (k + 1) / cells
        if not high > low * (1 + 1e-13):
            break
        counts = passes.gradient_counts(dropped, low, high)
    return low


def grow(passes: _Passes, dropped, sample, used: Sequence[int], folder: str) -> Tree:
    """One tree: the leaf with the largest gain is split until there are ``num_leaves``."""
    p, tree, serial = passes.model.params, Tree(), 0
    hists = passes.histograms([(0, 0, None)], tree, None, dropped, sample, used, f"{folder}/pass-0")
    known = passes.best(hists)
    if 0 not in known:
        return tree
    G, H, N = known[0][6:]
    tree.value[0], tree.rows[0] = leaf_value(G, H, p), int(N)
    # Every node whose split is known gets children in a shadow tree before its turn comes, so that one pass does many.
    shadow, depth, split_of = Tree(), {0: 0}, {}
    children: dict[int, tuple[int, int]] = {}
    leaves, of_shadow = {0: 0}, {0: 0}  # leaves of the tree and of the shadow: node -> node

    def may_split(node: int) -> bool:
        return node in known and known[node][0] > p.min_split_gain and (p.max_depth < 0 or depth[node] < p.max_depth)

    while len(leaves) < p.num_leaves:
        ready = sorted((n for n in leaves if may_split(n)), key=lambda n: (-known[n][0], n))
        if not ready:
            break
        top = ready[0]
        if top not in children:
            room = p.num_leaves - len(leaves)
            expand = []
            for n in [n for n in ready if n not in children][:room]:
                gain, f, b, gl, hl, nl, G, H, N = known[n]
                shadow.feature[n], shadow.bin[n] = f, b
                left, right = shadow.add(0.0, nl), shadow.add(0.0, N - nl)
                shadow.left[n], shadow.right[n] = left, right
                children[n], depth[left], depth[right] = (left, right), depth[n] + 1, depth[n] + 1
                split_of[left], split_of[right] = (gl, hl, nl), (G - gl, H - hl, N - nl)
                expand.append((n, left, right) if nl <= N - nl else (n, right, left))
            serial += 1
            new = passes.histograms(expand, shadow, hists, dropped, sample, used, f"{folder}/pass-{serial}")
            known |= passes.best(new)
            hists = union_sets(hists, new)
        gain, f, b, *_ = known[top]
        at, (left, right) = leaves.pop(top), children[top]
        tree.feature[at], tree.bin[at], tree.gain[at] = f, b, gain
        tree.threshold[at] = passes.model.edges[f][b]
        ends = [tree.add(leaf_value(*split_of[s][:2], p), int(split_of[s][2])) for s in (left, right)]
        tree.left[at], tree.right[at] = ends
        leaves[left], leaves[right] = ends
    tree.weight = p.learning_rate
    return tree


@dataclass(frozen=True)
class Prepared:
    """The binned rows, written once, with the borders of the bins and where boosting starts from."""

    data: DataFrame
    edges: list[list[float]]
    mean: float
    median: float
    validated: bool
    folder: str


def prepare(
    table: DataFrame, max_bin: int = 255, key: str = "seg", features: str = "features", label: str = "label", valid: str | None = None,
    folder: str | None = None,
) -> Prepared:
    """Bins from the training rows; ``features`` is a vector or an array, ``key`` a whole number, ``valid`` a boolean column."""
    spark = table.sparkSession
    folder = folder or f"{table_root(spark)}/leafwise/{np.random.default_rng().integers(1 << 62):x}"
    plain = table.select(
        F.col(key).cast("bigint").alias("k"), as_array(table, features).alias("x"), F.col(label).cast("double").alias("y"),
        (F.coalesce(F.col(valid).cast("boolean"), F.lit(False)) if valid else F.lit(False)).alias("valid"),
    )
    first = plain.select(F.size("x").alias("w")).first()
    if first is None:
        raise ValueError("no rows to fit")
    sums = plain.where("not valid").agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("m"), F.avg("y").alias("avg"), F.median("y").alias("med")).first()
    if not sums["n"] or sums["n"] != sums["m"]:
        raise ValueError(f"{sums['n'] - sums['m']} of {sums['n']} training rows have no label")
    edges = find_edges(plain.where("not valid"), first["w"], max_bin)
    cuts = [np.array(e) for e in edges]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(batch.num_rows, -1)
                codes = bin_values(x, cuts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([r.tobytes() for r in codes], pa.binary()), batch.column(2), batch.column(3)], names=["k", "bins", "y", "valid"]
                )

    data = cut_lineage(plain.mapInArrow(binned, "k long, bins binary, y double, valid boolean"), f"{folder}/binned")
    return Prepared(data, edges, float(sums["avg"]), float(sums["med"]), valid is not None, folder)


def boost(prepared: Prepared, params: Params, start: LeafwiseModel | None = None) -> LeafwiseModel:
    """Boosts up to ``params.rounds`` trees; goes on from ``start``, with the same result as one longer fit.

    Where rows are marked for validation, their mean absolute error goes to ``history`` and ends the boosting after
    ``early_stopping_rounds`` rounds without a better one; the best number of trees is kept then.
    """
    p = params
    p.check()
    model = LeafwiseModel(p, prepared.edges, prepared.mean if p.objective == "squared" else prepared.median)
    if start is not None:
        model.trees, model.history = [replace(t) for t in start.trees], list(start.history)
    passes, width = _Passes(prepared.data, model), len(prepared.edges)
    for round_ in range(len(model.trees), p.rounds):
        rng = np.random.default_rng([p.seed, round_])
        used = sorted(rng.choice(width, max(1, round(p.feature_fraction * width)), replace=False).tolist()) if p.feature_fraction < 1 else range(width)
        dropped = [k for k in range(round_) if rng.random() < p.drop_rate][: p.max_drop] if p.drop_rate else []
        threshold = top_threshold(passes, dropped, p.top_rate) if p.top_rate else None
        tree = grow(passes, dropped, (round_, threshold), used, f"{prepared.folder}/round-{round_ % 2}")
        if len(tree.value) == 1:
            break
        # the new tree takes its share of what the dropped ones gave
        tree.weight = p.learning_rate / (1 + len(dropped))
        for k in dropped:
            model.trees[k].weight *= len(dropped) / (1 + len(dropped))
        model.trees.append(tree)
        if prepared.validated:
            error, count = passes.errors()
            model.history.append(error / max(count, 1))
            waited = round_ - int(np.argmin(model.history))
            if p.early_stopping_rounds and waited >= p.early_stopping_rounds and not p.drop_rate:
                break
    if model.history and p.early_stopping_rounds and not p.drop_rate:
        model.trees = model.trees[: int(np.argmin(model.history)) + 1]
    return model


def fit_leafwise(
    table: DataFrame, params: Params | None = None, key: str = "seg", features: str = "features", label: str = "label",
    valid: str | None = None, folder: str | None = None, **more,
) -> LeafwiseModel:
    """Boosted trees on ``features`` and ``label``: ``prepare`` and ``boost``; ``more`` changes single parameters.

    Sampling draws by ``key``, so that fits repeat.  Rows without a label fail the job.
    """
    p = replace(params or Params(), **more)
    p.check()
    return boost(prepare(table, p.max_bin, key, features, label, valid, folder), p)


@dataclass(frozen=True)
class LeafwiseRegressor:
    """An estimator for ``cross_fit`` and the searches: ``fit`` takes ``key, features, label``."""

    params: Params = Params()
    key: str = "seg"

    def fit(self, table: DataFrame, valid: str | None = None) -> LeafwiseModel:
        return fit_leafwise(table, self.params, self.key, valid=valid)


def leafwise(key: str = "seg", **params) -> LeafwiseRegressor:
    return LeafwiseRegressor(Params(**params), key)


# ------------------------------------------------------------------- search
def race(
    folded: DataFrame, drawn: Sequence[Params], rungs: Sequence[int], key: str = "seg", keep: float = 0.5
) -> tuple[Params, DataFrame]:
    """Successive halving over boosting rounds: the best parameters and ``trial, rung, rounds, error, kept, reason``.

    ``folded`` has ``key, fold, features, label``.  At each rung every trial still in the race is boosted on, from the
    trees it has, to the rung's number of rounds, and judged by the mean error over its folds; the better ``keep`` share
    goes on, the smaller trial number wins a tie.  A trial that cannot split any more stays with the error it has.
    """
    spark = folded.sparkSession
    folds = [r.fold for r in folded.select("fold").distinct().orderBy("fold").collect()]
    prepared: dict[tuple[int, int], Prepared] = {}
    models: dict[tuple[int, int], LeafwiseModel] = {}
    alive, rows = list(range(len(drawn))), []
    for rung, rounds in enumerate(rungs):
        errors = {}
        for trial in alive:
            p = replace(drawn[trial], rounds=rounds, early_stopping_rounds=0)
            for fold in folds:
                if (fold, p.max_bin) not in prepared:
                    prepared[fold, p.max_bin] = prepare(folded.withColumn("_held", F.col("fold") == fold), p.max_bin, key, valid="_held")
                models[trial, fold] = boost(prepared[fold, p.max_bin], p, models.get((trial, fold)))
            errors[trial] = float(np.mean([models[trial, f].history[-1] if models[trial, f].history else np.inf for f in folds]))
        ranked = sorted(alive, key=lambda t: (errors[t], t))
        last = rung == len(rungs) - 1
        survivors = ranked[: 1 if last else max(1, int(np.ceil(keep * len(ranked))))]
        for place, trial in enumerate(ranked):
            reason = "best" if last and not place else f"place {place + 1} of {len(ranked)}"
            rows.append((trial, rung, rounds, errors[trial], trial in survivors, reason))
        alive = survivors
    table = spark.createDataFrame(rows, "trial int, rung int, rounds int, error double, kept boolean, reason string")
    return replace(drawn[alive[0]], rounds=rungs[-1]), table


def boosted_draws(count: int, seed: int = 42) -> list[Params]:
    """Seeded draws for the leaf-wise trees, with the parameters of the sampling that was drawn."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(count):
        d = DRAWS
        p = {n: int(rng.integers(low, high + 1)) for n, (low, high) in d["whole"].items()}
        p |= {n: float(rng.uniform(low, high)) for n, (low, high) in d["uniform"].items()}
        p["learning_rate"] = float(np.exp(rng.uniform(*np.log(d["learning_rate"]))))
        if rng.random() < 0.5:
            p["bagging_fraction"] = float(rng.uniform(*d["bagging_fraction"]))
        else:
            p |= {"top_rate": float(rng.uniform(0.01, 0.5)), "other_rate": float(rng.uniform(0.01, 0.5))}
        out.append(Params(seed=seed + k, **p))
    return out


# Search ranges of the leaf-wise trees.
DRAWS = {
    "whole": {"num_leaves": (2, 40), "max_depth": (2, 25), "max_bin": (32, 255), "min_data_in_leaf": (1, 256)},
    "uniform": {"lambda_l1": (0.0, 5.0), "lambda_l2": (0.0, 5.0), "feature_fraction": (0.5, 1.0)},
    "learning_rate": (0.005, 0.2),
    "bagging_fraction": (0.5, 1.0),
}
