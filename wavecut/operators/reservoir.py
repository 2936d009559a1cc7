"""Recurrent features over ordered windows: a fixed random recurrent layer and a readout solved from sums.

The layer's weights follow from a seed and never change, so the only thing to fit is a linear readout of its
states: one pass sums the Gram matrix of the states, and the system that is solved on the driver has one row for
each unit.  States run along each sequence in order, however long it is; a task holds one batch of rows and one state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from wavecut.operators.assemble import normalise_target, restore_target, target_scale
from wavecut.operators.leafwise import as_array
from wavecut.sources.storage import cut_lineage


@dataclass(frozen=True)
class Reservoir:
    """``h' = (1 - leak) h + leak tanh(inputs x + recurrent h + bias)``, starting from zeros."""

    inputs: np.ndarray
    recurrent: np.ndarray
    bias: np.ndarray
    leak: float

    def step(self, h: np.ndarray, x: np.ndarray) -> np.ndarray:
        """States after one more row of each sequence."""
        return (1 - self.leak) * h + self.leak * np.tanh(x @ self.inputs.T + h @ self.recurrent.T + self.bias)


def reservoir(width: int, units: int = 64, seed: int = 42, radius: float = 0.9, reach: float = 1.0, leak: float = 0.5) -> Reservoir:
    """Weights of ``units`` units over ``width`` features.

    ``radius``: largest absolute eigenvalue of the recurrent weights, below 1 so that old rows fade; ``reach``: the
    deviation of a unit's summed input, for features of unit deviation.
    """
    rng = np.random.default_rng(seed)
    recurrent = rng.normal(size=(units, units))
    recurrent *= radius / np.abs(np.linalg.eigvals(recurrent)).max()
    return Reservoir(rng.normal(scale=reach / np.sqrt(width), size=(units, width)), recurrent, rng.uniform(-0.5, 0.5, units), leak)


def _matrix(column: pa.Array, width: int, keys: list) -> np.ndarray:
    """The rows of an array column; a row that is NULL, of another length or has a NULL fails with its sequence."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    wrong = np.flatnonzero(lengths != width)
    if not len(wrong) and not np.isfinite(values).all():
        wrong = np.flatnonzero(~np.isfinite(values)) // width
    if len(wrong):
        raise ValueError(f"sequence {keys[wrong[0]]!r}: a row without {width} finite features")
    return values.reshape(-1, width)


def reservoir_states(sequence: DataFrame, net: Reservoir, key: str = "seg", order: str = "win", features: str = "f") -> DataFrame:
    """The rows of ``sequence`` with the state ``h`` after each of them in place of the features.

    Rows of one ``key`` run in ``order`` (equal ones by their features); rows without a key are one sequence.  Other
    columns pass through.  One exchange; each batch steps all of its sequences at once and hands the last one's state on.
    """
    units, width = net.inputs.shape
    kept = [f for f in sequence.schema.fields if f.name not in (features, "h")]
    names = [f.name for f in kept]
    ordered = sequence.select(*names, as_array(sequence, features).alias("h")).repartition(key).sortWithinPartitions(key, order, "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, last, carried = False, None, None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            keys = batch.column(names.index(key)).to_pylist()
            x = _matrix(batch.column(len(names)), width, keys)
            first = np.array([i for i in range(n) if i == 0 or keys[i] != keys[i - 1]])
            length = np.diff(np.append(first, n))
            state, h = np.zeros((len(first), units)), np.empty((n, units))
            if started and keys[0] == last:
                state[0] = carried
            for t in range(length.max()):
                live = np.flatnonzero(length > t)
                at = first[live] + t
                h[at] = state[live] = net.step(state[live], x[at])
            started, last, carried = True, keys[-1], state[-1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * units, pa.int32()), pa.array(h.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*names, "h"])

    return ordered.mapInArrow(run, StructType([*kept, StructField("h", ArrayType(DoubleType()))]))


@dataclass(frozen=True)
class Readout:
    """A linear function of the states."""

    weights: list[float]
    intercept: float

    def column(self, states: str = "h") -> Column:
        terms = F.zip_with(F.col(states), F.array(*(F.lit(w) for w in self.weights)), lambda h, w: h * w)
        return F.aggregate(terms, F.lit(self.intercept), lambda a, b: a + b)


def gram_sums(states: DataFrame, units: int, target: str) -> np.ndarray:
    """Products of (states, 1) with (states, 1, target), summed over all rows with a target.

    One matrix for each task is summed cell by cell in Spark; (units + 1) x (units + 2) numbers come to the driver.
    """
    size = units + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                h = _matrix(batch.column(0), units, [None] * batch.num_rows)
                y = batch.column(1).to_numpy(zero_copy_only=False)
                a = np.column_stack([h, np.ones(len(h))])
                total += a.T @ np.column_stack([a, y])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["cells"])

    rows = states.where(F.col(target).isNotNull()).select("h", F.col(target).cast("double").alias("y"))
    cells = rows.mapInArrow(run, "cells array<double>").select(F.posexplode("cells").alias("cell", "v"))
    sums = cells.groupBy("cell").agg(F.sum("v").alias("v"))
    out = np.zeros(size * (size + 1))
    for r in sums.collect():
        out[r.cell] = r.v
    return out.reshape(size, size + 1)


def fit_readout(states: DataFrame, units: int, target: str = "y", penalty: float = 1e-6) -> Readout:
    """Least squares with ``penalty`` times the number of rows on the squared weights; without rows the readout is 0."""
    sums = gram_sums(states, units, target)
    gram, moment = sums[:, :-1], sums[:, -1]
    gram[np.arange(units), np.arange(units)] += penalty * gram[-1, -1]
    found = np.linalg.lstsq(gram, moment, rcond=1e-14)[0]
    return Readout([float(w) for w in found[:-1]], float(found[-1]))


def last_states(states: DataFrame, key: str = "seg", order: str = "win") -> DataFrame:
    """Each sequence's last row, whose state has read all of it."""
    rest = [c for c in states.columns if c not in (key, order)]
    last = F.max_by(F.struct(order, *rest), order).alias("_last")
    return states.groupBy(key).agg(last).select(key, "_last.*")


def recurrent_regress(
    sequence: DataFrame, cut: int, units: int = 64, seed: int = 42, penalty: float = 1e-6, folder: str | None = None, **shape,
) -> tuple[Reservoir, Readout, float, DataFrame]:
    """Regression of the last window's target on the state after all windows, read in order.

    ``sequence`` has ``seg, win, f, y``.  Sequences below ``cut`` train; the target is scaled by the largest training
    value and scaled back.  Returns the layer, the readout, the scale and ``seg, label, prediction`` of the others.
    """
    width = sequence.select(F.size(as_array(sequence, "f")).alias("n")).first()
    if width is None:
        raise ValueError("no sequence to fit")
    net = reservoir(width.n, units, seed, **shape)
    states = reservoir_states(sequence.select("seg", "win", "f", "y"), net)
    last = cut_lineage(last_states(states).withColumnRenamed("y", "label"), folder)
    train = last.where(F.col("seg") < cut)
    scale = target_scale(train, "label")
    readout = fit_readout(normalise_target(train, scale, "label"), units, "label", penalty)
    held = last.where(F.col("seg") >= cut).select("seg", "label", readout.column().alias("prediction"))
    return net, readout, scale, restore_target(held, scale)
