"""Recurrent states and their readout against plain NumPy loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavecut.operators import learn as M
from wavecut.operators import reservoir as R
from wavecut.operators.assemble import feature_vector, flat_sequences

ROWS = "seg long, win int, f array<double>, y double"


def loop(net, rows):
    """State after every row, one at a time."""
    h, out = np.zeros(len(net.bias)), []
    for x in rows:
        h = (1 - net.leak) * h + net.leak * np.tanh(net.inputs @ np.array(x) + net.recurrent @ h + net.bias)
        out.append(h)
    return out


@pytest.fixture(scope="module")
def sequences():
    rng = np.random.default_rng(11)
    return {s: rng.normal(size=(int(rng.integers(1, 12)), 3)).tolist() for s in range(80)} | {900: rng.normal(size=(700, 3)).tolist()}


def frame(spark, sequences, y=lambda rows, k: float(k)):
    rows = [(s, k, x, y(xs, k)) for s, xs in sequences.items() for k, x in enumerate(xs)]
    np.random.default_rng(3).shuffle(rows)
    return spark.createDataFrame([(int(s), int(k), [float(v) for v in x], float(t)) for s, k, x, t in rows], ROWS)


@pytest.mark.parametrize("batch", [7, 10000])
def test_states_equal_a_loop(spark, sequences, batch):
    net = R.reservoir(3, 10, seed=5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = R.reservoir_states(frame(spark, sequences), net).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == sum(map(len, sequences.values()))
    want = {s: loop(net, xs) for s, xs in sequences.items()}
    assert all(np.allclose(r.h, want[r.seg][r.win], atol=1e-12) for r in got)


def test_old_rows_fade():
    net = R.reservoir(3, 20, radius=0.8, leak=1.0)
    rng = np.random.default_rng(0)
    common = rng.normal(size=(200, 3)).tolist()
    a, b = loop(net, [[5.0, 5.0, 5.0], *common])[-1], loop(net, [[-5.0, 0.0, 2.0], *common])[-1]
    assert np.abs(a - b).max() < 1e-6
    assert np.isclose(np.abs(np.linalg.eigvals(net.recurrent)).max(), 0.8)


def test_readout_is_least_squares(spark, sequences):
    net = R.reservoir(3, 6)
    states = R.reservoir_states(frame(spark, sequences, lambda rows, k: 3 * rows[k][0] - (rows[k - 1][1] if k else 0)), net).persist()
    rows = states.collect()
    a = np.column_stack([np.array([r.h for r in rows]), np.ones(len(rows))])
    want = np.linalg.lstsq(a, np.array([r.y for r in rows]), rcond=None)[0]
    fit = R.fit_readout(states, 6, penalty=0.0)
    assert np.allclose([*fit.weights, fit.intercept], want, atol=1e-8)
    got = {(r.seg, r.win): r.p for r in states.select("seg", "win", fit.column().alias("p")).collect()}
    assert np.allclose([got[r.seg, r.win] for r in rows], a @ want, atol=1e-8)
    residual = states.select("h", (F.col("y") - fit.column()).alias("e")).select("e", F.posexplode("h").alias("k", "v"))
    assert residual.groupBy("k").agg(F.covar_pop("e", "v").alias("c")).where(F.abs("c") > 1e-10).count() == 0
    small = R.fit_readout(states, 6, penalty=100.0)
    assert np.abs(small.weights).max() < np.abs(fit.weights).max() / 20
    states.unpersist()


def test_order_of_windows_is_read(spark):
    """The target depends on which of two equal windows came first: sums over the windows cannot tell, states can."""
    rng = np.random.default_rng(6)
    made = {s: [[float(v)] for v in rng.normal(size=8)] for s in range(400)}
    seq = frame(spark, made, lambda rows, k: 10 + sum(0.6 ** (k - j) * np.tanh(rows[j][0]) for j in range(k + 1)))
    held = R.recurrent_regress(seq, 300, units=40)[3]
    error = held.agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0]
    spread = held.agg(F.stddev_pop("label")).first()[0]
    assert held.count() == 100 and error < 0.1 * spread
    flat = feature_vector(flat_sequences(seq, ["seg"]), ["f"]).select("seg", "features", "label")
    linear = M.sequence_regress(flat, 300)[2]
    assert error < linear.agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0]


def test_odd_rows(spark):
    net = R.reservoir(2, 4)
    empty = spark.createDataFrame([], ROWS)
    assert R.reservoir_states(empty, net).count() == 0
    assert R.fit_readout(R.reservoir_states(empty, net), 4).weights == [0.0] * 4
    with pytest.raises(ValueError):
        R.recurrent_regress(empty, 1)
    extra = spark.createDataFrame([(None, 0, [1.0, 2.0], 1.0, "a"), (None, 1, [1.0, 2.0], None, None), (4, 0, [0.0, 1.0], 1.0, "b"), (4, 0, [0.0, 1.0], 1.0, "b")], ROWS + ", h string")
    got = R.reservoir_states(extra, net).collect()
    want = loop(net, [[1.0, 2.0]] * 2) + loop(net, [[0.0, 1.0]] * 2)
    assert np.allclose(sorted(r.h for r in got), sorted(w.tolist() for w in want))
    for bad in ([1.0], [1.0, None], None, [1.0, float("nan")]):
        with pytest.raises(Exception, match="sequence 9"):
            R.reservoir_states(spark.createDataFrame([(9, 0, bad, 1.0)], ROWS), net).collect()
