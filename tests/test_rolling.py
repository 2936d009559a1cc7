import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavecut.functions import weights as W
from wavecut.operators import rolling as R

TINY = np.finfo(0.0).tiny


def by_seg(df):
    return df.toPandas().set_index("seg").sort_index()


def signal(n, seed=3, offset=0.0):
    return np.random.default_rng(seed).normal(offset, 9, n)


def convolved(x, w):
    start = (w - 1) // 2
    return (np.convolve(x, np.hanning(w), "full")[start : start + len(x)] / np.hanning(w).sum()).mean()


def energy_ratio(x, sta, lta):
    total = np.cumsum(x**2)
    short, long = total.copy(), total.copy()
    short[sta:] = total[sta:] - total[:-sta]
    long[lta:] = total[lta:] - total[:-lta]
    short[: lta - 1] = 0
    return ((short / sta) / np.maximum(long / lta, TINY)).mean()


def lagged(x, k):
    c = x - x.mean()
    return (c[:-k] * c[k:]).sum() / ((len(x) - k) * x.var())


DATA = [signal(300), signal(211, 4, 1e6), signal(40, 5)]
# known bound (one window partition per segment), then chunks with a halo
LAYOUTS = [{"seg_len": 300}, {"chunk_rows": 37}, {"chunk_rows": 7}]


@pytest.mark.parametrize("layout", LAYOUTS, ids=str)
def test_prefix_sum_features(segment_frame, layout):
    df = segment_frame(*DATA)
    std = by_seg(R.rolling_std(df, (5, 4, 30), **layout))
    ext = by_seg(R.roll_extrema(df, (2, 10, 100), **layout))
    bb = by_seg(R.bollinger(df, 7, (5, 4), **layout))
    acf = by_seg(R.autocorrelation(df, (1, 10, 39), **layout))
    ratio = by_seg(R.sta_lta(df, ((3, 20), (10, 35)), **layout))
    for s, x in enumerate(DATA):
        ser = pd.Series(x)
        assert std.loc[s, "ma_30_std_mean"] == pytest.approx(ser.rolling(30).std().mean(), rel=1e-6)
        assert ext.loc[s, "abs_max_roll_mean_10"] == pytest.approx(ser.rolling(10).mean().abs().max())
        assert ext.loc[s, "abs_max_roll_std_2"] == pytest.approx(ser.rolling(2).std().max(), rel=1e-6)
        high = ser.rolling(7).mean().mean() + 2 * ser.rolling(4).std().mean()
        assert bb.loc[s, "bb_4_high_mean"] == pytest.approx(high)
        assert acf.loc[s, "autocorrelation_10"] == pytest.approx(lagged(x, 10), abs=1e-9)
        assert ratio.loc[s, "sta_lta1_mean"] == pytest.approx(energy_ratio(x, 3, 20), rel=1e-6)
    assert np.isnan(ext.loc[2, "abs_max_roll_std_100"])  # frame longer than the segment


@pytest.mark.parametrize("layout", LAYOUTS, ids=str)
def test_change_rates(segment_frame, layout):
    x = np.array([0.0, 0.0, 1.0, 1.0, 3.0])
    got = by_seg(R.change_rate(segment_frame(x, DATA[0]), (5, 3), **layout))
    assert got.loc[0, "nonzero_rate_pos_mean_first_5"] == pytest.approx(4 / 3)
    assert got.loc[0, "mean_rate_first_5"] == pytest.approx(1.0)
    with np.errstate(all="ignore"):
        tail = DATA[0][-3:]
        want = np.mean(np.nonzero(np.diff(tail) / tail[:-1])[0])
    assert got.loc[1, "nonzero_rate_pos_mean_last_3"] == pytest.approx(want)


@pytest.mark.parametrize("seg_len", [None, 300])
def test_weighted_sum_features(segment_frame, seg_len):
    data = [signal(300), signal(300, 8, 50.0)] if seg_len else DATA
    df = segment_frame(*data)
    mean = by_seg(R.rolling_mean(df, (1, 7, 40), seg_len=seg_len))
    ewma = by_seg(R.ewma_mean(df, (3, 20, 200), seg_len=seg_len))
    hann = by_seg(R.hann_mean(df, (3, 4, 25, 36), seg_len=seg_len))
    for s, x in enumerate(data):
        ser = pd.Series(x)
        for w in (1, 7, 40):
            assert mean.loc[s, f"ma_{w}_mean"] == pytest.approx(ser.rolling(w).mean().mean())
        for span in (3, 20, 200):
            assert ewma.loc[s, f"ewma_{span}_mean"] == pytest.approx(ser.ewm(span=span).mean().mean())
        for w in (3, 4, 25, 36):
            assert hann.loc[s, f"hann_{w}_mean"] == pytest.approx(convolved(x, w))


def test_frames_longer_than_the_segment_give_null(segment_frame):
    got = R.rolling_mean(segment_frame([1, 2, 3]), (4,)).first()
    assert got.ma_4_mean is None


def test_constant_segment(segment_frame):
    df = segment_frame([5.0] * 50)
    assert R.autocorrelation(df, (3,), seg_len=50).first().autocorrelation_3 is None
    assert R.rolling_std(df, (4,), seg_len=50).first().ma_4_std_mean == 0.0
    zero = segment_frame([0.0] * 50)
    assert R.sta_lta(zero, ((3, 10),), seg_len=50).first().sta_lta1_mean == 0.0


def test_weighted_sums_do_not_shuffle_rows(segment_frame, plan_text):
    plan = plan_text(R.rolling_mean(segment_frame([1, 2, 3]), (2,), seg_len=3))
    assert "Window" not in plan and "partial_sum" in plan


def test_prefix_sums_shuffle_and_sort_once(spark, segment_frame, scratch, plan_text):
    segment_frame(*DATA).write.parquet(f"{scratch}/t")
    plan = plan_text(R.roll_extrema(spark.read.parquet(f"{scratch}/t"), (2, 5, 9), seg_len=300))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_chunks_bound_the_window_partitions(segment_frame):
    o = R.ordered_rows(segment_frame(signal(1000)), reach=20, chunk_rows=50)
    sizes = o.rows.groupBy("seg", "_chunk").count().agg(F.max("count")).first()[0]
    assert sizes <= 50 + 20
    assert o.rows.where(o.own).count() == 1000


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    values=st.lists(st.integers(-30000, 30000), min_size=3, max_size=80),
    width=st.integers(2, 12), chunk=st.integers(1, 30),
)
def test_rolling_property(segment_frame, values, width, chunk):
    got = R.roll_extrema(segment_frame(values), (width,), chunk_rows=chunk).first()
    want = pd.Series(values, dtype=float).rolling(width).std().max()
    value = got[f"abs_max_roll_std_{width}"]
    assert (value is None) == bool(np.isnan(want))
    if value is not None:
        assert value == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_ewma_table_depends_on_the_span_only():
    assert W.ewma_table_length(6000) < 130_000
    assert W.ewma_weights(3)[-1] == pytest.approx(1.0)
    assert W.ewma_weight_at(3, 10_000) == 1.0


def test_bad_arguments(segment_frame):
    df = segment_frame([1, 2, 3])
    for call in (lambda: R.rolling_std(df, (1,)), lambda: R.hann_mean(df, (2,)), lambda: R.sta_lta(df, ((5, 5),))):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("feature", [
    lambda df: R.rolling_mean(df, (2,)), lambda df: R.rolling_std(df, (2,)), lambda df: R.bollinger(df, 2, (2,)),
    lambda df: R.roll_extrema(df, (2,)), lambda df: R.ewma_mean(df, (3,)), lambda df: R.sta_lta(df, ((1, 2),)),
    lambda df: R.autocorrelation(df, (1,)), lambda df: R.change_rate(df, (2,)), lambda df: R.hann_mean(df, (3,)),
])
def test_a_missing_sample_is_refused(spark, feature):
    df = spark.createDataFrame([(0, 1, 1.0), (0, 2, None), (0, 3, 3.0), (0, 4, 4.0)], "seg long, no long, x double")
    with pytest.raises(Exception, match="NULL value in segment 0 at position 2"):
        feature(df).collect()


def test_lengths_of_partial_segments(segment_frame):
    rng = np.random.default_rng(6)
    full, tail = rng.normal(size=60), rng.normal(size=25)
    df = segment_frame(full, tail)
    for values, seg in ((full, 0), (tail, 1)):
        s = pd.Series(values)
        mean = {r.seg: r.ma_5_mean for r in R.rolling_mean(df, (5,)).collect()}[seg]
        ewm = {r.seg: r.ewma_3_mean for r in R.ewma_mean(df, (3,)).collect()}[seg]
        assert mean == pytest.approx(s.rolling(5).mean().mean()) and ewm == pytest.approx(s.ewm(span=3).mean().mean())
    for feature in (R.rolling_mean, R.hann_mean, R.ewma_mean):
        with pytest.raises(Exception, match="has 25 rows, not 60"):
            feature(df, (5,), seg_len=60).collect()
    with pytest.raises(Exception, match="60 rows, not 30 at most"):
        R.rolling_std(df, (5,), seg_len=30).collect()
