import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavecut.operators import stats as A

TINY5 = [1, 2, 4, 7, -20]


def by_seg(df):
    return df.toPandas().set_index("seg").sort_index()


def signal(n=400, segments=3, seed=5):
    rng = np.random.default_rng(seed)
    return [np.round(rng.normal(4, 20, n), 2) for _ in range(segments)]


def test_hand_made_moments(segment_frame):
    r = by_seg(A.moment_stats(segment_frame(TINY5))).loc[0]
    assert r.x_std == pytest.approx(10.756393447619885)
    assert r.x_skew == pytest.approx(-1.3271791351348017)
    assert r.x_kurt == pytest.approx(0.041791014672254434)
    assert (r.x_max, r.x_min, r.x_range, r.xa_max, r.xa_min) == (7, -20, 27, 20, 1)
    q = by_seg(A.stats20(segment_frame(TINY5))).loc[0]
    assert (q.x_p1, q.x_p5, q.xa_p9) == pytest.approx((-15.8, 2.0, 17.4))


def test_statistics_match_numpy(segment_frame):
    data = signal()
    df = segment_frame(*data)
    wide, quant = by_seg(A.stats36(df)), by_seg(A.abs_quantiles(df))
    adj, iqr = by_seg(A.adjusted_moments(df)), by_seg(A.iqr_median(df))
    mad, trend = by_seg(A.mean_abs_dev(df)), by_seg(A.trend_slope(df))
    assert wide.shape[1] == 36 and quant.shape[1] == 19
    for s, x in enumerate(data):
        xa, ser = np.abs(x), pd.Series(x)
        assert wide.loc[s, "x_p98"] == pytest.approx(np.quantile(x, 0.98))
        assert wide.loc[s, "xa_p92"] == pytest.approx(np.quantile(xa, 0.92))
        assert wide.loc[s, "x_p1"] == wide.loc[s, "x_p05"]
        assert quant.loc[s, "abs_q75"] == pytest.approx(np.quantile(xa, 0.75))
        assert quant.loc[s, "q01"] == pytest.approx(np.quantile(x, 0.01))
        assert adj.loc[s, "std_pop"] == pytest.approx(x.std())
        assert adj.loc[s, "skew"] == pytest.approx(ser.skew())
        assert adj.loc[s, "kurt"] == pytest.approx(ser.kurt())
        assert iqr.loc[s, "iqr"] == pytest.approx(np.subtract(*np.percentile(x, [75, 25])))
        assert iqr.loc[s, "med"] == pytest.approx(np.median(x))
        assert mad.loc[s, "mad"] == pytest.approx(np.abs(x - x.mean()).mean())
        assert trend.loc[s, "abs_trend"] == pytest.approx(np.polyfit(np.arange(len(x)), xa, 1)[0])


def test_head_and_tail(segment_frame):
    data = [signal(120, 1)[0], signal(90, 1, 9)[0]]
    got = by_seg(A.head_tail_stats(segment_frame(*data), (30, 10)))
    for s, x in enumerate(data):
        assert got.loc[s, "std_last_30"] == pytest.approx(x[-30:].std(ddof=1))
        assert got.loc[s, "avg_first_10"] == pytest.approx(x[:10].mean())
        assert got.loc[s, "min_last_10"] == x[-10:].min() and got.loc[s, "max_first_30"] == x[:30].max()


def test_buckets(segment_frame):
    x = signal(100, 1)[0]
    df = segment_frame(x)
    counts = lambda aligned: [
        r.n for r in df.groupBy(A.bucket_number(F.col("no"), 25, aligned).alias("b"))
        .agg(F.count("*").alias("n")).orderBy("b").collect()
    ]
    assert counts(False) == [24, 25, 25, 25, 1] and counts(True) == [25] * 4
    packed = A.pack_bucket_stats(A.bucket_stats(df, 25)).first()
    parts = [x[:24], x[24:49], x[49:74], x[74:99], x[99:]]
    assert packed.stx1 == pytest.approx([p.mean() for p in parts])
    assert packed.stx4 == pytest.approx([np.quantile(np.abs(p), 0.95) for p in parts])


def test_two_levels(segment_frame):
    x = signal(100, 1)[0]
    got = by_seg(A.two_level_stats(segment_frame(x), 25)).loc[0]
    parts = [x[:24], x[24:49], x[49:74], x[74:99], x[99:]]
    p90 = np.array([np.quantile(np.abs(p), 0.9) for p in parts])
    assert got.xap90_std == pytest.approx(p90.std(ddof=1)) and got.xap90_max == pytest.approx(p90.max())
    stds = [np.std([np.quantile(np.abs(p), q) for p in parts], ddof=1) for q in (0.9, 0.92, 0.95, 0.98, 0.99)]
    assert (got.xaSTD_max, got.xaAVG) == pytest.approx((max(stds), np.mean(stds)))
    assert len(got) == 19 + 78 + 2


def test_packing_is_ordered(segment_frame):
    x = signal(500, 2)
    got = {r.seg: r["values"] for r in A.pack_segments(segment_frame(*x)).collect()}
    assert got[0] == list(x[0]) and got[1] == list(x[1])
    assert len(A.pack_segments(segment_frame(x[0]), max_len=500).first()["values"]) == 500
    with pytest.raises(Exception, match="outside 1..100"):
        A.pack_segments(segment_frame(x[0]), max_len=100).collect()


def test_lengths_are_counted_or_checked(segment_frame):
    df = segment_frame(*signal(500, 1), *signal(200, 1))
    got = {r.seg: r for r in A.head_tail_stats(df, (50,)).collect()}
    tail = signal(200, 1)[0][-50:]
    assert got[1].avg_last_50 == pytest.approx(float(np.mean(tail)))
    with pytest.raises(Exception, match="segment 1 has 200 rows, not 500"):
        A.head_tail_stats(df, (50,), seg_len=500).collect()


def test_grouped_statistics_scan_only_what_they_need(spark, scratch, segment_frame, plan_text):
    segment_frame(*signal()).write.parquet(f"{scratch}/t")
    df = spark.read.parquet(f"{scratch}/t")
    for query, scans in ((A.stats14(df), 1), (A.moment_stats(df), 1), (A.stats36(df), 2)):
        plan = plan_text(query)
        assert plan.count("FileScan") == plan.count("Exchange hashpartitioning") == scans
        assert plan.count("ReadSchema: struct<seg:bigint,x:double>") == scans


def test_errors(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 4.0, 1.0), (1, 0.0, 4.0)], "fold int, label double, prediction double")
    assert df.agg(A.mae()).first()[0] == pytest.approx(8 / 3)
    scores = df.groupBy("fold").agg(A.mae().alias("mae"))
    assert A.fold_score_summary(scores).first()[:] == pytest.approx((3.0, 1.0))


@pytest.mark.parametrize("max_group", [10, 60, 10_000])
def test_percentiles_of_oversized_groups_are_exact(segment_frame, max_group):
    rng = np.random.default_rng(2)
    data = [
        rng.normal(0, 1, 700), rng.integers(-3, 3, 400), rng.standard_cauchy(500) * 1e3,
        np.r_[np.zeros(300), 1e-9, 1e9], np.full(90, 7.0), rng.normal(5, 1, 40), [1.0],
    ]
    df = segment_frame(*data)
    quant = by_seg(A.abs_quantiles(df, max_group=max_group))
    wide = by_seg(A.stats36(df, max_group=max_group))
    whole = by_seg(A.stats36(df))
    assert list(wide.columns) == list(whole.columns) and len(wide) == len(data)
    for s, x in enumerate(data):
        x = np.asarray(x, dtype=float)
        for p in A.ABS_QUANTILES:
            assert quant.loc[s, f"abs_q{p:02d}"] == pytest.approx(np.quantile(np.abs(x), p / 100), rel=1e-9, abs=1e-12)
        assert wide.loc[s].to_numpy() == pytest.approx(whole.loc[s].to_numpy(), rel=1e-9, nan_ok=True)


def test_salted_join_equals_broadcast(spark, segment_frame, monkeypatch, plan_text):
    from wavecut.sources import storage as Q

    df = segment_frame(*signal(200, 4))
    table = spark.createDataFrame([(0, 1), (2, 5)], "seg long, k long")
    pick = lambda d: sorted(tuple(r) for r in d.select("seg", "no", "k").collect())
    small = Q.join_small(df, table, ["seg"])
    monkeypatch.setattr(Q, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(Q, "ROWS_PER_TASK", 30)
    spread = Q.join_small(df, table, ["seg"])
    assert pick(small) == pick(spread) and len(pick(small)) == 400
    assert Q.join_small(df, table, ["seg"], "left_anti").count() == 400
    assert "_salt" in plan_text(spread) and "_salt" not in plan_text(small)


def test_approximate_percentiles(segment_frame):
    x = signal(2000, 1)[0]
    got = by_seg(A.stats36(segment_frame(x), accuracy=10_000)).loc[0]
    assert got.x_p95 == pytest.approx(np.quantile(x, 0.95), abs=0.5)
    assert got.x_std == pytest.approx(x.std(ddof=1))
