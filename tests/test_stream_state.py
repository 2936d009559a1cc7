import numpy as np
import pytest
from pyspark.sql import functions as F

from wavecut.functions.summaries import Moments, QuantileSketch
from wavecut.operators.segments import union_sets
from wavecut.operators.stats import stats20
from wavecut.streaming import ingest, stateful


def feed(spark, rows, folder, seg_len, size=2048, max_files=2):
    rows.write.mode("append").parquet(f"{folder}/in")
    stream = ingest.stream_parquet(spark, f"{folder}/in", rows.schema, max_files)
    stateful.run_stateful(stateful.stateful_stats(stream, seg_len, size=size), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out")


def signal(spark, segments, length, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(s, k + 1, float(v)) for s in range(segments) for k, v in enumerate(rng.normal(3, 40, length))]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "seg long, no long, x double").repartition(3)


def test_segment_over_files_batches_and_a_restart(spark, scratch):
    whole = signal(spark, 5, 90)
    first, second = whole.where("seg < 4 and no % 3 <> 0"), whole.where("seg < 4 and no % 3 = 0")
    assert feed(spark, first, scratch, 90).count() == 0
    assert {(r.seg, r.rows) for r in stateful.open_state(spark, f"{scratch}/state").collect()} == {(s, 60) for s in range(4)}
    out = feed(spark, union_sets(second, whole.where("seg = 4 and no <= 50")), scratch, 90)
    assert sorted(r.seg for r in out.collect()) == [0, 1, 2, 3]
    # the state of complete segments is gone, the rest can be read
    assert [r.seg for r in stateful.open_state(spark, f"{scratch}/state").collect()] == [4]
    got = {r.seg: r for r in union_sets(out, stateful.open_segments(spark, f"{scratch}/state")).collect()}
    for r in stats20(whole.where("seg < 4 or no <= 50")).collect():
        for name, value in r.asDict().items():
            assert got[r.seg][name] == pytest.approx(value, rel=1e-9, abs=1e-9), name
        assert got[r.seg].rank_error == 0
    assert got[4].n == 50


def test_nulls_and_too_many_rows(spark, scratch):
    rows = spark.createDataFrame([(1, 1, 2.0), (1, 2, None), (1, 3, 4.0), (2, 1, None), (2, 2, None), (2, 3, None)], "seg long, no long, x double")
    out = {r.seg: r for r in feed(spark, rows, f"{scratch}/a", 3).collect()}
    assert out[1].n == 2 and out[1].x_avg == 3.0 and out[1].x_p5 == 3.0
    assert out[2].n == 0 and out[2].x_avg is None and out[2].xa_p9 is None
    with pytest.raises(Exception, match="segment 1 has 3 rows, not 2"):
        feed(spark, rows.where("seg = 1").coalesce(1), f"{scratch}/b", 2)


def test_sketched_quantiles_stay_in_their_rank_error(spark, scratch):
    rows = signal(spark, 2, 20_000)
    out = {r.seg: r for r in feed(spark, rows, scratch, 20_000, size=256).collect()}
    for seg, r in out.items():
        values = np.sort(np.array([v.x for v in rows.where(F.col("seg") == seg).collect()]))
        assert 0 < r.rank_error < 0.05 * len(values)
        for name, p in stateful.FIVE_POINT.items():
            for ordered, got, off in ((values, r[f"x_{name}"], r.rank_error), (np.sort(abs(values)), r[f"xa_{name}"], 2 * r.rank_error)):
                low, high = np.searchsorted(ordered, got, "left"), np.searchsorted(ordered, got, "right")
                at = p * (len(ordered) - 1)
                assert low - off - 1 <= at <= high + off + 1, name


def test_moments_merge():
    rng = np.random.default_rng(2)
    x = rng.gamma(2.0, 5.0, 1000)
    merged = Moments()
    for part in np.split(x, [1, 1, 7, 300, 999]):
        merged = merged.merge(Moments.of(part))
    whole = Moments.of(x)
    assert merged.n == whole.n and np.allclose(merged.state(), whole.state(), rtol=1e-9)
    d = x - x.mean()
    assert np.allclose(merged.stats(), [x.mean(), x.std(ddof=1), (d**3).mean() / x.std() ** 3, (d**4).mean() / x.var() ** 2 - 3, x.max()])
    assert Moments().stats() == [None] * 5 and Moments.of(np.array([2.0])).stats() == [2.0, None, None, None, 2.0]


@pytest.mark.parametrize("parts", [1, 37])
def test_sketch_error_is_counted(parts):
    rng = np.random.default_rng(parts)
    x = rng.normal(size=30_000)
    whole = QuantileSketch(size=200)
    for part in np.array_split(x, parts):
        one = QuantileSketch(size=200)
        one.add(part)
        values, lengths = one.state()
        whole.merge(QuantileSketch.restore(200, values, lengths, one.error))
    kept = np.concatenate(whole.levels)
    weights = np.repeat(1 << np.arange(len(whole.levels)), [len(v) for v in whole.levels])
    assert weights.sum() == len(x) and len(kept) < 5000
    for v in np.quantile(x, np.linspace(0, 1, 41)):
        assert abs(weights[kept <= v].sum() - (x <= v).sum()) <= whole.error
    exact = QuantileSketch(size=200)
    exact.add(x[:200])
    assert exact.error == 0 and np.allclose(exact.quantiles([0.0, 0.05, 0.5, 0.33, 1.0]), np.quantile(x[:200], [0.0, 0.05, 0.5, 0.33, 1.0]))
    assert np.allclose(exact.quantiles([0.1, 0.9], absolute=True), np.quantile(abs(x[:200]), [0.1, 0.9]))
