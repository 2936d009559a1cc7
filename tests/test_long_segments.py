import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavecut.operators import long_spectral as LS
from wavecut.operators import pyramid as PY
from wavecut.operators import running as RU
from wavecut.operators import series as SE
from wavecut.operators import sketches as SK
from wavecut.operators import spectral as V
from wavecut.operators import stats as A

RNG = np.random.default_rng(4)
SEGMENTS = [RNG.normal(2, 30, n) for n in (240, 97, 1, 128, 2)]


def rows_of(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


# ----------------------------------------------------------------- spectra
def test_factors():
    assert LS.factors(150_000, 1000) == (375, 400) and LS.factors(97, 50) is None and LS.factors(97, 97) == (1, 97)
    assert LS.padded(97) == 256 and LS.padded(1) == 1 and LS.padded(128) == 256


@pytest.mark.parametrize("chunk", [16, 64, 1 << 20])
def test_spectrum_equals_numpy(spark, segment_frame, chunk):
    df = segment_frame(*SEGMENTS)
    got = rows_of(LS.long_spectrum(df, chunk=chunk), "seg", "i")
    for s, values in enumerate(SEGMENTS):
        want = np.fft.fft(values)
        assert np.allclose([complex(got[s, k].re, got[s, k].im) for k in range(len(values))], want, atol=1e-9 * max(1, abs(want).max()))
    assert len(got) == sum(map(len, SEGMENTS))


def test_only_wanted_bins(spark, segment_frame):
    found = LS.long_spectrum(segment_frame(*SEGMENTS), wanted=F.col("i").between(3, 5), chunk=16).collect()
    assert {(r.seg, r.i) for r in found} == {(s, i) for s, v in enumerate(SEGMENTS) for i in range(3, 6) if i < len(v)}


def test_features_equal_the_packed_ones(spark, segment_frame):
    df = segment_frame(SEGMENTS[0], SEGMENTS[1], SEGMENTS[3])
    packed = A.pack_segments(df)
    for got, want in (
        (LS.long_fft_mag_stats(df, 5, 60, 20, chunk=16), V.fft_mag_stats(packed, 5, 60, 20)),
        (LS.long_envelope_mean(df, chunk=16), V.envelope_mean(packed)),
    ):
        got, want = rows_of(got, "seg"), rows_of(want, "seg")
        for seg, r in want.items():
            for name, value in r.asDict().items():
                assert got[seg][name] == pytest.approx(value, rel=1e-9), name


def test_sixteen_chunks_and_no_larger_task(spark, segment_frame):
    n, chunk = 4096, 256
    x = RNG.normal(size=n)
    n1, n2 = LS.factors(n, chunk)
    assert n1 * max(1, chunk // n1) <= chunk and n2 * max(1, chunk // n2) <= chunk
    df = segment_frame(x)
    got = LS.long_fft_mag_stats(df, 10, 2000, 500, chunk=chunk).first()
    want = V.fft_mag_stats(A.pack_segments(df), 10, 2000, 500).first()
    for name, value in want.asDict().items():
        assert got[name] == pytest.approx(value, rel=1e-9), name
    groups = df.select(F.floor(((F.col("no") - 1) % n2) / (chunk // n1)).alias("g")).groupBy("g").count().collect()
    assert len(groups) == 16 and all(g["count"] == chunk for g in groups)
    with pytest.raises(Exception, match="needs chunk="):
        LS.long_spectrum(df, chunk=8).collect()


def test_null_value_is_named(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (0, 2, None)], "seg long, no long, x double")
    with pytest.raises(Exception, match="NULL value in segment 0 at position 2"):
        LS.long_spectrum(df).collect()


# ------------------------------------------------------------------ series
@pytest.mark.parametrize("chunk_rows, chunks", [(1 << 18, 1 << 10), (7, 2), (1, 3), (50, 1)])
def test_series_equal_pandas(spark, segment_frame, chunk_rows, chunks):
    df = segment_frame(*SEGMENTS)
    ewma = rows_of(SE.ewma_series(df, (3, 20), chunk_rows=chunk_rows, chunks=chunks), "seg", "no")
    total = rows_of(SE.cumulative_series(df, chunk_rows=chunk_rows, chunks=chunks), "seg", "no")
    for s, values in enumerate(SEGMENTS):
        x = pd.Series(values)
        for name, want in (("ewma_3", x.ewm(span=3).mean()), ("ewma_20", x.ewm(span=20).mean())):
            assert np.allclose([ewma[s, k + 1][name] for k in range(len(x))], want, rtol=1e-10, atol=1e-9)
        assert np.allclose([total[s, k + 1].cum_sum for k in range(len(x))], x.cumsum(), atol=1e-8)
        assert np.allclose([total[s, k + 1].cum_mean for k in range(len(x))], x.expanding().mean(), atol=1e-8)


@pytest.mark.parametrize("chunk_rows", [1 << 18, 9])
def test_rolling_series(spark, segment_frame, chunk_rows):
    got = rows_of(SE.rolling_series(segment_frame(*SEGMENTS), (5, 30), (4,), chunk_rows=chunk_rows), "seg", "no")
    for s, values in enumerate(SEGMENTS):
        x = pd.Series(values)
        for name, want in (("ma_5", x.rolling(5).mean()), ("ma_30", x.rolling(30).mean()), ("sd_4", x.rolling(4).std())):
            found = np.array([got[s, k + 1][name] for k in range(len(x))], dtype=float)
            assert np.allclose(found, want, atol=1e-8, equal_nan=True)


def test_series_refuse_gaps_and_nulls(spark):
    gap = spark.createDataFrame([(0, 1, 1.0), (0, 3, 2.0)], "seg long, no long, x double")
    with pytest.raises(Exception, match="segment 0: positions after 0 have a gap"):
        SE.ewma_series(gap, (3,)).collect()
    null = spark.createDataFrame([(0, 1, 1.0), (0, 2, None)], "seg long, no long, x double")
    with pytest.raises(Exception, match="NULL value in segment 0 at position 2"):
        SE.cumulative_series(null).collect()


# ---------------------------------------------------------------- sketches
def test_upper_levels_come_from_the_sketches(spark, scratch, plan_text):
    x = RNG.gamma(2.0, 3.0, 40_000)
    df = spark.createDataFrame(pd.DataFrame({"seg": np.repeat(np.arange(4), 10_000), "no": np.tile(np.arange(1, 10_001), 4), "x": x}))
    SK.bucket_sketches(df, 500, size=200).write.parquet(scratch + "/t")
    stored = spark.read.parquet(scratch + "/t")
    quantiles = {"p02": 0.02, "p50": 0.5, "p98": 0.98}
    segments = SK.merged_sketches(stored, ["seg"])
    whole = SK.merged_sketches(segments)
    for level, keys in ((stored, ["seg", "seq"]), (segments, ["seg"]), (whole, [])):
        source = df.withColumn("seq", A.bucket_number(F.col("no"), 500)) if "seq" in keys else df
        off = SK.ranks(source, level, quantiles, keys)
        worst = off.agg(*(F.max(q).alias(q) for q in quantiles)).first()
        assert max(worst) <= 2 * SK.rank_error(200)
    assert whole.first().n == 40_000
    plan = plan_text(SK.sketch_quantiles(whole, quantiles))
    assert "x_sketch" in plan and plan.count("FileScan") == 1 and "ReadSchema: struct<seg:bigint,n:bigint,x_sketch:binary,xa_sketch:binary>" in plan
    # a sketch of some thousand values takes a few KB
    assert segments.select(F.max(F.length("x_sketch"))).first()[0] < 10_000


def test_small_and_empty_sketches(spark):
    df = spark.createDataFrame([(0, 1, 5.0), (0, 2, None), (0, 3, -7.0), (1, 1, None)], "seg long, no long, x double")
    got = rows_of(SK.sketch_quantiles(SK.merged_sketches(SK.bucket_sketches(df, 2), ["seg"]), {"p0": 0.0, "p50": 0.5, "p1": 1.0}, {"p1": 1.0}), "seg")
    assert (got[0,].n, got[0,].x_p0, got[0,].x_p50, got[0,].x_p1, got[0,].xa_p1) == (2, -7.0, -7.0, 5.0, 7.0)
    assert got[1,].n == 0 and got[1,].x_p50 is None


# ----------------------------------------------------------------- pyramid
def test_cover_is_a_partition():
    rng = np.random.default_rng(1)
    for _ in range(500):
        base, top = int(rng.integers(0, 5)), int(rng.integers(5, 9))
        first = int(rng.integers(0, 900))
        last = first + int(rng.integers(0, 900))
        blocks, edges = PY.cover(first, last, base, top)
        covered = sorted([(b << k, ((b + 1) << k) - 1) for k, b in blocks] + edges)
        assert covered[0][0] == first and covered[-1][1] == last and all(a[1] + 1 == b[0] for a, b in zip(covered, covered[1:]))
        assert len(blocks) <= 2 * (top - base) + (900 >> top) + 2 and sum(b - a + 1 for a, b in edges) < 2 << base


def test_range_stats(spark, scratch, segment_frame):
    x = [RNG.normal(5, 2, n) for n in (3000, 700)]
    df = segment_frame(*x)
    pyramid = PY.build_pyramid(df, f"{scratch}/p", base=5)
    assert pyramid.agg(F.max("level")).first()[0] == 12
    rng = np.random.default_rng(2)
    spans = [(int(s), *sorted(int(v) for v in rng.integers(1, len(x[s]) + 1, 2))) for s in rng.integers(0, 2, 60)]
    spans += [(0, 1, 3000), (1, 650, 900), (1, 800, 900), (0, 33, 64), (0, 10, 9)]
    ranges = spark.createDataFrame([(f"r{i}", *r) for i, r in enumerate(spans)], "id string, seg long, first long, last long")
    got = rows_of(PY.range_stats(df, pyramid, ranges, base=5), "id")
    assert len(got) == len(spans)
    for i, (s, a, b) in enumerate(spans):
        r, part = got[f"r{i}",], x[s][a - 1:b]
        assert r.n == len(part)
        if len(part):
            want = [part.mean(), part.std(ddof=1) if len(part) > 1 else None, part.min(), part.max()]
            assert [r.avg, r.std, r.min, r.max] == [None if v is None else pytest.approx(v, rel=1e-7, abs=1e-7) for v in want]
            assert r.raw_rows < 64 and r.blocks <= 2 * 8
        else:
            assert r.avg is None and r.max is None
    assert got["r60",].raw_rows < 32 and got["r60",].blocks > 3


# ------------------------------------------------------------------ running
def test_running_features(spark, segment_frame):
    df = segment_frame(*SEGMENTS, [0.0, -1.0, 0.0, 2.0, 2.0, -3.0])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = rows_of(RU.running_features(df), "seg")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for s, values in enumerate(SEGMENTS):
        r, signs = got[s,], np.sign(values)
        assert r.n == len(values)
        assert r.energy == pytest.approx((values**2).sum()) and r.peak == abs(values).max()
        assert r.crossings == (signs[1:] != signs[:-1]).sum() and r.travel == pytest.approx(abs(np.diff(values)).sum())
    assert (got[5,].crossings, got[5,].travel) == (2.0, 9.0)


def test_running_features_in_sql(spark, segment_frame):
    class Low:
        def __init__(self):
            self.low = None

        def add(self, values):
            self.low = float(values.min()) if self.low is None else min(self.low, float(values.min()))

        def result(self):
            return self.low

    RU.register_features(spark, "lowest", {"low": Low}, "string")
    spark.createDataFrame([("a", 1, 3.0), ("a", 2, None), ("a", 3, -1.0), ("b", 1, None)], "seg string, no long, x double").createOrReplaceTempView("t_run")
    got = spark.sql("SELECT * FROM lowest(TABLE(t_run) PARTITION BY seg ORDER BY no)").collect()
    assert sorted((r.seg, r.n, r.low) for r in got) == [("a", 3, -1.0), ("b", 1, None)]


# ------------------------------------------------- many short runs at once
def batches_of(table, size):
    return iter(table.to_batches(max_chunksize=size))


def test_complete_groups_over_batches():
    table = pa.table({"k": ["a"] * 5 + ["b"] * 2 + [None] * 6 + ["c"], "g": [0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2], "v": range(14)})
    for size in (1, 2, 3, 5, 14):
        found = list(LS.whole_groups(batches_of(table, size), 2))
        parts = [p for rows, starts in found for p in np.split(np.array(rows.column("v").to_pylist()), starts[1:])]
        assert [p.tolist() for p in parts] == [[0, 1], [2, 3, 4], [5, 6], [7, 8, 9, 10], [11, 12], [13]]
    assert len(list(LS.whole_groups(batches_of(table, 14), 2))) == 2  # all complete groups of a batch together


def test_runs_are_scanned_together():
    place = np.concatenate([np.arange(n) for n in (5, 64, 1, 300)])
    x = RNG.normal(size=(len(place), 3))
    want = x.copy()
    for i in np.flatnonzero(place):
        want[i] += np.array([0.9, 1.0, 0.01]) * want[i - 1]
    assert np.allclose(SE.scan_runs([0.9, 1.0, 0.01], x.copy(), place), want, rtol=1e-12, atol=1e-12)


def test_no_python_call_for_each_chunk(spark, segment_frame, plan_text):
    df = segment_frame(*SEGMENTS)
    for out in (SE.cumulative_series(df, chunk_rows=16, chunks=3), SE.ewma_series(df, [5], chunk_rows=16, chunks=3), LS.long_envelope_mean(df, chunk=16)):
        assert "FlatMapGroups" not in plan_text(out) and "MapInArrow" in plan_text(out)


def test_series_over_batch_borders(spark, segment_frame):
    """Runs that go on in the next Arrow batch carry their value over."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = rows_of(SE.ewma_series(segment_frame(*SEGMENTS), [5], chunk_rows=32, chunks=2), "seg", "no")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for s, values in enumerate(SEGMENTS):
        want = pd.Series(values).ewm(span=5).mean()
        assert np.allclose([got[s, i + 1].ewma_5 for i in range(len(values))], want, rtol=1e-9)
