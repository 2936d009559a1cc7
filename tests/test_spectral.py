import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from wavecut.functions.arrays import overlapping_band_means, slice_bounds
from wavecut.operators import spectral as V
from wavecut.operators import stats as A
from wavecut.plans import features as P
from wavecut.plans.signal import FULL, SMALL


def signals(n, count=4, seed=11):
    return list(np.random.default_rng(seed).normal(1, 5, (count, n)))


def dct2(x):
    n = len(x)
    k = np.arange(n)[:, None]
    out = (x * np.cos(np.pi * k * (2 * np.arange(n) + 1) / (2 * n))).sum(1) * np.sqrt(2 / n)
    out[0] /= np.sqrt(2)
    return out


def envelope(x):
    n = len(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * h)).mean()


def test_full_size_slices_share_their_edges():
    lengths = [b - a + 1 for a, b in slice_bounds(FULL.slice_len, FULL.n_slices)]
    assert lengths == [15000] + [15001] * 9 and sum(lengths) == 150009
    assert [b - a + 1 for a, b in slice_bounds(15000, 10, shared_edge=False)] == [15000] * 10


def test_slices(segment_frame):
    x = np.arange(1.0, 51.0)
    row = V.pack_slices(segment_frame(x), 5, 10).first()
    assert row.vx0 == [1, 2, 3, 4, 5] and row.vx1 == [5, 6, 7, 8, 9, 10] and row.vx9 == [45, 46, 47, 48, 49, 50]
    flat = V.pack_slices(segment_frame(x), 5, 10, shared_edge=False).first()
    assert flat.vx1 == [6, 7, 8, 9, 10]


def test_hand_made_dct(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0, 7.0],)], "values array<double>")
    got = V.with_dct(df, "values", "c").first().c
    assert got == pytest.approx([7.0, -4.46088499, 1.0, -0.31702534])
    back = V.with_dct(V.with_dct(df, "values", "c"), "c", "b", inverse=True).first().b
    assert back == pytest.approx([1, 2, 4, 7])


def test_low_frequency_spectrum(segment_frame):
    x = signals(50)
    spec = V.low_frequency_spectrum(V.pack_slices(segment_frame(*x), 5, 10), 12)
    for r in spec.collect():
        parts = np.concatenate([x[r.seg][a - 1 : b] for a, b in slice_bounds(5, 10)])
        full = dct2(parts)
        assert r.vx == pytest.approx(list(full[:12]))
        assert np.sum(full**2) == pytest.approx(np.sum(parts**2))  # energy is kept


@pytest.mark.parametrize("n", [1, 2, 3, 8, 50, 51])
def test_fourier_from_cosines(segment_frame, n):
    x = signals(n)
    packed = A.pack_segments(segment_frame(*x))
    for r in V.with_fft_magnitudes(packed, n - 1).collect():
        assert r.mags == pytest.approx(list(np.abs(np.fft.fft(x[r.seg]))), abs=1e-9)
    for r in V.envelope_mean(packed).collect():
        assert r.envelope_mean == pytest.approx(envelope(x[r.seg]))


@pytest.mark.parametrize("bins", [(4, 20, 10), (0, 15, 40), (3, 100, 100)])
def test_magnitude_statistics(segment_frame, bins):
    first, end, last = bins
    x = signals(40)
    for r in V.fft_mag_stats(A.pack_segments(segment_frame(*x)), first, end, last).collect():
        m = np.abs(np.fft.fft(x[r.seg]))
        band, tail = pd.Series(m[first:end]), pd.Series(m[-last:])
        want = (band.mean(), m[first:end].std(), band.kurt(), band.skew(), band.max(), band.median(), tail.skew())
        got = (
            r.fft_mag_mean, r.fft_mag_std, r.fft_mag_kurt, r.fft_mag_skew, r.fft_mag_max, r.fft_mag_median,
            r.fft_mag_skew_last,
        )
        assert got == pytest.approx(want)


@pytest.mark.parametrize("step,width", [(4, 8), (3, 7), (5, 5)])
def test_bands(spark, step, width):
    v = signals(40, 1)[0]
    df = spark.createDataFrame([(v.tolist(),)], "v array<double>")
    got = df.select(overlapping_band_means(F.col("v"), 5, step, width, 3)).first()[0]
    assert got == pytest.approx([np.abs(v[i * step : i * step + width]).sum() / 3 for i in range(5)])
    assert min(got) >= 0


def test_unit_scaler_fits_on_train_only(spark):
    rows = [(i, [float(i), 5.0, float(i % 2)]) for i in range(8)]
    df = spark.createDataFrame(rows, "seg long, v array<double>")
    model = V.fit_unit_scaler(df.where("seg < 4"), ["v"], [3])
    out = np.array([r.v for r in model.transform(df).orderBy("seg").collect()])
    sd = np.std([0, 1, 2, 3], ddof=1)
    assert out[:, 0] == pytest.approx(np.arange(8) / sd)
    assert (out[:, 1] == 0).all()  # zero variance


def test_several_columns_scale_in_one_fit(spark):
    rows = [(i, [float(i)], [float(i * i), 1.0 * (-1) ** i]) for i in range(6)]
    df = spark.createDataFrame(rows, "seg long, a array<double>, b array<double>")
    out = V.fit_unit_scaler(df, ["a", "b"], [1, 2]).transform(df, ["sa", "sb"]).collect()
    assert np.std([r.sa[0] for r in out], ddof=1) == pytest.approx(1)
    assert np.std([r.sb[1] for r in out], ddof=1) == pytest.approx(1)


def test_column_scaler(spark):
    df = spark.createDataFrame([(0, 1.0, 7.0), (1, 3.0, 7.0), (2, 8.0, 7.0)], "seg long, a double, c double")
    out = V.fit_column_scaler(df, ["a", "c"]).transform(df).orderBy("seg").collect()
    a = np.array([1, 3, 8.0])
    assert [r.a for r in out] == pytest.approx(list((a - a.mean()) / a.std()))
    assert [r.c for r in out] == [0, 0, 0]


def test_ml_pipeline_equals_array_path(spark, segment_frame):
    slices = V.pack_slices(segment_frame(*signals(50)), 5, 10)
    arrays = P.scaled_spectrum(slices, 12, F.col("seg") < 3).spectra
    vectors = slices.select("seg", *(array_to_vector(c).alias(c) for c in V.slice_columns(slices)))
    model = V.spectrum_pipeline(V.slice_columns(slices), 12).fit(vectors.where("seg < 3"))
    piped = model.transform(vectors).select("seg", vector_to_array("vx").alias("vx"))
    want = {r.seg: r.vx for r in arrays.collect()}
    for r in piped.collect():
        assert r.vx == pytest.approx(want[r.seg])


def test_window_bands(segment_frame):
    x = signals(500, 3)
    slices = V.pack_slices(segment_frame(*x), SMALL.slice_len, SMALL.n_slices)
    bands = P.window_band_table(slices, SMALL, F.lit(True))
    joined = V.window_band_features(bands, *SMALL.band_slice)
    spectra = np.array(
        [
            [dct2(np.concatenate([s[a - 1 : b] for a, b in slice_bounds(50, 10)[j : j + 3]]))[:40] for j in range(8)]
            for s in x
        ]
    )
    scaled = spectra / spectra.std(axis=0, ddof=1)
    for r in joined.collect():
        want = [np.abs(scaled[r.seg, 2, 4 * i : 4 * i + 8]).sum() / 4 for i in range(3, 7)]
        assert r.f_sl2 == pytest.approx(want)
        assert len(r.f) == 32 and r.f[8:12] == r.f_sl2


def test_wide_feature_table(segment_frame):
    x = signals(500, 2)
    wide = P.signal_features(segment_frame(*x), SMALL).toPandas().set_index("seg")
    assert wide.shape == (2, 98) and not wide.isna().any().any()
    ser = pd.Series(x[1])
    assert wide.loc[1, "ma_4_std_mean"] == pytest.approx(ser.rolling(4).std().mean())
    assert wide.loc[1, "bb_4_low_mean"] == pytest.approx(ser.rolling(5).mean().mean() - 2 * ser.rolling(4).std().mean())
    assert wide.loc[1, "envelope_mean"] == pytest.approx(envelope(x[1]))


def test_wide_feature_table_shuffles_rows_once(spark, segment_frame, scratch, plan_text):
    segment_frame(*signals(500, 2)).write.parquet(f"{scratch}/t")
    lines = plan_text(P.ordered_features(spark.read.parquet(f"{scratch}/t"), SMALL)).splitlines()
    assert sum("Exchange hashpartitioning" in line for line in lines) == 1
    assert sum("Sort [" in line for line in lines) == 1
    assert not any("Python" in line for line in lines)
