"""Feature pipelines: the wide per-segment feature table and the spectral band tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecut.operators import rolling as R
from wavecut.operators import spectral as V
from wavecut.operators.segments import KEYS, complete_values
from wavecut.operators.stats import (
    ABS_QUANTILES,
    SIGNED_QUANTILES,
    adjusted_kurtosis,
    adjusted_skew,
    head_tail_aggs,
    pack_segments,
    summarise,
)
from wavecut.plans.signal import FULL, Params
from wavecut.sources.storage import cut_lineage


def summed_features(df: DataFrame, p: Params = FULL, keys: Sequence[str] = KEYS) -> DataFrame:
    """Features that are sums over rows with ``n``, the length of their segment."""
    rows = R.with_ewma_weights(df, p.ewma_spans)
    x, xa = F.col("x"), F.abs("x")
    size = F.count(x).cast("double")
    sums = rows.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max(xa).alias("abs_max"),
        F.avg(xa).alias("abs_mean"),
        F.stddev_samp(xa).alias("abs_std"),
        F.regr_slope(xa, F.col("no").cast("double")).alias("abs_trend"),
        adjusted_kurtosis(F.kurtosis(x), size).alias("kurt"),
        adjusted_skew(F.skewness(x), size).alias("skew"),
        *(c.alias(a) for a, c in head_tail_aggs(p.head_tail).items()),
        *(R.hann_mean_agg(w).alias(f"hann_{w}_mean") for w in p.hann),
        *(R.rolling_mean_agg(w).alias(f"ma_{w}_mean") for w in p.mean_widths),
        *(c.alias(a) for a, c in R.ewma_aggs(p.ewma_spans).items()),
    )
    names = [f"ewma_{s}_mean" for s in p.ewma_spans]
    return R.ewma_finish(sums, p.ewma_spans, names).drop("n")


def with_quantile_features(packed: DataFrame) -> DataFrame:
    """Quantiles of the packed ``values`` and of their absolute values, picked from the sorted arrays."""
    sorted_ = packed.withColumns(
        {"_s": F.array_sort("values"), "_sa": F.array_sort(F.transform("values", F.abs))}
    )
    picks = {f"abs_q{q:02d}": V.sorted_quantile(F.col("_sa"), q / 100) for q in ABS_QUANTILES}
    picks |= {f"q{q:02d}": V.sorted_quantile(F.col("_s"), q / 100) for q in SIGNED_QUANTILES}
    picks["med"] = V.sorted_quantile(F.col("_s"), 0.5)
    picks["iqr"] = V.sorted_quantile(F.col("_s"), 0.75) - V.sorted_quantile(F.col("_s"), 0.25)
    return sorted_.withColumns(picks).drop("_s", "_sa")


def ordered_features(df: DataFrame, p: Params = FULL, keys: Sequence[str] = KEYS) -> DataFrame:
    """Features that look at earlier or later rows: one shuffle and one sort of the signal."""
    o = R.ordered_rows(df, 1, keys, seg_len=p.seg_len)
    widths = [*p.extrema_widths, *p.std_widths]
    energy_frames = [w for pair in p.sta_lta for w in pair]
    around = (
        R.earlier_totals(o.window, "_s1", widths)
        | R.earlier_totals(o.window, "_s2", widths)
        | R.earlier_totals(o.window, "_e", energy_frames)
        | {f"_l{k}": F.lag("x", k).over(o.window) for k in p.lags}
        | {"_next": F.lead("x", 1).over(o.window)}
    )
    rows = R.with_prefix_sums(o).withColumns(around)
    aggs: dict[str, Column] = {
        **{f"autocorrelation_{k}": R.autocorrelation_agg(f"_l{k}", k) for k in p.lags},
        **R.change_rate_aggs(p.head_tail),
        "mad": F.avg(F.abs(F.col("x") - F.col("mu"))),
        **R.sta_lta_aggs(p.sta_lta),
        **{f"ma_{w}_std_mean": R.rolling_std_agg(w) for w in p.std_widths},
        **R.extrema_aggs(p.extrema_widths),
    }
    return summarise(rows, keys, aggs)


def packed_features(df: DataFrame, p: Params = FULL, keys: Sequence[str] = KEYS) -> DataFrame:
    """Quantiles, magnitude statistics and envelope mean of the packed segment (``p.seg_len`` rows at most)."""
    packed = with_quantile_features(pack_segments(df, keys, max_len=p.seg_len))
    return V.with_fourier_features(packed, *p.fft_bins, p.fft_last).drop("values")


def signal_features(df: DataFrame, p: Params = FULL, keys: Sequence[str] = KEYS) -> DataFrame:
    """All per-segment signal features (``keys, no, x``), of full and partial segments alike.

    Three grouped passes, joined on the segment with one row each, all start from one exchange by
    segment: raw rows are read and shuffled once.  ``p.seg_len`` bounds the length of a segment; the
    true one is counted.  A longer segment or a NULL value fails the job.
    """
    by_segment = complete_values(df.select(*keys, "no", "x"), "x", keys).repartition(*keys)
    counted = by_segment.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    wide = (
        summed_features(counted, p, keys)
        .join(ordered_features(by_segment, p, keys), list(keys))
        .join(packed_features(by_segment, p, keys), list(keys))
    )
    centre = F.col(f"ma_{p.mean_widths[0]}_mean")
    bounds = {}
    for w in p.std_widths[:2]:
        spread = F.col(f"ma_{w}_std_mean") * 2.0
        bounds[f"bb_{w}_high_mean"] = centre + spread
        bounds[f"bb_{w}_low_mean"] = centre - spread
    return wide.withColumns(bounds)


@dataclass(frozen=True)
class BandTables:
    """Scaled spectra and the fitted scaler, for training and scoring alike."""

    scaler: V.UnitScaler
    spectra: DataFrame


def scaled_spectrum(
    slices: DataFrame, cut: int, is_train: Column, keys: Sequence[str] = KEYS, folder: str | None = None
) -> BandTables:
    """Low-frequency spectrum ``vx`` scaled to unit variance over the training segments.

    The spectra are written once: the fit and the transform read them back instead of
    shuffling and transforming the signal twice.
    """
    raw = cut_lineage(V.low_frequency_spectrum(slices, cut, keys), folder and f"{folder}/spectrum")
    scaler = V.fit_unit_scaler(raw.where(is_train), ["vx"], [cut])
    return BandTables(scaler, scaler.transform(raw))


def scaled_windows(
    slices: DataFrame, p: Params, is_train: Column, keys: Sequence[str] = KEYS, folder: str | None = None
) -> BandTables:
    """Window spectra ``fn_w0 ..`` scaled over the training segments, one fit for all windows."""
    raw = cut_lineage(
        V.window_spectra(slices, p.n_windows, p.per_window, p.window_cut, keys), folder and f"{folder}/windows"
    )
    columns = [f"fs_w{j}" for j in range(p.n_windows)]
    scaler = V.fit_unit_scaler(raw.where(is_train), columns, [p.window_cut] * p.n_windows)
    scaled = scaler.transform(raw, [f"fn_w{j}" for j in range(p.n_windows)]).drop(*columns)
    return BandTables(scaler, scaled)


def band_table(
    slices: DataFrame, p: Params, is_train: Column, keys: Sequence[str] = KEYS, folder: str | None = None
) -> DataFrame:
    """``keys, f``: band means of the whole segment."""
    spectra = scaled_spectrum(slices, p.cut, is_train, keys, folder).spectra
    return V.with_bands(spectra, **p.bands).drop("vx")


def window_band_table(
    slices: DataFrame, p: Params, is_train: Column, keys: Sequence[str] = KEYS, folder: str | None = None
) -> DataFrame:
    """``keys, f0 .. f7``: band means of every window."""
    spectra = scaled_windows(slices, p, is_train, keys, folder).spectra
    return V.window_bands(spectra, p.n_windows, keys=keys, **p.window_bands)
