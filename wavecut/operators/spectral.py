"""Cosine and Fourier spectra of packed segments, band features and scaling.

Every transform runs inside the JVM on one packed array per segment: the cosine
transform is Spark ML's ``DCT``, and Fourier magnitudes and the analytic signal
are derived from the cosine transform of a reordered signal, so no Python worker
sees the raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.feature import DCT, StandardScaler, StandardScalerModel, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecut.functions.arrays import array_slices, band_range, overlapping_band_means
from wavecut.operators.segments import KEYS
from wavecut.operators.stats import adjusted_kurtosis, adjusted_skew, pack_segments


# ------------------------------------------------------------------ packing
def pack_slices(
    df: DataFrame, slice_len: int = 15000, n_slices: int = 10, keys: Sequence[str] = KEYS,
    value: str = "x", shared_edge: bool = True,
) -> DataFrame:
    """``vx0 .. vx9``: one array per slice, from a single grouped pass.

    Positions are gap-free within a segment; a segment that goes on past the last slice fails the job.
    """
    packed = pack_segments(df, keys, value, max_len=slice_len * n_slices)
    slices = array_slices(F.col("values"), slice_len, n_slices, shared_edge)
    return packed.select(*keys, *(s.alias(f"vx{i}") for i, s in enumerate(slices)))


def slice_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("vx") and c[2:].isdigit()]


# --------------------------------------------------------------- transforms
def with_dct(df: DataFrame, source: str, out: str, cut: int | None = None, inverse: bool = False) -> DataFrame:
    """Orthonormal DCT-II (or its inverse) of an array column, optionally cut to the
    lowest ``cut`` coefficients."""
    vectors = df.withColumn("_vec", array_to_vector(source))
    done = DCT(inverse=inverse, inputCol="_vec", outputCol="_dct").transform(vectors)
    coefficients = vector_to_array("_dct")
    if cut is not None:
        coefficients = F.slice(coefficients, 1, cut)
    return done.withColumn(out, coefficients).drop("_vec", "_dct")


def low_frequency_spectrum(slices: DataFrame, cut: int = 40000, keys: Sequence[str] = KEYS) -> DataFrame:
    """Lowest coefficients of the concatenated slices of a segment, as array ``vx``."""
    joined = slices.select(*keys, F.concat(*slice_columns(slices)).alias("_all"))
    return with_dct(joined, "_all", "vx", cut).select(*keys, "vx")


def window_spectra(
    slices: DataFrame, n_windows: int = 8, per_window: int = 3, cut: int = 12000, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Low-frequency spectrum of each run of ``per_window`` slices: ``fs_w0 .. fs_w7``."""
    out = slices
    for j in range(n_windows):
        out = out.withColumn(f"_w{j}", F.concat(*(f"vx{j + i}" for i in range(per_window))))
        out = with_dct(out, f"_w{j}", f"fs_w{j}", cut)
    return out.select(*keys, *(f"fs_w{j}" for j in range(n_windows)))


def spectrum_pipeline(slice_cols: Sequence[str], cut: int = 40000, out: str = "vx") -> Pipeline:
    """The same path over vector columns as one persistable ML pipeline."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(slice_cols), outputCol="_joined"),
            DCT(inverse=False, inputCol="_joined", outputCol="_spectrum"),
            VectorSlicer(inputCol="_spectrum", outputCol="_low", indices=list(range(cut))),
            StandardScaler(inputCol="_low", outputCol=out, withStd=True, withMean=False),
        ]
    )


# ------------------------------------------------------------------ scaling
@dataclass(frozen=True)
class UnitScaler:
    """Unit-variance scaling without centring, for one or several array columns.

    All columns are fitted as one long vector, hence in one pass over the data.
    """

    model: StandardScalerModel
    columns: tuple[str, ...]
    lengths: tuple[int, ...]

    def transform(self, df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
        names = list(names or self.columns)
        scaled = self.model.transform(df.withColumn("_vec", array_to_vector(F.concat(*self.columns))))
        scaled = scaled.withColumn("_arr", vector_to_array("_scaled")).drop("_vec", "_scaled")
        start, out = 1, scaled
        for name, length in zip(names, self.lengths):
            out = out.withColumn(name, F.slice("_arr", start, length))
            start += length
        return out.drop("_arr")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        spark = SparkSession.active()
        rows = list(zip(range(len(self.columns)), self.columns, self.lengths))
        spark.createDataFrame(rows, "pos int, name string, length int").write.mode("overwrite").parquet(f"{path}/columns")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "UnitScaler":
        rows = spark.read.parquet(f"{path}/columns").orderBy("pos").collect()  # one row for each array column
        model = StandardScalerModel.load(f"{path}/model")
        return cls(model, tuple(r["name"] for r in rows), tuple(r["length"] for r in rows))


def fit_unit_scaler(train: DataFrame, columns: Sequence[str], lengths: Sequence[int]) -> UnitScaler:
    """Fits on the training segments (an action); zero-variance elements scale to 0."""
    vectors = train.select(array_to_vector(F.concat(*columns)).alias("_vec"))
    scaler = StandardScaler(inputCol="_vec", outputCol="_scaled", withStd=True, withMean=False)
    return UnitScaler(scaler.fit(vectors), tuple(columns), tuple(lengths))


@dataclass(frozen=True)
class ColumnScaler:
    """Centring and population-deviation scaling of scalar columns."""

    means: dict[str, float]
    stds: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        scaled = {}
        for c, mu in self.means.items():
            sd = self.stds[c]
            scaled[c] = (F.col(c) - F.lit(mu)) / F.lit(sd if sd and sd > 0 else 1.0)
        return df.withColumns(scaled)

    def save(self, path: str) -> None:
        rows = [(c, self.means[c], self.stds[c]) for c in self.means]
        SparkSession.active().createDataFrame(rows, "name string, mean double, std double").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ColumnScaler":
        rows = spark.read.parquet(path).orderBy("name").collect()  # one row for each column
        return cls({r["name"]: r["mean"] for r in rows}, {r["name"]: r["std"] for r in rows})


def fit_column_scaler(train: DataFrame, columns: Sequence[str]) -> ColumnScaler:
    """One aggregate row (two values per column) comes back to the driver."""
    aggs = [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]
    aggs += [F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]
    row = train.agg(*aggs).first()
    return ColumnScaler(
        {c: row[f"m{i}"] for i, c in enumerate(columns)},
        {c: row[f"s{i}"] for i, c in enumerate(columns)},
    )


# -------------------------------------------------------------------- bands
def with_bands(
    df: DataFrame, source: str = "vx", out: str = "f", count: int = 99, step: int = 400,
    width: int = 800, divisor: float = 800,
) -> DataFrame:
    return df.withColumn(out, overlapping_band_means(F.col(source), count, step, width, divisor))


def window_bands(
    spectra: DataFrame, n_windows: int = 8, count: int = 99, step: int = 120, width: int = 240,
    divisor: float = 120, keys: Sequence[str] = KEYS, prefix: str = "fn_w",
) -> DataFrame:
    """Band means ``f0 .. f7`` of every window.  The default divisor is half the width,
    the figure the downstream models were built on."""
    bands = [
        overlapping_band_means(F.col(f"{prefix}{j}"), count, step, width, divisor).alias(f"f{j}")
        for j in range(n_windows)
    ]
    return spectra.select(*keys, *bands)


def slice_bands(df: DataFrame, first: int = 50, last: int = 75, source: str = "f", out: str = "f") -> DataFrame:
    return df.withColumn(out, band_range(F.col(source), first, last))


def window_band_features(
    bands: DataFrame, first: int = 50, last: int = 75, n_windows: int = 8, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Band slices ``f_sl0 .. f_sl7`` of all windows and their concatenation ``f``."""
    sliced = [band_range(F.col(f"f{j}"), first, last).alias(f"f_sl{j}") for j in range(n_windows)]
    return bands.select(*keys, *sliced).withColumn("f", F.concat(*(f"f_sl{j}" for j in range(n_windows))))


# ------------------------------------------------------------------ Fourier
def _reordered(values: Column) -> Column:
    """Front half and reversed back half of an array, interleaved.

    With C the DCT-II sums of this sequence, the Fourier transform of the original
    one is ``exp(i*pi*k/2N) * (C[k] - i*C[N-k])``.
    """
    half = F.shiftright(F.size(values), 1)
    pairs = F.zip_with(
        F.slice(values, F.lit(1), half), F.slice(F.reverse(values), F.lit(1), half), lambda a, b: F.array(a, b)
    )
    middle = F.slice(values, half + 1, F.pmod(F.size(values), F.lit(2)))
    return F.concat(F.flatten(pairs), middle)


def _with_reordered_dct(packed: DataFrame) -> DataFrame:
    return with_dct(packed.withColumn("_y", _reordered(F.col("values"))), "_y", "_c")


def with_fft_magnitudes(packed: DataFrame, last_bin: int, out: str = "mags") -> DataFrame:
    """Adds |FFT| of bins ``0 .. last_bin`` of the packed ``values`` as an array."""
    return _magnitudes(_with_reordered_dct(packed), last_bin, out).drop("_y", "_c")


def _magnitudes(spectra: DataFrame, last_bin: int, out: str) -> DataFrame:
    c, n = F.col("_c"), F.size("_c")

    def magnitude(k: Column) -> Column:
        a, b = F.element_at(c, k + 1), F.element_at(c, n - k + 1)
        return F.when(k == 0, F.sqrt(n.cast("double")) * F.abs(F.element_at(c, 1))).otherwise(
            F.sqrt((a * a + F.when(k > 0, b * b)) * (n / 2))
        )

    return spectra.withColumn(out, F.transform(F.sequence(F.lit(0), F.least(F.lit(last_bin), n - 1)), magnitude))


def magnitude_columns(n: Column, first_bin: int, end_bin: int, last_bins: int, mags: str = "mags") -> dict[str, Column]:
    """Arrays behind the magnitude statistics: the bins ``[first_bin, end_bin)`` and the
    last ``last_bins`` bins.  A real signal has a mirrored spectrum, so the last bins
    hold the values of bins ``1 .. last_bins`` and are not computed again."""
    m = F.col(mags)
    whole = F.slice(m, 1, last_bins)
    mirrored = F.slice(m, 2, last_bins)
    return {
        "_band": F.slice(m, first_bin + 1, end_bin - first_bin),
        "_last": F.when(n <= last_bins, whole).otherwise(mirrored),
    }


def magnitude_stats(df: DataFrame, first_bin: int, end_bin: int, last_bins: int) -> DataFrame:
    """``mags`` -> the seven magnitude statistics, evaluated in the packed row."""
    arrays = df.withColumns(magnitude_columns(F.size("values"), first_bin, end_bin, last_bins))
    arrays = arrays.withColumns(
        {"_mb": array_mean(F.col("_band")), "_ml": array_mean(F.col("_last")), "_sb": F.array_sort("_band")}
    )
    arrays = arrays.withColumns(
        {f"_b{p}": central_moment(F.col("_band"), F.col("_mb"), p) for p in (2, 3, 4)}
        | {f"_l{p}": central_moment(F.col("_last"), F.col("_ml"), p) for p in (2, 3)}
    )
    size, tail = F.size("_band").cast("double"), F.size("_last").cast("double")
    stats = {
        "fft_mag_mean": F.col("_mb"),
        "fft_mag_std": F.sqrt("_b2"),
        "fft_mag_kurt": adjusted_kurtosis(_ratio(F.col("_b4"), F.col("_b2"), 2.0) - 3, size),
        "fft_mag_skew": adjusted_skew(_ratio(F.col("_b3"), F.col("_b2"), 1.5), size),
        "fft_mag_max": F.array_max("_band"),
        "fft_mag_median": sorted_median(F.col("_sb")),
        "fft_mag_skew_last": adjusted_skew(_ratio(F.col("_l3"), F.col("_l2"), 1.5), tail),
    }
    scratch = ["_band", "_last", "_mb", "_ml", "_sb", "_b2", "_b3", "_b4", "_l2", "_l3"]
    return arrays.withColumns(stats).drop(*scratch)


def array_mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values))


def central_moment(values: Column, mean: Column, power: int) -> Column:
    def term(v: Column) -> Column:
        d = v - mean
        out = d
        for _ in range(power - 1):
            out = out * d
        return out

    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + term(v))
    return F.when(F.size(values) > 0, total / F.size(values))


def _ratio(moment: Column, variance: Column, power: float) -> Column:
    return F.when(variance > 0, moment / F.pow(variance, F.lit(power)))


def sorted_median(values: Column) -> Column:
    n = F.size(values)
    low = F.floor((n - 1) / 2).cast("int") + 1
    high = F.floor(n / 2).cast("int") + 1
    return F.when(n > 0, (F.element_at(values, low) + F.element_at(values, high)) / 2)


def sorted_quantile(values: Column, p: float) -> Column:
    """Interpolated quantile of a sorted array; NULL for an empty one."""
    position = F.lit(float(p)) * (F.size(values) - 1)
    low = F.floor(position).cast("int")
    part = position - low
    a, b = F.element_at(values, low + 1), F.element_at(values, F.ceil(position).cast("int") + 1)
    return F.when(F.size(values) > 0, a * (1 - part) + b * part)


def fft_mag_stats(
    packed: DataFrame, first_bin: int = 1000, end_bin: int = 20000, last_bins: int = 5000,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Mean, deviation, shape, maximum and median of the magnitudes in
    ``[first_bin, end_bin)`` and the skewness of the last ``last_bins`` bins."""
    mags = with_fft_magnitudes(packed, max(end_bin - 1, last_bins))
    return magnitude_stats(mags, first_bin, end_bin, last_bins).drop("values", "mags")


def with_envelope_mean(spectra: DataFrame) -> DataFrame:
    """Adds ``envelope_mean`` from the reordered signal ``_y`` and its transform ``_c``.

    In the cosine domain of the reordered signal the quadrature component has the
    coefficients ``-C[N-k]`` below and ``+C[N-k]`` above N/2; the mean does not
    depend on the order of the values, so it is taken without undoing the reordering.
    """
    c, n = F.col("_c"), F.size("_c")
    below = F.shiftright(n - 1, 1)  # number of coefficients strictly below N/2
    mirrored = F.reverse(F.slice(c, F.lit(2), n - 1))
    quadrature = F.concat(
        F.array(F.lit(0.0)),
        F.transform(F.slice(mirrored, F.lit(1), below), lambda v: -v),
        F.array_repeat(F.lit(0.0), F.pmod(n + 1, F.lit(2))),
        F.slice(mirrored, n - below, below),
    )
    both = with_dct(spectra.withColumn("_d", quadrature), "_d", "_q", inverse=True)
    envelope = F.zip_with("_y", "_q", lambda a, b: F.sqrt(a * a + b * b))
    return both.withColumn("envelope_mean", array_mean(envelope)).drop("_d", "_q")


def envelope_mean(packed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean magnitude of the analytic signal."""
    return with_envelope_mean(_with_reordered_dct(packed)).select(*keys, "envelope_mean")


def with_fourier_features(packed: DataFrame, first_bin: int, end_bin: int, last_bins: int) -> DataFrame:
    """Magnitude statistics and envelope mean from one shared transform."""
    spectra = with_envelope_mean(_with_reordered_dct(packed))
    mags = _magnitudes(spectra, max(end_bin - 1, last_bins), "mags").drop("_y", "_c")
    return magnitude_stats(mags, first_bin, end_bin, last_bins).drop("mags")
