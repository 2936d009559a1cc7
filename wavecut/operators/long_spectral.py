"""Fourier features of segments that do not fit a task: the four-step transform.

The n samples of a segment are read as a matrix of n1 rows and n2 columns.  Chunks of columns are transformed along
the rows' direction, each in a task, and multiplied by the twiddle factors; an exchange brings the rows together, and
chunks of rows are transformed along the columns.  Bin k1 + n1 * k2 comes out at row k1, place k2, and only the wanted
bins are emitted.  A length without a fitting divisor goes through a chirp convolution over a power of two (three such
transforms).  No transform takes more than ``chunk`` samples, or one row or column where that is longer; a task goes
through sorted chunks batch by batch and transforms all complete ones of a batch at once.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecut.operators.segments import KEYS, complete_values, segment_counts, union_sets
from wavecut.operators.series import run_changes
from wavecut.operators.stats import adjusted_kurtosis, adjusted_skew
from wavecut.sources.storage import BROADCAST_ROWS, cut_lineage, join_small

# Workers get this module with the job and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1 << 20
#: Samples of several chunks that are transformed at once.
TOGETHER = 1 << 20


def factors(n: int, chunk: int) -> tuple[int, int] | None:
    """The divisors of n closest to each other, the smaller first; None if the larger is above ``chunk``."""
    for d in range(math.isqrt(n), 0, -1):
        if n % d == 0:
            return (d, n // d) if n // d <= chunk else None
    return None


def padded(n: int) -> int:
    """Length of the chirp convolution: a power of two."""
    return 1 << (2 * n - 2).bit_length()


def plans(counts: DataFrame, keys: Sequence[str], chunk: int) -> DataFrame:
    """``keys, n`` -> with ``m`` (length of the transforms) and its factors ``n1, n2``; ``chirp`` where m is not n."""
    types = ", ".join(f"`{k}` {counts.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for n in frame["n"].tolist():
                direct = factors(n, chunk)
                m = n if direct else padded(n)
                n1, n2 = direct or factors(m, m)
                if n2 > chunk:
                    raise ValueError(f"a segment of {n} rows needs chunk={n2} at least")
                found.append((m, n1, n2, direct is None))
            yield frame.assign(**{c: [f[i] for f in found] for i, c in enumerate(("m", "n1", "n2", "chirp"))})

    return counts.mapInPandas(run, f"{types}, n long, m long, n1 long, n2 long, chirp boolean")


def whole_groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by the first ``width`` columns -> rows of complete groups and the places where these begin."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        heads = batch.columns[:width]
        if held:
            heads = [pa.concat_arrays([x.slice(len(x) - 1), y]) for x, y in zip(held[-1].columns, heads)]
        first = np.flatnonzero(run_changes(heads)[-batch.num_rows:] if held else run_changes(heads))
        if len(first):
            if held or first[-1]:
                yield _joined([*held, batch.slice(0, int(first[-1]))], width)
            held = []
        held.append(batch.slice(int(first[-1])) if len(first) else batch)
    if held:
        yield _joined(held, width)


def _joined(batches: list[pa.RecordBatch], width: int) -> tuple[pa.RecordBatch, np.ndarray]:
    rows = batches[0] if len(batches) == 1 else pa.concat_batches(batches)
    return rows, np.flatnonzero(run_changes(rows.columns[:width]))


def alike(rows: pa.RecordBatch, starts: np.ndarray, most) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int, int]]]:
    """Groups of one shape ``m, n1, n2``, as many as ``most(n1, n2)``: their first rows, all rows, the rows' group, the shape."""
    lengths = np.diff(np.append(starts, rows.num_rows))
    shapes = np.stack([rows.column(c).to_numpy()[starts] for c in ("m", "n1", "n2")], axis=1)
    for shape in np.unique(shapes, axis=0):
        same, (m, n1, n2) = np.flatnonzero((shapes == shape).all(axis=1)), shape.tolist()
        for at in range(0, len(same), step := most(n1, n2)):
            part = same[at:at + step]
            n = lengths[part]
            own = np.repeat(np.arange(len(part)), n)
            yield starts[part], np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + starts[part][own], own, (m, n1, n2)


def transform(
    samples: DataFrame, keys: Sequence[str], chunk: int, wanted: Column | None = None, inverse: bool = False
) -> DataFrame:
    """``keys, m, n1, n2, i, re, im`` -> the same with ``i`` the bin; missing samples are 0.

    ``wanted``: a condition on ``m`` and ``i`` for the bins to be put out.  ``inverse`` divides by m.
    """
    sign = 1.0 if inverse else -1.0
    types = {k: samples.schema[k].dataType.simpleString() for k in keys}
    head = ", ".join(f"`{k}` {t}" for k, t in types.items())
    named = [*keys, "m", "n1", "n2"]

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Transforms of chunks of columns with their twiddle factors, cut up by the chunk of rows that needs them."""
        for rows, starts in whole_groups(batches, len(keys) + 1):
            g, i, re, im = (rows.column(c).to_numpy() for c in ("g", "i", "re", "im"))
            most = lambda n1, n2: max(1, TOGETHER // (n1 * max(1, chunk // n1)))
            for begin, at, own, (m, n1, n2) in alike(rows, starts, most):
                wide, high = min(n2, max(1, chunk // n1)), min(n1, max(1, chunk // n2))
                if (i[at] < 0).any() or (i[at] >= m).any():
                    raise ValueError(f"a position is not within the {m} samples of its segment")
                block = np.zeros((len(begin), n1, wide), dtype=complex)
                block[own, i[at] // n2, i[at] % n2 - g[at] * wide] = re[at] + 1j * im[at]
                block = np.fft.fft(block, axis=1) if sign < 0 else np.fft.ifft(block, axis=1) * n1
                groups, of = np.unique(g[begin], return_inverse=True)
                places = np.minimum(groups[:, None] * wide + np.arange(wide), n2 - 1)
                turns = np.arange(n1, dtype=np.int64)[None, :, None] * places[:, None, :] % m
                block *= np.exp(sign * 2j * np.pi * turns / m)[of]
                first = g[begin] * wide
                width = np.minimum(wide, n2 - first)
                flat = block[np.broadcast_to(np.arange(wide) < width[:, None, None], block.shape)]
                heights = np.diff(np.append(np.arange(0, n1, high), n1))
                ends = pa.array(np.concatenate([[0], np.cumsum(width[:, None] * heights)]).astype(np.int32))
                from_ = pa.array(np.repeat(begin, len(heights)))
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c).take(from_) for c in named), pa.array(np.tile(np.arange(len(heights)), len(begin))), pa.array(np.repeat(first, len(heights))),
                     pa.ListArray.from_arrays(ends, pa.array(flat.real)), pa.ListArray.from_arrays(ends, pa.array(flat.imag))],
                    names=[*named, "h", "first", "re", "im"],
                )

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Transforms of chunks of rows."""
        for rows, starts in whole_groups(batches, len(keys) + 1):
            h, first = (rows.column(c).to_numpy() for c in ("h", "first"))
            ends = np.concatenate([[0], np.cumsum(rows.column("re").value_lengths().to_numpy())])
            re, im = (rows.column(c).flatten().to_numpy() for c in ("re", "im"))
            most = lambda n1, n2: max(1, TOGETHER // (n2 * max(1, chunk // n2)))
            for begin, at, own, (m, n1, n2) in alike(rows, starts, most):
                high = min(n1, max(1, chunk // n2))
                height = np.minimum(high, n1 - h[begin] * high)
                sizes = ends[at + 1] - ends[at]
                row = np.repeat(np.arange(len(at)), sizes)
                place = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
                of, width = place + ends[at][row], (sizes // height[own])[row]
                block = np.zeros((len(begin), high, n2), dtype=complex)
                block[own[row], place // width, first[at][row] + place % width] = re[of] + 1j * im[of]
                block = np.fft.fft(block, axis=2) if sign < 0 else np.fft.ifft(block, axis=2) * n2
                if inverse:
                    block /= m
                lower = h[begin, None] * high + np.arange(high)
                bins = lower[:, :, None] + n1 * np.arange(n2, dtype=np.int64)
                there = np.broadcast_to((np.arange(high) < height[:, None])[:, :, None], block.shape)
                flat, from_ = block[there], pa.array(np.repeat(begin, height * n2))
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c).take(from_) for c in named), pa.array(bins[there]), pa.array(flat.real), pa.array(flat.imag)],
                    names=[*named, "i", "re", "im"],
                )

    def sorted_by(rows: DataFrame, part: str) -> DataFrame:
        return rows.repartition(*keys, part).sortWithinPartitions(*keys, part)

    group = F.floor(F.pmod("i", "n2") / F.greatest(F.lit(1), F.floor(F.lit(chunk) / F.col("n1"))))
    cut = sorted_by(samples.select(*keys, group.alias("g"), "m", "n1", "n2", "i", "re", "im"), "g")
    blocks = cut.mapInArrow(columns, f"{head}, m long, n1 long, n2 long, h long, first long, re array<double>, im array<double>")
    cut = sorted_by(blocks.select(*keys, "h", "m", "n1", "n2", "first", "re", "im"), "h")
    out = cut.mapInArrow(lines, f"{head}, m long, n1 long, n2 long, i long, re double, im double")
    return out if wanted is None else out.where(wanted)


def times(re: Column, im: Column, angle: Column) -> dict[str, Column]:
    """Complex product with exp(i * angle)."""
    c, s = F.cos(angle), F.sin(angle)
    return {"re": re * c - im * s, "im": re * s + im * c}


def chirp_angle(i: Column, n: Column) -> Column:
    return F.pmod(i * i, 2 * n) * F.lit(math.pi) / n


def fourier(
    samples: DataFrame, planned: DataFrame, keys: Sequence[str], chunk: int, wanted: Column | None = None, inverse: bool = False
) -> DataFrame:
    """``keys, i, re, im`` with the plan's columns -> ``keys, n, i, re, im`` of the wanted bins, ``i < n``."""
    inside = F.col("i") < F.col("n") if wanted is None else wanted & (F.col("i") < F.col("n"))
    of_n = planned.select(*keys, "n")
    kinds = {r.chirp for r in planned.select("chirp").distinct().collect()}
    direct = transform(samples.where(~F.col("chirp")), keys, chunk, inverse=inverse)
    direct = join_small(direct, of_n, keys).where(inside).select(*keys, "n", "i", "re", "im")
    if True not in kinds:
        return direct
    # A transform of n samples as a convolution with a chirp, over m >= 2n - 1 samples.
    turn = 1 if inverse else -1
    chirped = samples.where("chirp").withColumns(times(F.col("re"), F.col("im"), turn * chirp_angle(F.col("i"), F.col("n"))))
    a = transform(chirped, keys, chunk)
    lengths = cut_lineage(planned.where("chirp").select("n", "m", "n1", "n2").distinct())
    steps = lengths.withColumn("t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    value = times(F.lit(1.0), F.lit(0.0), -turn * chirp_angle(F.col("t"), F.col("n")))
    kernel = steps.withColumn("i", F.explode(F.array_distinct(F.array("t", F.pmod(-F.col("t"), F.col("m")))))).withColumns(value)
    b = cut_lineage(transform(kernel.withColumn("_n", F.col("n")), ["_n"], chunk).select(
        F.col("_n").alias("n"), "i", F.col("re").alias("_re"), F.col("im").alias("_im")
    ))
    few = b.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    product = join_small(a, of_n, keys).join(F.broadcast(b) if few else b, ["n", "i"]).withColumns(
        {"re": F.col("re") * F.col("_re") - F.col("im") * F.col("_im"), "im": F.col("re") * F.col("_im") + F.col("im") * F.col("_re")}
    )
    back = join_small(transform(product.select(*keys, "m", "n1", "n2", "i", "re", "im"), keys, chunk, inverse=True), of_n, keys).where(inside)
    done = back.withColumns(times(F.col("re"), F.col("im"), turn * chirp_angle(F.col("i"), F.col("n"))))
    if inverse:
        done = done.withColumns({"re": F.col("re") / F.col("n"), "im": F.col("im") / F.col("n")})
    done = done.select(*keys, "n", "i", "re", "im")
    return direct.union(done) if False in kinds else done


def _prepared(df: DataFrame, keys: Sequence[str], value: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    planned = cut_lineage(plans(segment_counts(df, keys), keys, chunk))
    rows = complete_values(df.select(*keys, "no", F.col(value).cast("double").alias("re")), "re", keys)
    samples = join_small(rows, planned, keys).select(*keys, "n", "m", "n1", "n2", "chirp", (F.col("no") - 1).alias("i"), "re", F.lit(0.0).alias("im"))
    return samples, planned


def long_spectrum(
    df: DataFrame, keys: Sequence[str] = KEYS, value: str = "x", wanted: Column | None = None, chunk: int = CHUNK
) -> DataFrame:
    """``keys, n, i, re, im``: bins of the Fourier transform; ``wanted`` is a condition on ``i`` and ``n``.

    Positions ``no`` run from 1 without gaps; a NULL value fails the job with its place.
    """
    samples, planned = _prepared(df, keys, value, chunk)
    return fourier(samples, planned, keys, chunk, wanted)


def long_fft_mag_stats(
    df: DataFrame, first_bin: int = 1000, end_bin: int = 20000, last_bins: int = 5000, keys: Sequence[str] = KEYS,
    value: str = "x", chunk: int = CHUNK,
) -> DataFrame:
    """The columns of ``fft_mag_stats`` from rows, for segments of any length.

    The last bins of a real signal mirror bins 1 .. ``last_bins``, so those are taken.
    """
    i, n = F.col("i"), F.col("n")
    band = (i >= first_bin) & (i < end_bin)
    last = F.when(n <= last_bins, i < last_bins).otherwise((i >= 1) & (i <= last_bins))
    bins = long_spectrum(df, keys, value, band | last, chunk)
    m = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    rows = bins.select(*keys, F.when(band, m).alias("b"), F.when(last, m).alias("l"))
    size = F.count("b").cast("double")
    return rows.groupBy(*keys).agg(
        F.avg("b").alias("fft_mag_mean"), F.stddev_pop("b").alias("fft_mag_std"),
        adjusted_kurtosis(F.kurtosis("b"), size).alias("fft_mag_kurt"), adjusted_skew(F.skewness("b"), size).alias("fft_mag_skew"),
        F.max("b").alias("fft_mag_max"), F.median("b").alias("fft_mag_median"),
        adjusted_skew(F.skewness("l"), F.count("l").cast("double")).alias("fft_mag_skew_last"),
    )


def long_envelope_mean(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "x", chunk: int = CHUNK) -> DataFrame:
    """Mean magnitude of the analytic signal, for segments of any length.

    The upper half of the spectrum is dropped and the lower one doubled before the way back.
    """
    samples, planned = _prepared(df, keys, value, chunk)
    i, n = F.col("i"), F.col("n")
    doubled = F.when((i == 0) | (2 * i == n), 1.0).otherwise(2.0)

    def there_and_back(kind: Column) -> DataFrame:
        own = planned.where(kind)
        lower = fourier(samples.where(kind), own, keys, chunk, 2 * i <= n)
        half = lower.select(*keys, "i", (F.col("re") * doubled).alias("re"), (F.col("im") * doubled).alias("im"))
        return fourier(join_small(half, own, keys), own, keys, chunk, inverse=True)

    # Each kind alone: the way back reads the spectra of its own segments only.
    kinds = [r.chirp for r in planned.select("chirp").distinct().collect()] or [False]
    back = union_sets(*(there_and_back(F.col("chirp") == F.lit(k)) for k in sorted(kinds)))
    return back.groupBy(*keys).agg(F.avg(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("envelope_mean"))
