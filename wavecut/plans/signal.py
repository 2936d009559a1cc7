"""The signal that the registered queries read from ``events``, and their parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecut.operators.segments import drop_partial_tail, segment_label, with_segments


@dataclass(frozen=True)
class Params:
    """Widths, lags and cuts.  The defaults are fixed values for segments of 150,000 rows."""

    seg_len: int = 150_000
    slice_len: int = 15_000
    n_slices: int = 10
    n_windows: int = 8
    per_window: int = 3
    bucket: int = 1000
    target_positions: tuple[int, ...] = (45000, 60000, 75000, 90000, 105000, 120000, 135000, 150000)
    cut: int = 40_000
    window_cut: int = 12_000
    bands: dict = field(default_factory=lambda: {"count": 99, "step": 400, "width": 800, "divisor": 800})
    window_bands: dict = field(default_factory=lambda: {"count": 99, "step": 120, "width": 240, "divisor": 120})
    band_slice: tuple[int, int] = (50, 75)
    wide_band_slice: tuple[int, int] = (43, 98)
    mean_widths: tuple[int, ...] = (700, 1500, 3000, 6000)
    std_widths: tuple[int, ...] = (700, 400, 1000)
    extrema_widths: tuple[int, ...] = (10, 50, 100, 500, 1000, 10000)
    ewma_spans: tuple[int, ...] = (300, 3000, 6000)
    sta_lta: tuple[tuple[int, int], ...] = ((500, 10000), (5000, 100000), (3333, 6666), (10000, 25000))
    lags: tuple[int, ...] = (10, 100, 1000, 10000)
    head_tail: tuple[int, ...] = (50000, 10000)
    hann: tuple[int, ...] = (50, 150, 1500, 15000)
    fft_bins: tuple[int, int] = (1000, 20000)
    fft_last: int = 5000
    sample_step: int = 50


FULL = Params()

# Parameters of the registered queries: segments of 500 rows.
SMALL = Params(
    seg_len=500,
    slice_len=50,
    bucket=25,
    target_positions=(150, 200, 250, 300, 350, 400, 450, 500),
    cut=132,
    window_cut=40,
    bands={"count": 10, "step": 12, "width": 24, "divisor": 24},
    window_bands={"count": 9, "step": 4, "width": 8, "divisor": 4},
    band_slice=(3, 6),
    wide_band_slice=(2, 8),
    mean_widths=(5, 10, 20, 40),
    std_widths=(5, 4, 8),
    extrema_widths=(2, 3, 5, 10, 25, 50),
    ewma_spans=(3, 10, 20),
    sta_lta=((5, 50), (20, 300), (11, 22), (33, 83)),
    lags=(1, 2, 5, 30),
    head_tail=(166, 33),
    hann=(4, 5, 10, 50),
    fft_bins=(4, 67),
    fft_last=17,
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def seconds_to_midnight(ts: Column) -> Column:
    """A falling sawtooth computed from the row alone, the shape of a time-to-failure target."""
    return (F.lit(86400) - F.hour(ts) * 3600 - F.minute(ts) * 60 - F.floor(F.second(ts))).cast("double")


def event_signal(spark: SparkSession, sf_dir: str, seg_len: int = SMALL.seg_len) -> DataFrame:
    """``uid, idx, seg, no, x, y`` of every event.

    ``event_id`` is a gap-free order, so numbering needs no shuffle and a segment
    holds at most ``seg_len`` rows.
    """
    return as_signal(events(spark, sf_dir), seg_len)


def as_signal(table: DataFrame, seg_len: int) -> DataFrame:
    rows = table.select(
        F.col("event_id").alias("uid"),
        (F.col("event_id") + 1).alias("idx"),
        (F.col("value") - 50.0).alias("x"),
        seconds_to_midnight(F.col("ts")).alias("y"),
    )
    return with_segments(rows, seg_len)


def row_count(table: DataFrame) -> DataFrame:
    """One-row count, answered from the Parquet footers."""
    return table.agg(F.count(F.lit(1)).alias("n"))


def full_segments(spark: SparkSession, sf_dir: str, seg_len: int = SMALL.seg_len) -> DataFrame:
    """The signal without its partial last segment."""
    table = events(spark, sf_dir)
    return drop_partial_tail(as_signal(table, seg_len), seg_len, row_count(table))


def train_cut(spark: SparkSession, sf_dir: str, seg_len: int = SMALL.seg_len) -> Column:
    """Number of training segments: the first three quarters of the full ones."""
    total = row_count(events(spark, sf_dir)).scalar()
    return F.floor(F.floor(total / seg_len) * 0.75)


def labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("name", segment_label(F.col("seg")))
