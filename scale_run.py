"""Times the main operators on a synthetic signal of full-size segments.

``python scale_run.py [segments] [folder]`` writes ``segments`` x 150,000 rows made
with ``spark.range`` into a fresh folder (or reuses the given one) and prints one
line per operator.
"""

from __future__ import annotations

import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wavecut.operators import rolling as R
from wavecut.operators import segments as S
from wavecut.operators import spectral as V
from wavecut.operators import stats as A
from wavecut.plans import features as P
from wavecut.plans.signal import FULL

L = FULL.seg_len


def synthetic(spark: SparkSession, rows: int):
    """Integer-valued noise with bursts, in the range of a 16-bit sensor."""
    i = F.col("id")
    burst = F.when(F.pmod(i, F.lit(40_000)) < 600, 40.0).otherwise(4.0)
    raw = spark.range(0, rows, numPartitions=64).select(
        i.alias("uid"), F.round(F.randn(7) * burst + 4).cast("double").alias("x"),
        (F.lit(16.0) - F.pmod(i, F.lit(50_000_000)) / 3.2e6).alias("y"),
    )
    return S.with_segments(raw.withColumn("idx", F.col("uid") + 1), L)


def main() -> None:
    segments = int(sys.argv[1]) if len(sys.argv) > 1 else 100
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("scale")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "20g")
        .config("spark.sql.shuffle.partitions", "64").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = sys.argv[2] if len(sys.argv) > 2 else f"{tempfile.mkdtemp(prefix='run-')}/signal"
    if not os.path.isdir(folder):
        start = time.time()
        synthetic(spark, segments * L).write.parquet(folder)
        print(f"write {segments * L} rows to {folder}: {time.time() - start:.1f}s", flush=True)
    sig = spark.read.parquet(folder)
    slices = lambda: V.pack_slices(sig, FULL.slice_len, FULL.n_slices)
    runs = {
        "segment_counts": lambda: A.segment_counts(sig),
        "consecutive_index": lambda: S.consecutive_index(sig.select("uid"), "uid").agg(F.sum("idx")),
        "moment_stats": lambda: A.moment_stats(sig),
        "stats20": lambda: A.stats20(sig),
        "stats36": lambda: A.stats36(sig),
        "two_level": lambda: A.two_level_percentiles(sig),
        "rolling_mean": lambda: R.rolling_mean(sig, seg_len=L),
        "hann_mean": lambda: R.hann_mean(sig, seg_len=L),
        "ewma_mean": lambda: R.ewma_mean(sig, seg_len=L),
        "rolling_std": lambda: R.rolling_std(sig, seg_len=L),
        "sta_lta": lambda: R.sta_lta(sig, seg_len=L),
        "sta_lta_chunked": lambda: R.sta_lta(sig, chunk_rows=400_000),
        "pack_slices": slices,
        "low_frequency_spectrum": lambda: V.low_frequency_spectrum(slices(), FULL.cut),
        "fft_mag_stats": lambda: V.fft_mag_stats(A.pack_segments(sig, max_len=L)),
        "envelope_mean": lambda: V.envelope_mean(A.pack_segments(sig, max_len=L)),
        "window_bands": lambda: P.window_band_table(slices(), FULL, F.col("seg") < segments * 3 // 4),
        "signal_features": lambda: P.signal_features(sig, FULL),
    }
    only = os.environ.get("ONLY", "").split()
    for name, make in runs.items():
        if only and name not in only:
            continue
        start = time.time()
        make().write.format("noop").mode("overwrite").save()
        seconds = time.time() - start
        print(f"{name:24s} {seconds:7.1f}s {segments * L / seconds / 1e6:8.2f} M rows/s", flush=True)


if __name__ == "__main__":
    main()
