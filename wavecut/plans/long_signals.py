"""Registered queries of the operators for segments of any length: streams, sources, series, spectra, sketches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecut.operators import long_spectral as LS
from wavecut.operators import pyramid as PY
from wavecut.operators import running as RU
from wavecut.operators import segments as S
from wavecut.operators import series as SE
from wavecut.operators import sketches as SK
from wavecut.operators import stats as A
from wavecut.plans.catalog import SHORT, rounded
from wavecut.plans.signal import SMALL, event_signal, events, full_segments, labelled, row_count
from wavecut.sources import segment_source as G
from wavecut.sources.storage import run_folder
from wavecut.streaming import ingest as T
from wavecut.streaming import stateful as ST

#: A prime number of rows: its transform needs the chirp convolution.
PRIME = 337
#: Rows a task may hold in these queries, far below a segment.
CHUNK = 64
FRACTIONS = {"p02": 0.02, "p50": 0.5, "p98": 0.98}
ABS_FRACTIONS = {"p95": 0.95}
SLICES = ((1, 1), (7, 43), (64, 64), (60, 201), (65, 300), (250, 400))


# ---------------------------------------------------------------- streaming
def stream_state_stats(spark: SparkSession, d: str) -> DataFrame:
    """Segments cut over twelve files, loaded three at a time, with a restart after the sixth; the last stays open."""
    run = run_folder(spark, f"state-{uuid.uuid4().hex[:8]}", d)
    rows = event_signal(spark, d, SHORT).select("uid", "seg", "no", "x")
    count = row_count(events(spark, d)).first()["n"]
    piece = -(-count // 12)
    for half, part in enumerate((F.col("uid") < 6 * piece, F.col("uid") >= 6 * piece)):
        file = F.floor(F.col("uid") / piece)
        rows.where(part).repartitionByRange(6, file).drop("uid").write.mode("append").parquet(f"{run}/in")
        stream = T.stream_parquet(spark, f"{run}/in", rows.drop("uid").schema, 3)
        ST.run_stateful(ST.stateful_stats(stream, SHORT), f"{run}/out", f"{run}/state")
    complete = spark.read.parquet(f"{run}/out")
    return rounded(S.union_sets(complete, ST.open_segments(spark, f"{run}/state")))


# ------------------------------------------------------------------ sources
def _segment_folder(spark: SparkSession, d: str, name: str) -> str:
    folder = f"{run_folder(spark, f'{name}-{uuid.uuid4().hex[:8]}', d)}/segments"
    G.write_segments(labelled(event_signal(spark, d, SHORT)), folder)
    return folder


def segment_source(spark: SparkSession, d: str) -> DataFrame:
    """The signal written as one file for each segment, read back from byte ranges smaller than a file."""
    read = G.read_segments(spark, _segment_folder(spark, d, "source"), bytesPerTask=2000, fileCost=100)
    return rounded(read.select("set", "name", "no", "x"))


def segment_source_keys(spark: SparkSession, d: str) -> DataFrame:
    """Only the files on a key list are opened; their segments carry its numbers."""
    keys = event_signal(spark, d, SHORT).where("seg % 3 = 1").select("seg").distinct()
    key_list = labelled(keys).select("name", (F.col("seg") * 10).alias("seg"))
    read = G.read_segments(spark, _segment_folder(spark, d, "keys"), key_list)
    return rounded(read.groupBy("name", "seg").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x_avg"), F.max("no").alias("last")))


# ------------------------------------------------------------------- series
def ewma_series(spark: SparkSession, d: str) -> DataFrame:
    return rounded(SE.ewma_series(event_signal(spark, d), SMALL.ewma_spans, chunk_rows=CHUNK, chunks=3))


def rolling_series(spark: SparkSession, d: str) -> DataFrame:
    return rounded(SE.rolling_series(event_signal(spark, d), SMALL.mean_widths, SMALL.std_widths, chunk_rows=CHUNK))


def cumulative_series(spark: SparkSession, d: str) -> DataFrame:
    return rounded(SE.cumulative_series(event_signal(spark, d), chunk_rows=CHUNK, chunks=3).drop("cum_mean"))


# ----------------------------------------------------------------- spectral
def fft_long(spark: SparkSession, d: str) -> DataFrame:
    return rounded(LS.long_fft_mag_stats(full_segments(spark, d), *SMALL.fft_bins, SMALL.fft_last, chunk=CHUNK))


def envelope_long(spark: SparkSession, d: str) -> DataFrame:
    return rounded(LS.long_envelope_mean(full_segments(spark, d), chunk=CHUNK))


def fft_chirp(spark: SparkSession, d: str) -> DataFrame:
    return rounded(LS.long_fft_mag_stats(full_segments(spark, d, PRIME), *SMALL.fft_bins, SMALL.fft_last, chunk=CHUNK))


def envelope_chirp(spark: SparkSession, d: str) -> DataFrame:
    return rounded(LS.long_envelope_mean(full_segments(spark, d, PRIME), chunk=CHUNK))


# --------------------------------------------------------------- statistics
def sketch_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of buckets, and of segments merged from the buckets' stored sketches."""
    path = f"{run_folder(spark, 'sketches', d)}/table"
    SK.bucket_sketches(event_signal(spark, d), SMALL.bucket, size=4096).write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    levels = (stored, SK.merged_sketches(stored, ["seg"]).withColumn("seq", F.lit(-1).cast("bigint")))
    found = [SK.sketch_quantiles(s, FRACTIONS, ABS_FRACTIONS).drop("x_sketch", "xa_sketch") for s in levels]
    return rounded(S.union_sets(*found))


def range_stats(spark: SparkSession, d: str) -> DataFrame:
    """Head, tail and fixed stretches of every segment from the summary pyramid."""
    sig = event_signal(spark, d)
    pyramid = PY.build_pyramid(sig, f"{run_folder(spark, 'pyramid', d)}/levels", base=4)
    counts = A.segment_counts(sig)
    edges = PY.head_tail_ranges(counts, SMALL.head_tail)
    own = F.col("seg").cast("string")
    slices = [
        counts.select(F.concat(own, F.lit(f"/{a}-{b}")).alias("id"), "seg", F.lit(a).cast("bigint").alias("first"), F.lit(b).cast("bigint").alias("last"))
        for a, b in SLICES
    ]
    return rounded(PY.range_stats(sig, pyramid, S.union_sets(edges, *slices), base=4).drop("blocks", "raw_rows"))


# -------------------------------------------------------------------- apply
def running_features(spark: SparkSession, d: str) -> DataFrame:
    """The features of ``segment_apply`` and two more, by a table function called in SQL."""
    RU.register_features(spark, "wavecut_segment_features")
    event_signal(spark, d, SHORT).select("seg", "no", "x").createOrReplaceTempView("wavecut_ordered_signal")
    return rounded(spark.sql("SELECT * FROM wavecut_segment_features(TABLE(wavecut_ordered_signal) PARTITION BY seg ORDER BY no)"))


QUERIES = {
    f.__name__: f
    for f in (
        stream_state_stats, segment_source, segment_source_keys, ewma_series, rolling_series, cumulative_series,
        fft_long, envelope_long, fft_chirp, envelope_chirp, sketch_quantiles, range_stats, running_features,
    )
}
