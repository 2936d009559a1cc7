"""Registered queries: each reads the given tables in full and returns a DataFrame.

Doubles are rounded to six digits so that results can be compared with another
engine; every computed column carries an explicit alias.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecut.operators import apply as U
from wavecut.operators import assemble as J
from wavecut.operators import learn as M
from wavecut.operators import rolling as R
from wavecut.operators import segments as S
from wavecut.operators import spectral as V
from wavecut.operators import stats as A
from wavecut.plans import features as P
from wavecut.plans.signal import (
    SMALL,
    event_signal,
    events,
    full_segments,
    labelled,
    row_count,
    train_cut,
)
from wavecut.sources import tables as IO
from wavecut.sources.storage import run_folder
from wavecut.streaming import ingest as T

DIGITS = 6
L = SMALL.seg_len
SHORT = 300  # segment length of the queries that must meet a partial tail segment


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, small integers widened to ``bigint``."""
    shape = {"double": "round(`{0}`, %d)" % digits, "int": "CAST(`{0}` AS bigint)"}
    return df.selectExpr(*(f"{shape.get(t, '`{0}`')} AS `{{0}}`".format(c) for c, t in df.dtypes))


# ------------------------------------------------------------- segmentation
def segment_index(spark: SparkSession, d: str) -> DataFrame:
    ids = events(spark, d).select(F.col("event_id").alias("uid"))
    numbered = S.with_segments(S.consecutive_index(ids, "uid"), L)
    return numbered.select("uid", "idx", "seg", "no")


def segment_complete(spark: SparkSession, d: str) -> DataFrame:
    return S.incomplete_segments(event_signal(spark, d, SHORT), SHORT)


def segment_label(spark: SparkSession, d: str) -> DataFrame:
    return labelled(event_signal(spark, d)).select("uid", "name")


def point_target(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.point_target(event_signal(spark, d), L))


def multi_target_pivot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.multi_point_targets(event_signal(spark, d), SMALL.target_positions))


def last_value(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.last_values(event_signal(spark, d, SHORT)))


def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.systematic_sample(event_signal(spark, d), SMALL.sample_step).select("uid", "x", "y"))


def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    train, held = S.holdout_split(full_segments(spark, d), train_cut(spark, d))
    both = S.union_sets(train.withColumn("part", F.lit("train")), held.withColumn("part", F.lit("holdout")))
    return rounded(both.groupBy("part", "seg").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y_avg")))


def set_union(spark: SparkSession, d: str) -> DataFrame:
    """Train rows with their target and test rows with a NULL target in one table."""
    train, test = S.holdout_split(full_segments(spark, d), train_cut(spark, d))
    both = S.union_sets(
        train.withColumn("set", F.lit(0)), S.with_null_target(test).withColumn("set", F.lit(1))
    )
    return rounded(labelled(both).select("uid", "set", "seg", "no", "name", "x", "y"))


def key_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the segments on a key list, here those that end before noon."""
    sig = labelled(event_signal(spark, d))
    key_list = S.last_values(sig, ("name",)).where(F.col("y") > 43200).select("name")
    kept = S.restrict_to_keys(sig, key_list, "name")
    return rounded(kept.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x_avg")))


def row_id_range(spark: SparkSession, d: str) -> DataFrame:
    """Largest row id, as used to shift the ids of a second set."""
    return S.max_row_id(event_signal(spark, d))


def position_slice(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.position_range(event_signal(spark, d), 50, 100).select("uid", "seg", "no", "x"))


def segment_position(spark: SparkSession, d: str) -> DataFrame:
    """Position by rank inside a segment that is already known."""
    return S.with_position(event_signal(spark, d).drop("no")).select("uid", "seg", "no")


def cast_key_join(spark: SparkSession, d: str) -> DataFrame:
    """Join of segment keys held as text on one side."""
    sig = event_signal(spark, d)
    left = A.segment_counts(sig).withColumn("seg", F.col("seg").cast("string"))
    return rounded(J.join_on_cast_key(left, S.point_target(sig, L), type_name="bigint"))


# --------------------------------------------------------------- statistics
def moment_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.moment_stats(event_signal(spark, d)))


def adjusted_moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.adjusted_moments(event_signal(spark, d)))


def stats20(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.stats20(event_signal(spark, d)))


def percentile_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.stats14(event_signal(spark, d)))


def stats36(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.stats36(event_signal(spark, d)))


def scaled_stats(spark: SparkSession, d: str) -> DataFrame:
    """The 20 statistics as a vector scaled to unit variance over the training segments."""
    stats = A.stats20(full_segments(spark, d))
    names = J.feature_columns(stats)
    arrays = stats.select("seg", F.array(*names).alias("stat"))
    scaler = V.fit_unit_scaler(arrays.where(F.col("seg") < train_cut(spark, d)), ["stat"], [len(names)])
    return rounded(scaler.transform(arrays).select("seg", F.posexplode("stat").alias("pos", "v")))


def abs_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.abs_quantiles(event_signal(spark, d)))


def iqr_median(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.iqr_median(event_signal(spark, d)))


def mean_abs_dev(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.mean_abs_dev(event_signal(spark, d), seg_len=L))


def mean_abs_dev_tail(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.mean_abs_dev(event_signal(spark, d, SHORT)))


def trend_slope(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.trend_slope(event_signal(spark, d)))


def head_tail_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.head_tail_stats(full_segments(spark, d), SMALL.head_tail, seg_len=L))


def head_tail_stats_tail(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.head_tail_stats(event_signal(spark, d, SHORT), SMALL.head_tail))


def drop_partial(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the full segments, where the last segment is a partial one."""
    return rounded(S.drop_partial(event_signal(spark, d, SHORT), SHORT).select("uid", "seg", "no", "x"))


def bucket_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.bucket_stats(event_signal(spark, d), SMALL.bucket))


def two_level_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.two_level_stats(event_signal(spark, d), SMALL.bucket).drop("xaSTD_max", "xaAVG"))


def std_max_mean(spark: SparkSession, d: str) -> DataFrame:
    two = A.two_level_percentiles(event_signal(spark, d), SMALL.bucket)
    return rounded(two.select("seg", "xaSTD_max", "xaAVG"))


# ------------------------------------------------------------------ packing
def _slices(spark: SparkSession, d: str) -> DataFrame:
    return V.pack_slices(full_segments(spark, d), SMALL.slice_len, SMALL.n_slices)


def pack_slices(spark: SparkSession, d: str) -> DataFrame:
    """Elements of the ten slice arrays of every segment, border rows in both neighbours."""
    slices = _slices(spark, d)
    each = F.posexplode(F.array(*V.slice_columns(slices))).alias("slice", "vx")
    return rounded(slices.select("seg", each).select("seg", "slice", F.posexplode("vx").alias("pos", "x")))


def pack_bucket_stats(spark: SparkSession, d: str) -> DataFrame:
    packed = A.pack_bucket_stats(A.bucket_stats(full_segments(spark, d), SMALL.bucket))
    zipped = F.arrays_zip("stx1", "stx2", "stx3", "stx4")
    rows = packed.select("seg", F.posexplode(zipped).alias("pos", "r"))
    return rounded(rows.select("seg", "pos", *(F.col("r")[f"stx{i}"].alias(f"stx{i}") for i in range(1, 5))))


def scaled_bucket_stats(spark: SparkSession, d: str) -> DataFrame:
    """The four bucket-statistic arrays scaled to unit variance, all in one fit."""
    packed = M.prepared(A.pack_bucket_stats(A.bucket_stats(full_segments(spark, d), SMALL.bucket)))
    columns = [f"stx{i}" for i in range(1, 5)]
    scaler = V.fit_unit_scaler(packed, columns, [L // SMALL.bucket + 1] * 4)
    names = [f"stxn{i}" for i in range(1, 5)]
    rows = scaler.transform(packed, names).select("seg", F.posexplode(F.arrays_zip(*names)).alias("pos", "r"))
    return rounded(rows.select("seg", "pos", *(F.col("r")[n].alias(n) for n in names)))


# ------------------------------------------------------------------ rolling
def rolling_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.rolling_mean(full_segments(spark, d), SMALL.mean_widths, seg_len=L))


def rolling_mean_tail(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.rolling_mean(event_signal(spark, d, SHORT), SMALL.mean_widths))


def rolling_std_tail(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.rolling_std(event_signal(spark, d, SHORT), SMALL.std_widths, chunk_rows=70))


def ewma_mean_tail(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.ewma_mean(event_signal(spark, d, SHORT), SMALL.ewma_spans))


def hann_mean_tail(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.hann_mean(event_signal(spark, d, SHORT), SMALL.hann))


def rolling_std(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.rolling_std(full_segments(spark, d), SMALL.std_widths, seg_len=L))


def bollinger(spark: SparkSession, d: str) -> DataFrame:
    return rounded(
        R.bollinger(full_segments(spark, d), SMALL.mean_widths[0], SMALL.std_widths[:2], seg_len=L)
    )


def roll_extrema(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.roll_extrema(full_segments(spark, d), SMALL.extrema_widths, seg_len=L))


def ewma_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.ewma_mean(full_segments(spark, d), SMALL.ewma_spans, seg_len=L))


def sta_lta(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.sta_lta(full_segments(spark, d), SMALL.sta_lta, seg_len=L))


def autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.autocorrelation(full_segments(spark, d), SMALL.lags, seg_len=L))


def change_rate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.change_rate(full_segments(spark, d), SMALL.head_tail, seg_len=L))


def hann_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.hann_mean(full_segments(spark, d), SMALL.hann, seg_len=L))


# ----------------------------------------------------------------- spectral
def _long(df: DataFrame, column: str, index: str = "k") -> DataFrame:
    return rounded(df.select("seg", F.posexplode(column).alias(index, "v")))


def dct_coeffs(spark: SparkSession, d: str) -> DataFrame:
    return _long(V.low_frequency_spectrum(_slices(spark, d), cut=None), "vx")


def low_freq_cut(spark: SparkSession, d: str) -> DataFrame:
    return _long(V.low_frequency_spectrum(_slices(spark, d), SMALL.cut), "vx")


def unit_scale(spark: SparkSession, d: str) -> DataFrame:
    is_train = F.col("seg") < train_cut(spark, d)
    return _long(P.scaled_spectrum(_slices(spark, d), SMALL.cut, is_train).spectra, "vx")


def standard_scale(spark: SparkSession, d: str) -> DataFrame:
    stats = A.moment_stats(full_segments(spark, d))
    train = stats.where(F.col("seg") < train_cut(spark, d))
    return rounded(V.fit_column_scaler(train, J.feature_columns(stats)).transform(stats))


def _bands(spark: SparkSession, d: str) -> DataFrame:
    is_train = F.col("seg") < train_cut(spark, d)
    return P.band_table(_slices(spark, d), SMALL, is_train, folder=run_folder(spark, "bands", d))


def _window_bands(spark: SparkSession, d: str) -> DataFrame:
    is_train = F.col("seg") < train_cut(spark, d)
    return P.window_band_table(_slices(spark, d), SMALL, is_train, folder=run_folder(spark, "window-bands", d))


def band_means(spark: SparkSession, d: str) -> DataFrame:
    return _long(_bands(spark, d), "f", "band")


def window_band_means(spark: SparkSession, d: str) -> DataFrame:
    bands = _window_bands(spark, d)
    each = F.posexplode(F.array(*(f"f{j}" for j in range(SMALL.n_windows)))).alias("win", "f")
    return rounded(bands.select("seg", each).select("seg", "win", F.posexplode("f").alias("band", "v")))


def band_slice(spark: SparkSession, d: str) -> DataFrame:
    return _long(V.slice_bands(_bands(spark, d), *SMALL.band_slice), "f", "pos")


def window_concat(spark: SparkSession, d: str) -> DataFrame:
    return _long(V.window_band_features(_window_bands(spark, d), *SMALL.wide_band_slice), "f", "pos")


def fft_mag_stats(spark: SparkSession, d: str) -> DataFrame:
    packed = A.pack_segments(full_segments(spark, d), max_len=L)
    return rounded(V.fft_mag_stats(packed, *SMALL.fft_bins, SMALL.fft_last))


def envelope_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.envelope_mean(A.pack_segments(full_segments(spark, d), max_len=L)))


def fft_mag_stats_tail(spark: SparkSession, d: str) -> DataFrame:
    packed = A.pack_segments(event_signal(spark, d, SHORT), max_len=SHORT)
    return rounded(V.fft_mag_stats(packed, *SMALL.fft_bins, SMALL.fft_last))


def envelope_mean_tail(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.envelope_mean(A.pack_segments(event_signal(spark, d, SHORT), max_len=SHORT)))


def signal_features_tail(spark: SparkSession, d: str) -> DataFrame:
    """The wide table of full segments and a partial one."""
    return rounded(P.signal_features(event_signal(spark, d, SHORT), replace(SMALL, seg_len=SHORT)))


def signal_features(spark: SparkSession, d: str) -> DataFrame:
    """The wide per-segment table in one shuffle."""
    return rounded(P.signal_features(full_segments(spark, d), SMALL))


# ----------------------------------------------------------------- assembly
def feature_join(spark: SparkSession, d: str) -> DataFrame:
    """Band slice, statistics and label of each segment."""
    sig = full_segments(spark, d)
    bands = V.slice_bands(_bands(spark, d), *SMALL.band_slice)
    table = J.join_on_segment(bands, A.stats20(sig), S.point_target(sig, L).withColumnRenamed("y", "label"))
    first, last = SMALL.band_slice
    spread = [F.col("f")[i].alias(f"f_{i}") for i in range(last - first + 1)]
    return rounded(table.select("seg", *spread, "x_avg", "x_std", "xa_p9", "label"))


def _feature_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Features of the signal with their target, and of its bucket means."""
    sig = full_segments(spark, d)
    summary = lambda v: (F.avg(v).alias("avg"), F.max(v).alias("max"), F.min(v).alias("min"))
    plain = sig.groupBy("seg").agg(*summary("x"), F.max_by("y", "no").alias("target"))
    smooth = A.bucket_stats(sig, SMALL.bucket).groupBy("seg").agg(*summary("x_avg"))
    return plain, smooth


def suffix_join(spark: SparkSession, d: str) -> DataFrame:
    plain, denoised = _feature_tables(spark, d)
    return rounded(J.join_suffixed(plain, denoised))


def _two_predictions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sig = labelled(full_segments(spark, d))
    mean = sig.groupBy(F.col("name").alias("seg_id")).agg(F.avg("y").alias("time_to_failure"))
    last = S.last_values(sig, ("name",)).select(F.col("name").alias("seg_id"), F.col("y").alias("time_to_failure"))
    return mean, last


def prediction_diff(spark: SparkSession, d: str) -> DataFrame:
    return rounded(J.prediction_diff(*_two_predictions(spark, d)))


def _sequence(spark: SparkSession, d: str) -> DataFrame:
    windows = V.window_band_features(_window_bands(spark, d), *SMALL.band_slice)
    targets = S.multi_point_targets(full_segments(spark, d), SMALL.target_positions)
    return J.sequence_table(windows, targets, SMALL.n_windows)


def sequence_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_sequence(spark, d).select("seg", "win", "y", F.posexplode("f").alias("band", "v")))


def target_normalise(spark: SparkSession, d: str) -> DataFrame:
    targets = S.point_target(full_segments(spark, d), L)
    scale = J.target_scale(targets.where(F.col("seg") < train_cut(spark, d)))
    return rounded(J.normalise_target(targets, scale))


def _fold_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Five predictions per segment: the mean target over every fifth row."""
    rows = full_segments(spark, d).withColumn("fold", F.pmod("no", F.lit(5)).cast("int"))
    return rows.groupBy("seg", "fold").agg(F.avg("y").alias("prediction"))


def fold_average(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.fold_average(_fold_predictions(spark, d)))


def _importances(spark: SparkSession, d: str) -> DataFrame:
    """Importance of each user's events per fold, as a feature-importance table."""
    rows = events(spark, d).withColumn("fold", F.pmod("event_id", F.lit(5)).cast("int"))
    name = F.concat(F.lit("f_"), F.col("user_id").cast("string")).alias("feature")
    return rows.groupBy(name, "fold").agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).cast("double").alias("importance"))


def importance_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(J.best_feature_rows(_importances(spark, d), 50))


def _fold_errors(spark: SparkSession, d: str) -> DataFrame:
    label = S.last_values(full_segments(spark, d)).select("seg", F.col("y").alias("label"))
    return _fold_predictions(spark, d).join(label, "seg")


def mae(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_fold_errors(spark, d).agg(A.mae().alias("mae")))


def fold_score_summary(spark: SparkSession, d: str) -> DataFrame:
    scores = _fold_errors(spark, d).groupBy("fold").agg(A.mae().alias("mae"))
    return rounded(A.fold_score_summary(scores))


# ----------------------------------------------------------------- learning
def kfold_assign(spark: SparkSession, d: str) -> DataFrame:
    segs = S.segment_counts(full_segments(spark, d)).select("seg")
    return rounded(M.kfold_assign(segs, 5, 42).select("seg", "fold"))


def _learning_table(spark: SparkSession, d: str, name: str) -> tuple[DataFrame, list[str]]:
    """``seg, name, features, label`` of every full segment of 100 rows, written once."""
    sig = full_segments(spark, d, 100)
    stats = A.stats20(sig)
    names = J.feature_columns(stats)
    label = S.last_values(sig).select("seg", F.col("y").alias("label"))
    table = J.feature_vector(J.join_on_segment(stats, label), names)
    columns = labelled(table).select("seg", "name", "features", "label")
    return M.prepared(columns, f"{run_folder(spark, name, d)}/table"), names


def _cut(spark: SparkSession, d: str, seg_len: int) -> int:
    return row_count(events(spark, d)).first()["n"] // seg_len * 3 // 4


#: Boosting rounds and search trials of the registered queries; an operator's own defaults are 100 and 1000.
ROUNDS, TRIALS = 20, 4


def _inside(df: DataFrame, train: DataFrame) -> DataFrame:
    """Whether a prediction lies within the range of the training labels."""
    span = train.agg(F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    near = F.col("prediction").between(span["lo"] - 1e-6, span["hi"] + 1e-6)
    return df.withColumn("inside", near)


def forest_predict(spark: SparkSession, d: str) -> DataFrame:
    """Held-out segments with their label; a forest cannot leave the range of its training labels."""
    table, _ = _learning_table(spark, d, "forest")
    cut = _cut(spark, d, 100)
    _, held = M.fit_holdout(table, M.forest(trees=200, depth=30), cut, f"{run_folder(spark, 'forest', d)}/parts")
    return rounded(_inside(held, table.where(F.col("seg") < cut)).drop("prediction"))


def _folds(spark: SparkSession, d: str, name: str) -> tuple[M.FoldFit, DataFrame]:
    table, names = _learning_table(spark, d, name)
    folded = M.prepared(M.kfold_assign(table, 5, 42), f"{run_folder(spark, name, d)}/folded")
    return M.cross_fit(folded, names, lambda: M.boosted(rounds=ROUNDS), 5), folded


def gbt_oof(spark: SparkSession, d: str) -> DataFrame:
    """Every segment once, predicted by the fold that did not see it."""
    found = F.col("prediction").isNotNull() & ~F.isnan("prediction")
    return rounded(_folds(spark, d, "oof")[0].oof.withColumn("predicted", found).drop("prediction"))


def gbt_importance(spark: SparkSession, d: str) -> DataFrame:
    """Importances of each fold: not negative, and one in sum."""
    table = _folds(spark, d, "importance")[0].importances
    return rounded(table.groupBy("fold").agg(
        F.count(F.lit(1)).alias("features"), F.sum("importance").alias("total"), (F.min("importance") >= 0).alias("not_negative")
    ))


def param_search(spark: SparkSession, d: str) -> DataFrame:
    """One row for each trial and fold of a search over the whole space."""
    table, _ = _learning_table(spark, d, "search")
    folded = M.prepared(M.kfold_assign(table, 3, 42), f"{run_folder(spark, 'search', d)}/folded")
    _, trials = M.param_search(folded, "cb", TRIALS, diagnostic=True, rounds=ROUNDS)
    return rounded(trials.select("trial", "fold", (F.col("error") > 0).alias("positive")))


def _gradient(table: DataFrame, model, label: str = "label") -> DataFrame:
    """Gradient of the regularised squared error over the training rows, one row for each feature.

    The fit works on features and labels of unit deviation; at its minimum every entry is 0.
    """
    k = model.coefficients.size
    rows = model.transform(table).select((F.col("prediction") - F.col(label)).alias("r"), F.col(label).alias("y"), vector_to_array("features").alias("x"))
    long = rows.select("r", "y", F.posexplode("x").alias("feature", "v"))
    weights = spark_rows(table, [(i, float(model.coefficients[i])) for i in range(k)], "feature int, w double")
    sums = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop("r", "v").alias("c"), F.stddev_pop("v").alias("s"),
        F.stddev_pop("y").alias("sy"), F.avg("y").alias("label_mean"),
    )
    pull = model.getRegParam() / F.col("sy") * F.col("w") * F.col("s")
    entry = F.when(F.col("s") > 0, (F.col("c") / F.col("s") + pull) / F.col("sy")).otherwise(0.0)
    return sums.join(weights, "feature").select("feature", (F.abs(entry) < 1e-3).alias("at_minimum"), "n", "label_mean")


def spark_rows(like: DataFrame, rows: list, schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


def sequence_regress(spark: SparkSession, d: str) -> DataFrame:
    """Linear regression on all windows: the gradient at the fitted weights, feature by feature."""
    flat = J.feature_vector(J.flat_sequences(_sequence(spark, d)), ["f"])
    table = M.prepared(flat.select("seg", "features", "label"), f"{run_folder(spark, 'sequence', d)}/table")
    cut = _cut(spark, d, L)
    model, scale, held = M.sequence_regress(table, cut, LinearRegression(regParam=0.1, elasticNetParam=0.0, tol=1e-12, maxIter=500))
    train = J.normalise_target(table.where(F.col("seg") < cut), scale, "label")
    return rounded(_gradient(train, model).withColumn("held", F.lit(held.count()).cast("bigint")))


def window_regress(spark: SparkSession, d: str) -> DataFrame:
    """Held-out segments and windows of one regression pooled over the windows, each with its label."""
    table = M.prepared(_sequence(spark, d), f"{run_folder(spark, 'pooled', d)}/table")
    held = M.window_regress(table, _cut(spark, d, L))
    return rounded(held.select("seg", "win", "label", F.col("prediction").isNotNull().alias("predicted")))


def batch_score(spark: SparkSession, d: str) -> DataFrame:
    table, _ = _learning_table(spark, d, "score")
    cut = _cut(spark, d, 100)
    model, _ = M.fit_holdout(table, M.forest(trees=50, depth=10), cut)
    key_list = table.where(F.col("seg") >= cut).select("name")
    scored = M.batch_score(model, table, key_list).withColumnRenamed("time_to_failure", "prediction")
    return rounded(_inside(scored, table.where(F.col("seg") < cut)).select("seg_id", "inside"))


def score_saved_models(spark: SparkSession, d: str) -> DataFrame:
    """Scaler and fold models saved, loaded in their stead, averaged, restricted to the key list, written and read."""
    run = run_folder(spark, "saved", d)
    sig, cut = full_segments(spark, d, 100), _cut(spark, d, 100)
    stats = labelled(A.stats20(sig))
    names = [c for c in J.feature_columns(stats) if c != "name"]
    label = S.last_values(sig).select("seg", F.col("y").alias("label"))
    V.fit_column_scaler(stats.where(F.col("seg") < cut), names).save(f"{run}/scaler")
    V.fit_unit_scaler(stats.select("seg", F.array(*names).alias("stat")), ["stat"], [len(names)]).save(f"{run}/unit")
    unit = V.UnitScaler.load(spark, f"{run}/unit")
    scaler = V.ColumnScaler.load(spark, f"{run}/scaler")
    scaled = J.feature_vector(J.join_on_segment(scaler.transform(stats), label), names)
    table = M.prepared(scaled.select("seg", "name", "features", "label"), f"{run}/table")
    folded = M.kfold_assign(table.where(F.col("seg") < cut), 5, 42)
    M.save_folds(M.cross_fit(folded, names, lambda: M.forest(trees=20, depth=8), 5), f"{run}/models")
    key_list = table.where(F.col("seg") >= cut).select("name")
    IO.write_result(M.score_folds(M.load_folds(spark, f"{run}/models", 5), table, key_list), f"{run}/csv")
    read = spark.read.csv(f"{run}/csv", header=True, schema="seg_id string, prediction double")
    judged = _inside(read, table.where(F.col("seg") < cut)).withColumn("scaled_columns", F.lit(sum(unit.lengths)).cast("bigint"))
    return rounded(judged.select("seg_id", "inside", "scaled_columns"))


def segment_apply(spark: SparkSession, d: str) -> DataFrame:
    def features(x):
        return {"energy": float((x * x).sum()), "peak": float(abs(x).max())}

    return rounded(U.segment_apply(event_signal(spark, d), features, ["energy", "peak"], max_len=L))


def segment_apply_tail(spark: SparkSession, d: str) -> DataFrame:
    def features(x):
        return {"energy": float((x * x).sum()), "peak": float(abs(x).max())}

    return rounded(U.segment_apply(event_signal(spark, d, SHORT), features, ["energy", "peak"]))


def segment_apply_chunks(spark: SparkSession, d: str) -> DataFrame:
    """One row for every 200 rows of a segment."""
    def features(x):
        return {"energy": float((x * x).sum()), "peak": float(abs(x).max())}

    return rounded(U.segment_apply(event_signal(spark, d), features, ["energy", "peak"], chunk_rows=200))


# ------------------------------------------------------------------ sources
def row_id_offset(spark: SparkSession, d: str) -> DataFrame:
    """Row ids of two sets, those of the second shifted past the largest of the first."""
    train, test = S.holdout_split(full_segments(spark, d), train_cut(spark, d))
    first = S.with_row_id(train.select(F.col("uid").alias("event_id")))
    start = S.max_row_id(first).first()["m"] + 1
    second = S.with_row_id(test.select(F.col("uid").alias("event_id")), start)
    both = S.union_sets(first.withColumn("set", F.lit(0)), second.withColumn("set", F.lit(1)))
    return rounded(S.consecutive_index(both, "uid", block_bits=40).select("set", "event_id", "idx"))


def _written_csv(spark: SparkSession, d: str, name: str, table: DataFrame, files: int = 3) -> str:
    """Files of unequal size whose names sort like the signal."""
    path = f"{run_folder(spark, name, d)}/csv"
    part = F.floor(F.log2(F.col("uid") + 2))  # ranges that double in length
    table.repartitionByRange(4 * files, part).sortWithinPartitions("uid").drop("uid").write.mode("overwrite").csv(path, header=True)
    return path


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A signal written as several CSV files, read back and numbered in file order."""
    path = _written_csv(spark, d, "csv", event_signal(spark, d).select("uid", "x", "y"))
    numbered = S.number_signal(IO.read_ordered_csv(spark, path), SHORT)
    return rounded(numbered.select(F.col("uid").alias("idx"), "seg", "no", "name", "x", "y"))


def narrow_csv(spark: SparkSession, d: str) -> DataFrame:
    """A 16-bit signal, whose squares would not fit 16 bits."""
    sig = event_signal(spark, d).select("uid", F.round("x").cast("short").alias("x"), "y")
    path = _written_csv(spark, d, "narrow", sig)
    rows = S.file_order_index(IO.with_file_place(IO.read_signal_csv(spark, path, IO.NARROW_SCHEMA)))
    return rounded(rows.select("idx", F.pow(F.col("x").cast("double"), 2.0).alias("energy")))


def _signal_table(spark: SparkSession, d: str) -> DataFrame:
    return event_signal(spark, d, SHORT).withColumn("set", F.lit(0)).select("uid", "set", "seg", "no", "x")


def signal_table(spark: SparkSession, d: str) -> DataFrame:
    path = f"{run_folder(spark, 'signal', d)}/table"
    IO.write_signal(_signal_table(spark, d), path, rows_per_file=1000)
    return rounded(IO.read_table(spark, path).select("set", "seg", "no", "x"))


def compact_batches(spark: SparkSession, d: str) -> DataFrame:
    """Three small batches rewritten as one table."""
    folder, sig = run_folder(spark, "compact", d), _signal_table(spark, d)
    batches = [f"{folder}/batch-{k}" for k in range(3)]
    for k, path in enumerate(batches):
        sig.where(F.pmod("seg", F.lit(3)) == k).write.mode("overwrite").parquet(path)
    IO.compact(spark, batches, f"{folder}/table")
    return rounded(IO.read_table(spark, f"{folder}/table").select("set", "seg", "no", "x"))


def append_twice(spark: SparkSession, d: str) -> DataFrame:
    """Half of the segments loaded, then all of them: none comes twice."""
    folder = run_folder(spark, f"append-{uuid.uuid4().hex[:8]}", d)
    sig = labelled(event_signal(spark, d, SHORT)).select("name", "no", "x", "seg")
    for rows in (sig.where("seg % 2 = 0"), sig, sig):
        IO.append_new_segments(rows.drop("seg"), f"{folder}/table", f"{folder}/loaded")
    return rounded(IO.read_appended(spark, f"{folder}/table", f"{folder}/loaded"))


def result_csv(spark: SparkSession, d: str) -> DataFrame:
    path = f"{run_folder(spark, 'result', d)}/csv"
    means = labelled(full_segments(spark, d)).groupBy(F.col("name").alias("seg_id")).agg(F.avg("y").alias("time_to_failure"))
    IO.write_result(means, path)
    return rounded(spark.read.csv(path, header=True, schema="seg_id string, time_to_failure double"))


def named_view(spark: SparkSession, d: str) -> DataFrame:
    """SQL text over a registered table."""
    IO.register(event_signal(spark, d), "wavecut_signal")
    return rounded(spark.sql("SELECT seg, count(*) AS n, avg(x) AS x_avg FROM wavecut_signal GROUP BY seg"))


def feature_csv(spark: SparkSession, d: str) -> DataFrame:
    path = f"{run_folder(spark, 'features', d)}/csv"
    table = labelled(full_segments(spark, d)).groupBy(F.col("name").alias("seg_id")).agg(
        F.avg("x").alias("x_avg"), F.max("x").alias("x_max")
    )
    IO.write_result(table, path)
    return rounded(IO.read_features_csv(spark, path))


def total_order(spark: SparkSession, d: str) -> DataFrame:
    """The written table read back: its rows lie in signal order, so their place is their rank."""
    path = f"{run_folder(spark, 'order', d)}/table"
    IO.write_signal(_signal_table(spark, d), path, rows_per_file=700)
    rows = IO.with_file_place(IO.read_table(spark, path).select("uid", "_metadata"))
    return rounded(S.file_order_index(rows.drop("_metadata"), "pos").select("pos", "uid"))


# ---------------------------------------------------------------- streaming
def _staged(spark: SparkSession, d: str, name: str, seg_len: int) -> tuple[DataFrame, str]:
    """Writes the signal as files that hold whole segments, for a file stream to pick up."""
    run = run_folder(spark, f"{name}-{uuid.uuid4().hex[:8]}", d)  # a stream's state is never shared by runs
    rows = labelled(event_signal(spark, d, seg_len)).select("name", "seg", "no", "x")
    count = row_count(events(spark, d)).first()["n"]
    files = min(64, max(1, math.ceil(count / seg_len)))  # more than three loads of twenty
    rows.repartitionByRange(files, "seg").sortWithinPartitions("seg", "no").write.parquet(f"{run}/in")
    return rows, run


def _ingest(spark: SparkSession, run: str, rows: DataFrame) -> DataFrame:
    T.run_available(T.stream_parquet(spark, f"{run}/in", rows.schema), lambda batch: batch, f"{run}/out", f"{run}/state")
    return spark.read.parquet(f"{run}/out")


def incremental_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Segment files loaded twenty at a time, as a set without a target."""
    rows, run = _staged(spark, d, "ingest", 100)
    loaded = _ingest(spark, run, rows)
    numbered = T.as_test_set(loaded.drop("seg"), rows.select("name", "seg").distinct())
    return rounded(numbered.drop("batch"))


def ingest_batches(spark: SparkSession, d: str) -> DataFrame:
    """What an incremental load did, and what a second run over the same files added."""
    rows, run = _staged(spark, d, "batches", 100)
    loaded = _ingest(spark, run, rows)
    before = loaded.count()
    added = _ingest(spark, run, rows).count() - before
    return rounded(loaded.agg(
        F.countDistinct("seg").alias("segments"), F.count(F.lit(1)).alias("n_rows"),
        (F.countDistinct("batch") >= 3).alias("several_batches"), F.lit(added).cast("bigint").alias("added_by_second_run"),
    ))


def stream_segment_stats(spark: SparkSession, d: str) -> DataFrame:
    rows, run = _staged(spark, d, "stats", L)
    stream = T.stream_parquet(spark, f"{run}/in", rows.schema)
    T.run_available(stream, A.stats20, f"{run}/out", f"{run}/state")
    return rounded(spark.read.parquet(f"{run}/out").drop("batch"))


QUERIES = {
    f.__name__: f
    for f in (
        segment_index, segment_complete, segment_label, point_target, multi_target_pivot, last_value,
        systematic_sample, holdout_split, set_union, key_semi_join, row_id_range, position_slice,
        segment_position, cast_key_join, moment_stats, adjusted_moments, stats20, percentile_stats, stats36,
        scaled_stats, abs_quantiles, iqr_median, mean_abs_dev, trend_slope, head_tail_stats, bucket_stats,
        two_level_percentiles, std_max_mean, pack_slices, pack_bucket_stats,
        scaled_bucket_stats, rolling_mean, rolling_std,
        bollinger, roll_extrema, ewma_mean, sta_lta, autocorrelation, change_rate, hann_mean, dct_coeffs,
        low_freq_cut, unit_scale, standard_scale, band_means, window_band_means, band_slice, window_concat,
        fft_mag_stats, envelope_mean, signal_features, feature_join, suffix_join, prediction_diff,
        sequence_table, target_normalise, fold_average, importance_topk, mae, fold_score_summary,
        kfold_assign, forest_predict, gbt_oof, gbt_importance, param_search, sequence_regress,
        window_regress, batch_score,
        segment_apply, incremental_ingest, stream_segment_stats,
        signal_features_tail, head_tail_stats_tail, rolling_mean_tail, rolling_std_tail, hann_mean_tail, ewma_mean_tail,
        fft_mag_stats_tail, envelope_mean_tail, mean_abs_dev_tail, segment_apply_tail, segment_apply_chunks, drop_partial, row_id_offset,
        csv_round_trip, narrow_csv, signal_table, compact_batches, append_twice, result_csv, named_view, feature_csv,
        total_order, ingest_batches, score_saved_models,
    )
}
