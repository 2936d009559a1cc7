"""Joins on the segment key, feature tables, sequence tables and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecut.operators.segments import KEYS, suffixed


def join_on_segment(*tables: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Inner equi-join of tables with one row per segment; Spark picks the strategy."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, list(keys))
    return out


def join_on_cast_key(left: DataFrame, right: DataFrame, key: str = "seg", type_name: str = "int") -> DataFrame:
    """Equi-join of keys stored in different types: each side is cast once."""
    cast = lambda df: df.withColumn(key, F.col(key).cast(type_name))
    return cast(left).join(cast(right), key)


def join_suffixed(
    left: DataFrame, right: DataFrame, suffix: str = "_denoised", key: str = "seg", drop: Sequence[str] = ("target",)
) -> DataFrame:
    """Two feature tables side by side, matched on the key and never on row position.

    The right table's label columns are dropped and its features get ``suffix``.
    """
    features = suffixed(right.drop(*drop), suffix, keep=(key,))
    return left.join(features, key)


def feature_columns(df: DataFrame, exclude: Sequence[str] = ("set", "seg", "seg_id", "name", "label", "target", "y")) -> list[str]:
    """Explicit feature list: every column but keys and labels."""
    return [c for c in df.columns if c not in exclude]


def feature_vector(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Scalar and array columns joined into one ML vector."""
    kinds = dict(df.dtypes)
    parts = [
        F.col(c) if kinds[c].startswith("array") else F.array(F.col(c).cast("double")) for c in columns
    ]
    return df.withColumn(out, array_to_vector(F.concat(*parts)))


def to_array(vector: str) -> Column:
    return vector_to_array(vector)


def prediction_diff(a: DataFrame, b: DataFrame, key: str = "seg_id", value: str = "time_to_failure") -> DataFrame:
    """Two prediction tables compared segment by segment."""
    left = a.select(key, F.col(value).alias("prediction_a"))
    right = b.select(key, F.col(value).alias("prediction_b"))
    diff = F.col("prediction_a") - F.col("prediction_b")
    return left.join(right, key).withColumn("diff", diff).withColumn("abs_diff", F.abs(diff))


def sequence_table(
    windows: DataFrame, targets: DataFrame, n_windows: int = 8, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Long sequence table ``(keys, win, f, y)``: one row per segment and window."""
    steps = F.array(
        *(
            F.struct(F.lit(j).alias("win"), F.col(f"f_sl{j}").alias("f"), F.col(f"y{j}").alias("y"))
            for j in range(n_windows)
        )
    )
    return windows.join(targets, list(keys)).select(*keys, F.inline(steps))


def flat_sequences(sequence: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per segment: window features joined in order, last-window target."""
    ordered = F.array_sort(F.collect_list(F.struct("win", "f")))
    return sequence.groupBy(*keys).agg(
        F.flatten(F.transform(ordered, lambda r: r["f"])).alias("f"), F.max_by("y", "win").alias("label")
    )


def normalise_target(df: DataFrame, scale: float, target: str = "y") -> DataFrame:
    return df.withColumn(target, F.col(target) / scale)


def restore_target(df: DataFrame, scale: float, target: str = "prediction") -> DataFrame:
    return df.withColumn(target, F.col(target) * scale)


def target_scale(train: DataFrame, target: str = "y") -> float:
    """Largest training target: one scalar comes back to the driver."""
    return train.agg(F.max(target)).first()[0]


def mean_by(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias(value))


def top_features(importances: DataFrame, k: int = 200, feature: str = "feature") -> DataFrame:
    """The ``k`` features with the largest mean importance; names break ties."""
    means = mean_by(importances, feature, "importance")
    return means.orderBy(F.desc("importance"), feature).limit(k)


def best_feature_rows(importances: DataFrame, k: int = 200, feature: str = "feature") -> DataFrame:
    """The per-fold rows of the top features (left-semi join)."""
    return importances.join(top_features(importances, k, feature).select(feature), feature, "left_semi")


def ordered_by_segment(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.orderBy(*keys)
