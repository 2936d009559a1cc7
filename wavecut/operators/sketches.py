"""Quantiles of buckets, segments and sets from mergeable sketches: the signal is read once, for the buckets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecut.operators.segments import KEYS
from wavecut.operators.stats import bucket_number

SIZE = 400


def rank_error(size: int) -> float:
    """Rank error, as a fraction of the rows, that a quantile stays below with 99 % confidence (published for KLL sketches)."""
    return 2.296 / size**0.9021


def bucket_sketches(
    df: DataFrame, bucket: int = 1000, keys: Sequence[str] = KEYS, value: str = "x", size: int = SIZE, aligned: bool = False,
    more: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``keys, seq, n, x_sketch, xa_sketch``: one sketch of the signal and one of its absolute value for each bucket.

    ``more``: further aggregates by name.  A sketch of up to ``size`` values holds all of them; NULLs are skipped.
    """
    x = F.col(value).cast("double")
    rows = df.withColumn("seq", bucket_number(F.col("no"), bucket, aligned))
    return rows.groupBy(*keys, "seq").agg(
        F.count(x).alias("n"), F.kll_sketch_agg_double(x, F.lit(size)).alias("x_sketch"),
        F.kll_sketch_agg_double(F.abs(x), F.lit(size)).alias("xa_sketch"), *(c.alias(a) for a, c in (more or {}).items()),
    )


def merged_sketches(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The sketches of all rows with the same keys as one: a segment's from its buckets, the set's from its segments."""
    merged = [F.kll_merge_agg_double(c).alias(c) for c in ("x_sketch", "xa_sketch")]
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), *merged)


def sketch_quantiles(sketches: DataFrame, fractions: Mapping[str, float], absolute: Mapping[str, float] | None = None) -> DataFrame:
    """Adds a column for each named fraction: the value that so many of the rows do not exceed.

    Values are not interpolated.  An empty sketch gives NULL.
    """
    out = sketches
    for column, wanted, prefix in (("x_sketch", fractions, "x"), ("xa_sketch", absolute or {}, "xa")):
        if wanted:
            values = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(column, F.array(*(F.lit(float(p)) for p in wanted.values()))))
            out = out.withColumn("_q", values).select(
                "*", *(F.col("_q")[i].alias(f"{prefix}_{name}") for i, name in enumerate(wanted))
            ).drop("_q")
    return out


def ranks(df: DataFrame, sketches: DataFrame, quantiles: Mapping[str, float], keys: Sequence[str], value: str = "x") -> DataFrame:
    """How far the rank of each sketched quantile is from its fraction, counted in the signal: for checks."""
    found = sketch_quantiles(sketches, quantiles)
    rows = df.join(found.select(*keys, *(f"x_{q}" for q in quantiles)), list(keys)) if keys else df.crossJoin(F.broadcast(found.select(*(f"x_{q}" for q in quantiles))))
    x, n = F.col(value), F.count(F.col(value))
    off = lambda q, p: F.greatest(
        F.lit(0.0), F.sum((x < F.col(f"x_{q}")).cast("int")) / n - p, p - F.sum((x <= F.col(f"x_{q}")).cast("int")) / n
    )
    return rows.groupBy(*keys).agg(*(off(q, p).alias(q) for q, p in quantiles.items()))
