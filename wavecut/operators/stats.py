"""Per-segment aggregates: moments, percentiles, trends, head/tail and bucket statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecut.functions.arrays import packed
from wavecut.operators.quantiles import large_group_percentiles, split_by_size
from wavecut.operators.segments import KEYS, only_lengths, segment_counts
from wavecut.sources.storage import cut_lineage, join_small

# Column names and fractions of the percentile statistics.
FIVE_POINT = {"p1": 0.05, "p2": 0.20, "p5": 0.50, "p8": 0.80, "p9": 0.95}
TAILS = {
    "p01": 0.01, "p02": 0.02, "p05": 0.05, "p10": 0.10,
    "p90": 0.90, "p95": 0.95, "p98": 0.98, "p99": 0.99,
}
ABS_TAILS = {"p90": 0.90, "p92": 0.92, "p95": 0.95, "p98": 0.98, "p99": 0.99}
ABS_QUANTILES = (1, 5, 10, 20, 25, 30, 40, 50, 60, 70, 75, 80, 90, 95, 99)
SIGNED_QUANTILES = (1, 5, 95, 99)

X = "x"


Quantiles = Sequence[tuple[Column, Mapping[str, float]]]


def summarise(
    df: DataFrame, keys: Sequence[str], plain: Mapping[str, Column], quantiles: Quantiles = (),
    max_group: int | None = None, two_passes: bool = False, accuracy: int | None = None,
) -> DataFrame:
    """Plain aggregates plus one percentile buffer per expression, per group.

    All fractions of one expression share a single value->count buffer, which is
    merged map-side.  The buffer of a group holds at most one entry per distinct
    value, so at most the segment length.  For tables whose segments have no such
    bound, ``max_group`` sends the percentiles of larger groups down a path that
    never holds a group in one task.

    Percentiles take an aggregate out of generated code.  ``two_passes`` keeps costly
    plain aggregates (third and fourth moments) in it: they are grouped in a scan of
    their own and joined back, one row per group.

    ``accuracy`` asks for ``percentile_approx`` instead: not interpolated, in memory of
    a fixed size whatever the number of distinct values.
    """
    if accuracy is not None:
        max_group = None
    if max_group is not None and quantiles:
        return _summarise_unbounded(df, list(keys), plain, quantiles, max_group)
    if two_passes and plain and quantiles:
        return summarise(df, keys, plain).join(summarise(df, keys, {}, quantiles, accuracy=accuracy), list(keys))
    percentile = F.percentile if accuracy is None else partial(F.percentile_approx, accuracy=accuracy)
    aggs = [c.alias(a) for a, c in plain.items()]
    aggs += [percentile(e, list(ps.values())).alias(f"_q{i}") for i, (e, ps) in enumerate(quantiles)]
    grouped = df.groupBy(*keys).agg(*aggs)
    picks = [f"_q{i}[{j}] AS {name}" for i, (_, ps) in enumerate(quantiles) for j, name in enumerate(ps)]
    return grouped.selectExpr(*keys, *plain, *picks)


def _summarise_unbounded(
    df: DataFrame, keys: list[str], plain: Mapping[str, Column], quantiles: Quantiles, max_group: int
) -> DataFrame:
    ordinary, large = split_by_size(df, keys, max_group)
    out = summarise(ordinary, keys, plain, quantiles, two_passes=True)
    if large is None:
        return out
    wide = large.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(c.alias(a) for a, c in plain.items()))
    for value, fractions in quantiles:
        wide = wide.join(large_group_percentiles(large, keys, value, fractions, max_group), keys, "left")
    return out.unionByName(wide.select(*out.columns))


def _named(prefix: str, fractions: Mapping[str, float]) -> dict[str, float]:
    return {f"{prefix}_{k}": p for k, p in fractions.items()}


def moment_aggs(value: Column, prefix: str) -> dict[str, Column]:
    """Mean, sample deviation, population skewness and excess kurtosis, maximum."""
    return {
        f"{prefix}_avg": F.avg(value),
        f"{prefix}_std": F.stddev_samp(value),
        f"{prefix}_skew": F.skewness(value),
        f"{prefix}_kurt": F.kurtosis(value),
        f"{prefix}_max": F.max(value),
    }


def moment_stats(df: DataFrame, keys: Sequence[str] = KEYS, value: str = X) -> DataFrame:
    x, xa = F.col(value), F.abs(F.col(value))
    plain = {
        **moment_aggs(x, "x"), "x_min": F.min(x),
        **moment_aggs(xa, "xa"), "xa_min": F.min(xa),
        "x_range": F.max(x) - F.min(x),
    }
    return summarise(df, keys, plain)


def adjusted_skew(skew: Column, n: Column) -> Column:
    """Bias-corrected skewness; NULL below three values."""
    return F.when(n > 2, skew * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(kurt: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis; NULL below four values."""
    return F.when(n > 3, ((n + 1) * kurt + 6) * (n - 1) / ((n - 2) * (n - 3)))


def adjusted_moments(df: DataFrame, keys: Sequence[str] = KEYS, value: str = X) -> DataFrame:
    x = F.col(value)
    n = F.count(x).cast("double")
    plain = {
        "std_pop": F.stddev_pop(x),
        "skew": adjusted_skew(F.skewness(x), n),
        "kurt": adjusted_kurtosis(F.kurtosis(x), n),
    }
    return summarise(df, keys, plain)


# The percentile statistics below pass ``max_group`` and ``accuracy`` on to ``summarise``.
def stats20(df: DataFrame, keys: Sequence[str] = KEYS, value: str = X, **how) -> DataFrame:
    """Five moments and five percentiles of the signal and of its absolute value."""
    x, xa = F.col(value), F.abs(F.col(value))
    return summarise(
        df, keys,
        {**moment_aggs(x, "x"), **moment_aggs(xa, "xa")},
        [(x, _named("x", FIVE_POINT)), (xa, _named("xa", FIVE_POINT))],
        two_passes=True,
        **how,
    )


def stats14(df: DataFrame, keys: Sequence[str] = KEYS, value: str = X, **how) -> DataFrame:
    """Mean and outer percentiles."""
    x, xa = F.col(value), F.abs(F.col(value))
    return summarise(
        df, keys, {"x_avg": F.avg(x)},
        [(x, _named("x", TAILS)), (xa, _named("xa", ABS_TAILS))],
        **how,
    )


def stats36(df: DataFrame, keys: Sequence[str] = KEYS, value: str = X, **how) -> DataFrame:
    """All of the above with minima and the range."""
    x, xa = F.col(value), F.abs(F.col(value))
    return summarise(
        df, keys,
        {
            **moment_aggs(x, "x"), "x_min": F.min(x),
            **moment_aggs(xa, "xa"), "xa_min": F.min(xa),
            "x_range": F.max(x) - F.min(x),
        },
        [
            (x, {**_named("x", FIVE_POINT), **_named("x", TAILS)}),
            (xa, {**_named("xa", FIVE_POINT), **_named("xa", ABS_TAILS)}),
        ],
        two_passes=True,
        **how,
    )


def abs_quantiles(df: DataFrame, keys: Sequence[str] = KEYS, value: str = X, **how) -> DataFrame:
    x, xa = F.col(value), F.abs(F.col(value))
    return summarise(
        df, keys, {},
        [
            (xa, {f"abs_q{p:02d}": p / 100 for p in ABS_QUANTILES}),
            (x, {f"q{p:02d}": p / 100 for p in SIGNED_QUANTILES}),
        ],
        **how,
    )


def iqr_median(df: DataFrame, keys: Sequence[str] = KEYS, value: str = X, **how) -> DataFrame:
    q = summarise(df, keys, {}, [(F.col(value), {"p25": 0.25, "med": 0.5, "p75": 0.75})], **how)
    return q.select(*keys, (F.col("p75") - F.col("p25")).alias("iqr"), "med")


def mean_abs_dev(df: DataFrame, keys: Sequence[str] = KEYS, value: str = X, seg_len: int | None = None) -> DataFrame:
    """Mean absolute deviation around the mean.

    With ``seg_len`` as a bound for all segments, from one scan and one exchange by segment; a longer segment fails the
    job.  Without one the means are aggregated and written first, and joined back without moving a hot segment to one
    task: two scans, no task holds a segment.
    """
    if seg_len is not None:
        w = Window.partitionBy(*keys)
        rows = df.select(*keys, value, F.avg(value).over(w).alias("_mu"), F.count(F.lit(1)).over(w).alias("_n"))
        rows = only_lengths(rows, F.col("_n") <= seg_len, keys, "_n", f"{seg_len} at most")
    else:
        means = cut_lineage(df.groupBy(*keys).agg(F.avg(value).alias("_mu")))
        rows = join_small(df.select(*keys, value), means, keys)
    return rows.groupBy(*keys).agg(F.avg(F.abs(F.col(value) - F.col("_mu"))).alias("mad"))


def trend_slope(df: DataFrame, keys: Sequence[str] = KEYS, value: str = X, no: str = "no") -> DataFrame:
    """Least-squares slope of the signal, and of its absolute value, on position."""
    x, pos = F.col(value), F.col(no).cast("double")
    return df.groupBy(*keys).agg(
        F.regr_slope(x, pos).alias("trend"), F.regr_slope(F.abs(x), pos).alias("abs_trend")
    )


def with_segment_length(df: DataFrame, keys: Sequence[str] = KEYS, seg_len: int | None = None) -> DataFrame:
    """Adds ``n``, the number of rows of the segment.

    It is counted in the data, and the counts are joined back without moving a hot segment to one task.
    ``seg_len`` says that all segments have that length and saves the join; what is grouped from these
    rows then goes through ``same_lengths``, which fails if it was not so.
    """
    if seg_len is not None:
        return df.withColumn("n", F.lit(seg_len).cast("bigint"))
    return join_small(df, cut_lineage(segment_counts(df, keys)), keys)


def same_lengths(grouped: DataFrame, keys: Sequence[str], seg_len: int | None) -> DataFrame:
    """Drops ``_rows``, the row count; fails on a segment that has not ``seg_len`` rows."""
    if seg_len is not None:
        grouped = only_lengths(grouped, F.col("_rows") == seg_len, keys, "_rows", str(seg_len))
    return grouped.drop("_rows")



def head_tail_aggs(sizes: Sequence[int], value: str = X) -> dict[str, Column]:
    """std / avg / min / max of the first and last rows, as conditional aggregates."""
    out: dict[str, Column] = {}
    for stat, agg in (("std", "stddev_samp"), ("avg", "avg"), ("min", "min"), ("max", "max")):
        for size in sizes:
            out[f"{stat}_first_{size}"] = F.expr(f"{agg}(CASE WHEN no <= {size} THEN {value} END)")
            out[f"{stat}_last_{size}"] = F.expr(f"{agg}(CASE WHEN no > n - {size} THEN {value} END)")
    return out


def head_tail_stats(
    df: DataFrame, sizes: Sequence[int] = (50000, 10000), keys: Sequence[str] = KEYS,
    value: str = X, seg_len: int | None = None,
) -> DataFrame:
    aggs = {"_rows": F.count(F.lit(1)), **head_tail_aggs(sizes, value)}
    return same_lengths(summarise(with_segment_length(df, keys, seg_len), keys, aggs), keys, seg_len)


def bucket_number(no: Column, bucket: int, aligned: bool = False) -> Column:
    """Truncated ``no / bucket``; with 1-based positions the first bucket is one row
    short and the last row opens a bucket of its own unless ``aligned``."""
    pos = no - 1 if aligned else no
    return ((pos - F.pmod(pos, F.lit(bucket))) / bucket).cast("bigint")


def bucket_stats(
    df: DataFrame, bucket: int = 1000, keys: Sequence[str] = KEYS, value: str = X, aligned: bool = False
) -> DataFrame:
    """Mean, 2nd and 98th percentile and 95th absolute percentile per bucket of rows."""
    x = F.col(value)
    rows = df.withColumn("seq", bucket_number(F.col("no"), bucket, aligned))
    return summarise(
        rows, [*keys, "seq"], {"x_avg": F.avg(x)},
        [(x, {"x_p02": 0.02, "x_p98": 0.98}), (F.abs(x), {"xa_p95": 0.95})],
    )


def pack_bucket_stats(buckets: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The four bucket statistics of a segment as arrays ``stx1..stx4`` in bucket order."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "x_avg", "x_p02", "x_p98", "xa_p95")))
    grouped = buckets.groupBy(*keys).agg(rows.alias("_r"))
    return grouped.select(
        *keys,
        *(
            F.col("_r")[name].alias(f"stx{i}")
            for i, name in enumerate(("x_avg", "x_p02", "x_p98", "xa_p95"), start=1)
        ),
    )


def two_level_percentiles(
    df: DataFrame, bucket: int = 1000, keys: Sequence[str] = KEYS, value: str = X, aligned: bool = False
) -> DataFrame:
    """Spread of each percentile over the buckets of a segment.

    Inner level: eight percentiles of the signal and five of its absolute value
    per bucket.  Outer level: mean, deviation, skewness, kurtosis, maximum and
    minimum of each.  ``xaSTD_max`` and ``xaAVG`` are the row-wise maximum and
    mean of the five absolute-percentile deviations.
    """
    x = F.col(value)
    rows = df.withColumn("seq", bucket_number(F.col("no"), bucket, aligned))
    names = {f"xp{k[1:]}": p for k, p in TAILS.items()}
    abs_names = {f"xap{k[1:]}": p for k, p in ABS_TAILS.items()}
    inner = summarise(rows, [*keys, "seq"], {}, [(x, names), (F.abs(x), abs_names)])
    spread = {"avg": "avg", "std": "stddev_samp", "skew": "skewness", "kurt": "kurtosis", "max": "max", "min": "min"}
    outer = {
        f"{name}_{short}": F.expr(f"{function}({name})")
        for name in (*names, *abs_names)
        for short, function in spread.items()
    }
    return std_max_mean(summarise(inner, keys, outer), [f"{n}_std" for n in abs_names])


def std_max_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row-wise maximum and mean of the given columns as ``xaSTD_max`` and ``xaAVG``."""
    total = F.col(columns[0])
    for c in columns[1:]:
        total = total + F.col(c)
    return df.withColumn("xaSTD_max", F.greatest(*columns)).withColumn("xaAVG", total / len(columns))


def two_level_stats(df: DataFrame, bucket: int = 1000, keys: Sequence[str] = KEYS, value: str = X) -> DataFrame:
    """Whole-segment base columns and percentiles joined to the two-level statistics."""
    x, xa = F.col(value), F.abs(F.col(value))
    base = summarise(
        df, keys,
        {
            "x_avg": F.avg(x), "x_std": F.stddev_samp(x), "x_skew": F.skewness(x),
            "x_kurt": F.kurtosis(x), "x_max": F.max(x), "x_min": F.min(x),
        },
        [(x, _named("x", TAILS)), (xa, _named("xa", ABS_TAILS))],
        two_passes=True,
    )
    return base.join(two_level_percentiles(df, bucket, keys, value), list(keys))


def pack_segments(df: DataFrame, keys: Sequence[str] = KEYS, value: str = X, max_len: int | None = None) -> DataFrame:
    """Each segment's values as one array ordered by position.

    ``max_len`` is the bound of every array: a segment with more rows, or with positions outside
    ``1..max_len``, fails the job.
    """
    rows = df
    if max_len is not None:
        said = F.concat(
            F.lit("segment "), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)), F.lit(" has position "),
            F.col("no").cast("string"), F.lit(f", outside 1..{max_len}"),
        )
        inside = F.when(F.col("no").between(1, max_len), F.col("no"))
        rows = df.withColumn("no", F.coalesce(inside, F.raise_error(said).cast(df.schema["no"].dataType)))
    grouped = rows.groupBy(*keys).agg(packed(F.col("no"), F.col(value)).alias("values"))
    if max_len is not None:
        sized = grouped.withColumn("_rows", F.size("values"))
        grouped = only_lengths(sized, F.col("_rows") <= max_len, keys, "_rows", f"{max_len} at most").drop("_rows")
    return grouped


def mae(label: str = "label", prediction: str = "prediction") -> Column:
    """Aggregate: mean absolute error."""
    return F.avg(F.abs(F.col(label) - F.col(prediction)))


def fold_score_summary(scores: DataFrame, score: str = "mae") -> DataFrame:
    """Mean and population deviation of the fold scores."""
    return scores.agg(F.avg(score).alias("cv_mean"), F.stddev_pop(score).alias("cv_std"))
