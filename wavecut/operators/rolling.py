"""Rolling, recursive and lagged features of an ordered segment.

Filters that are linear in the signal and averaged over the segment are weighted
sums (see ``functions.weights``).  The others use prefix sums: every rolling
value is a difference of two running totals, so the cost per row does not depend
on the width.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wavecut.functions import weights as W
from wavecut.operators.segments import KEYS, complete_values, only_lengths
from wavecut.operators.stats import same_lengths, with_segment_length
from wavecut.sources.storage import cut_lineage, join_small

X = "x"


def ROWS() -> Column:  # noqa: N802
    """Number of rows of a group, for ``same_lengths``."""
    return F.count(F.lit(1)).alias("_rows")


# Smallest positive normal double: floor of the long-term average.
TINY = 2.2250738585072014e-308
# Rows per window partition when a segment has no known bound.
CHUNK_ROWS = 1 << 20


# ---------------------------------------------------------------- weighted sums
def rolling_mean_agg(width: int, value: str = X) -> Column:
    """Mean of the complete rolling means; NULL when the segment is shorter than the frame."""
    total = f"sum({value} * {W.moving_mean_weight(width)})"
    return F.expr(f"CASE WHEN max(n) >= {width} THEN {total} / ((max(n) - {width} + 1) * {width}) END")


def rolling_mean(
    df: DataFrame, widths: Sequence[int] = (700, 1500, 3000, 6000), keys: Sequence[str] = KEYS,
    value: str = X, seg_len: int | None = None,
) -> DataFrame:
    rows = with_segment_length(complete_values(df, value, keys), keys, seg_len)
    means = rows.groupBy(*keys).agg(ROWS(), *(rolling_mean_agg(w, value).alias(f"ma_{w}_mean") for w in widths))
    return same_lengths(means, keys, seg_len)


def hann_mean_agg(width: int, value: str = X) -> Column:
    return F.expr(f"sum({value} * {W.hann_weight(width)}) / max(n)")


def hann_mean(
    df: DataFrame, widths: Sequence[int] = (50, 150, 1500, 15000), keys: Sequence[str] = KEYS,
    value: str = X, seg_len: int | None = None,
) -> DataFrame:
    """Mean of the same-size convolution with a normalised Hann window."""
    rows = with_segment_length(complete_values(df, value, keys), keys, seg_len)
    means = rows.groupBy(*keys).agg(ROWS(), *(hann_mean_agg(w, value).alias(f"hann_{w}_mean") for w in widths))
    return same_lengths(means, keys, seg_len)


def with_ewma_weights(df: DataFrame, spans: Sequence[float]) -> DataFrame:
    """Joins the position weights; positions past the table weigh exactly 1."""
    table = W.ewma_weight_table(df.sparkSession, list(spans))
    joined = df.join(table, "no", "left")
    return joined.withColumns({f"ew_{i}": F.coalesce(f"ew_{i}", F.lit(1.0)) for i in range(len(spans))})


def ewma_aggs(spans: Sequence[float], value: str = X) -> dict[str, Column]:
    """Two sums per span: with endless-segment weights, and with the weight of the
    part that lies behind the segment's end."""
    out: dict[str, Column] = {}
    for i, span in enumerate(spans):
        decay = W.number(W.ewma_decay(span))
        out[f"_ea{i}"] = F.expr(f"sum({value} * ew_{i})")
        out[f"_eb{i}"] = F.expr(f"sum({value} * power({decay}, n + 1 - no))")
    return out


def ewma_finish(
    sums: DataFrame, spans: Sequence[float], names: Sequence[str], seg_len: int | None = None
) -> DataFrame:
    """``n`` and the two sums -> the mean of the exponential moving average.

    The weight just behind the end is a constant when the length is known; otherwise
    it is looked up by ``n + 1``.
    """
    if seg_len is not None:
        done = sums
        behind = [F.lit(W.ewma_weight_at(s, seg_len + 1)) for s in spans]
    else:
        table = W.ewma_weight_table(sums.sparkSession, list(spans)).withColumnRenamed("no", "_next")
        done = sums.withColumn("_next", F.col("n") + 1).join(table, "_next", "left").drop("_next")
        behind = [F.coalesce(f"ew_{i}", F.lit(1.0)) for i in range(len(spans))]
    means = {
        name: (F.col(f"_ea{i}") - behind[i] * F.col(f"_eb{i}")) / F.col("n") for i, name in enumerate(names)
    }
    scratch = [f"{p}{i}" for i in range(len(spans)) for p in ("_ea", "_eb", "ew_")]
    return done.withColumns(means).drop(*scratch)


def ewma_mean(
    df: DataFrame, spans: Sequence[int] = (300, 3000, 6000), keys: Sequence[str] = KEYS,
    value: str = X, seg_len: int | None = None,
) -> DataFrame:
    """Mean of the bias-adjusted exponential moving average."""
    rows = with_ewma_weights(with_segment_length(complete_values(df, value, keys), keys, seg_len), spans)
    sums = rows.groupBy(*keys).agg(
        ROWS(), F.max("n").alias("n"), *(c.alias(a) for a, c in ewma_aggs(spans, value).items())
    )
    sums = same_lengths(sums, keys, seg_len)
    return ewma_finish(sums, spans, [f"ewma_{s}_mean" for s in spans], seg_len).drop("n")


# ------------------------------------------------------------------ prefix sums
@dataclass(frozen=True)
class Ordered:
    """Rows with ``n`` and ``mu`` (length and mean of their segment) and the window
    that runs over them in position order.  ``halo`` rows are history only."""

    rows: DataFrame
    window: WindowSpec
    halo: bool

    @property
    def own(self) -> Column:
        return ~F.col("_halo") if self.halo else F.lit(True)


def ordered_rows(
    df: DataFrame, reach: int, keys: Sequence[str] = KEYS, value: str = X,
    seg_len: int | None = None, chunk_rows: int | None = None, ahead: bool = False,
) -> Ordered:
    """Prepares segments for windows that look ``reach`` rows back (or ``ahead``).

    ``seg_len`` bounds the segment length; a longer segment fails the job.  Within that bound a
    segment is one window partition, and its length and mean are taken in the same window.
    A NULL value fails the job.
    Without a bound a segment is cut into chunks of ``chunk_rows``; each chunk
    also gets the ``reach`` rows next to it, so no task ever holds more than
    ``chunk_rows + reach`` rows of one segment and results stay exact.
    """
    base = complete_values(df.select(*keys, "no", F.col(value).alias("x")), "x", keys)
    if seg_len is not None:
        w = Window.partitionBy(*keys).orderBy("no")
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = base.withColumns(
            {"n": F.count(F.lit(1)).over(whole), "mu": F.avg("x").over(whole)}
        )
        return Ordered(only_lengths(rows, F.col("n") <= seg_len, keys, "n", f"{seg_len} at most"), w, False)
    size = max(chunk_rows or CHUNK_ROWS, 1)
    totals = cut_lineage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mu")))
    chunk_of = lambda pos: F.floor((pos - 1) / size)
    own = chunk_of(F.col("no"))
    if ahead:
        span = F.sequence(F.greatest(F.lit(0), chunk_of(F.col("no") - reach)), own)
    else:
        span = F.sequence(own, F.least(chunk_of(F.col("no") + reach), chunk_of(F.col("n"))))
    rows = (
        join_small(base, totals, keys)
        .withColumn("_chunk", F.explode(span))
        .withColumn("_halo", F.col("_chunk") != own)
    )
    return Ordered(rows, Window.partitionBy(*keys, "_chunk").orderBy("no"), True)


def _running(window: WindowSpec, expr: Column) -> Column:
    return F.sum(expr).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def with_prefix_sums(o: Ordered) -> DataFrame:
    """Running sums of the centred signal and its square (``_s1``, ``_s2``) and of
    the squared raw signal (``_e``).  Centring keeps the differences exact enough
    on signals with a large offset."""
    c = F.col("x") - F.col("mu")
    return o.rows.withColumns(
        {
            "_s1": _running(o.window, c),
            "_s2": _running(o.window, c * c),
            "_e": _running(o.window, F.col("x") * F.col("x")),
        }
    )


def earlier_totals(window: WindowSpec, total: str, widths: Sequence[int]) -> dict[str, Column]:
    """``<total>_w``: the running total ``w`` rows earlier, 0 before the first row.

    Only these look-backs are materialised per row.  The rolling values themselves are
    expressions inside the aggregate: a projection with dozens of them would outgrow
    the size up to which the JVM compiles a generated method.
    """
    return {f"{total}_{w}": F.lag(total, w, 0.0).over(window) for w in sorted(set(widths))}


def rolling_mean_at(w: int) -> str:
    """SQL text: mean of the last ``w`` rows, NULL on incomplete frames."""
    return f"CASE WHEN no >= {w} THEN mu + (_s1 - _s1_{w}) / {w} END"


def rolling_std_at(w: int) -> str:
    """SQL text: sample deviation of the last ``w`` rows, NULL on incomplete frames."""
    if w < 2:
        raise ValueError("a rolling deviation needs a width of at least 2")
    squares = f"(_s2 - _s2_{w}) - (_s1 - _s1_{w}) * (_s1 - _s1_{w}) / {w}"
    return f"CASE WHEN no >= {w} THEN sqrt(greatest(0D, {squares}) / {w - 1}) END"


def rolling_std_agg(w: int) -> Column:
    return F.expr(f"avg({rolling_std_at(w)})")


def _rolled(
    df: DataFrame, means: Sequence[int], stds: Sequence[int], keys: Sequence[str], value: str,
    seg_len: int | None, chunk_rows: int | None,
) -> DataFrame:
    o = ordered_rows(df, max([*means, *stds]), keys, value, seg_len, chunk_rows)
    back = earlier_totals(o.window, "_s1", [*means, *stds]) | earlier_totals(o.window, "_s2", stds)
    rolled = with_prefix_sums(o).withColumns(back)
    return rolled.where(o.own) if o.halo else rolled


def rolling_std(
    df: DataFrame, widths: Sequence[int] = (700, 400, 1000), keys: Sequence[str] = KEYS,
    value: str = X, seg_len: int | None = None, chunk_rows: int | None = None,
) -> DataFrame:
    """Mean of the complete rolling deviations."""
    rolled = _rolled(df, (), widths, keys, value, seg_len, chunk_rows)
    return rolled.groupBy(*keys).agg(*(rolling_std_agg(w).alias(f"ma_{w}_std_mean") for w in widths))


def bollinger(
    df: DataFrame, mean_width: int = 700, std_widths: Sequence[int] = (700, 400),
    keys: Sequence[str] = KEYS, value: str = X, seg_len: int | None = None,
    deviations: float = 2.0, chunk_rows: int | None = None,
) -> DataFrame:
    """Mean upper and lower bounds: one mean width, several deviation widths."""
    rolled = _rolled(df, (mean_width,), std_widths, keys, value, seg_len, chunk_rows)
    centre = F.expr(f"avg({rolling_mean_at(mean_width)})")
    out = []
    for w in std_widths:
        spread = rolling_std_agg(w) * deviations
        out += [(centre + spread).alias(f"bb_{w}_high_mean"), (centre - spread).alias(f"bb_{w}_low_mean")]
    return rolled.groupBy(*keys).agg(*out)


def extrema_aggs(widths: Sequence[int]) -> dict[str, Column]:
    """Largest absolute rolling mean and largest rolling deviation per width."""
    out: dict[str, Column] = {}
    for w in widths:
        out[f"abs_max_roll_mean_{w}"] = F.expr(f"max(abs({rolling_mean_at(w)}))")
        out[f"abs_max_roll_std_{w}"] = F.expr(f"max({rolling_std_at(w)})")
    return out


def roll_extrema(
    df: DataFrame, widths: Sequence[int] = (10, 50, 100, 500, 1000, 10000), keys: Sequence[str] = KEYS,
    value: str = X, seg_len: int | None = None, chunk_rows: int | None = None,
) -> DataFrame:
    rolled = _rolled(df, widths, widths, keys, value, seg_len, chunk_rows)
    return rolled.groupBy(*keys).agg(*(c.alias(a) for a, c in extrema_aggs(widths).items()))


# Fixed values: (short, long) energy frames.
STA_LTA_PAIRS = ((500, 10000), (5000, 100000), (3333, 6666), (10000, 25000))


def sta_lta_at(sta: int, lta: int) -> str:
    """SQL text: short-term over long-term mean energy, 0 until the long frame is complete."""
    if not 0 < sta < lta:
        raise ValueError("sta must be positive and shorter than lta")
    long = f"greatest((_e - _e_{lta}) / {lta}, {W.number(TINY)})"
    return f"CASE WHEN no >= {lta} THEN (_e - _e_{sta}) / {sta} / {long} ELSE 0D END"


def sta_lta_aggs(pairs: Sequence[tuple[int, int]]) -> dict[str, Column]:
    return {f"sta_lta{i}_mean": F.expr(f"avg({sta_lta_at(s, l)})") for i, (s, l) in enumerate(pairs, start=1)}


def sta_lta(
    df: DataFrame, pairs: Sequence[tuple[int, int]] = STA_LTA_PAIRS, keys: Sequence[str] = KEYS,
    value: str = X, seg_len: int | None = None, chunk_rows: int | None = None,
) -> DataFrame:
    o = ordered_rows(df, max(l for _, l in pairs), keys, value, seg_len, chunk_rows)
    energy = o.rows.withColumn("_e", _running(o.window, F.col("x") * F.col("x")))
    rolled = energy.withColumns(earlier_totals(o.window, "_e", [w for pair in pairs for w in pair]))
    if o.halo:
        rolled = rolled.where(o.own)
    return rolled.groupBy(*keys).agg(*(c.alias(a) for a, c in sta_lta_aggs(pairs).items()))


# ------------------------------------------------------------------------- lags
def autocorrelation_agg(lagged: str, k: int) -> Column:
    """Lagged product sum over ``(n - k) * variance``; NULL for a constant or short segment."""
    variance = "avg((x - mu) * (x - mu))"
    products = f"sum((x - mu) * ({lagged} - mu))"
    return F.expr(
        f"CASE WHEN max(n) > {k} AND {variance} > 1e-8D THEN {products} / ((max(n) - {k}) * {variance}) END"
    )


def autocorrelation(
    df: DataFrame, lags: Sequence[int] = (10, 100, 1000, 10000), keys: Sequence[str] = KEYS,
    value: str = X, seg_len: int | None = None, chunk_rows: int | None = None,
) -> DataFrame:
    o = ordered_rows(df, max(lags), keys, value, seg_len, chunk_rows)
    rows = o.rows.withColumns({f"_l{k}": F.lag("x", k).over(o.window) for k in lags})
    if o.halo:
        rows = rows.where(o.own)
    return rows.groupBy(*keys).agg(*(autocorrelation_agg(f"_l{k}", k).alias(f"autocorrelation_{k}") for k in lags))


def change_rate_aggs(sizes: Sequence[int], following: str = "_next") -> dict[str, Column]:
    """Over the first and last rows: mean 0-based position of the non-zero change
    rates (undefined rates count as non-zero), and the mean rate itself where the
    divisor is not zero."""
    nonzero = f"NOT ({following} = x AND x <> 0)"
    out: dict[str, Column] = {}
    for size in sizes:
        parts = {
            "first": (f"no < least({size}, n)", "0"),
            "last": (f"no > greatest(n - {size}, 0) AND no < n", f"greatest(n - {size}, 0)"),
        }
        for where, (inside, start) in parts.items():
            out[f"nonzero_rate_pos_mean_{where}_{size}"] = F.expr(
                f"avg(CASE WHEN {inside} AND {nonzero} THEN no - 1 - {start} END)"
            )
            out[f"mean_rate_{where}_{size}"] = F.expr(
                f"avg(CASE WHEN {inside} AND x <> 0 THEN ({following} - x) / x END)"
            )
    return out


def change_rate(
    df: DataFrame, sizes: Sequence[int] = (50000, 10000), keys: Sequence[str] = KEYS,
    value: str = X, seg_len: int | None = None, chunk_rows: int | None = None,
) -> DataFrame:
    o = ordered_rows(df, 1, keys, value, seg_len, chunk_rows, ahead=True)
    rows = o.rows.withColumn("_next", F.lead("x", 1).over(o.window))
    if o.halo:
        rows = rows.where(o.own)
    return rows.groupBy(*keys).agg(*(c.alias(a) for a, c in change_rate_aggs(sizes).items()))
