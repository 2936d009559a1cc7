"""Closed-form weights that turn "mean of a linear filter" into one weighted sum.

The mean over a segment of any linear filter (moving average, Hann smoothing,
exponential average) is ``sum(x[i] * W[i])`` where ``W[i]`` depends only on the
position, the segment length and the filter width.  Expressed that way the
features are ordinary map-side-combinable sums: no window, no ordered rows and
no shuffle of the raw signal.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest weight table that is hinted as a broadcast side (rows x columns).
BROADCAST_CELLS = 4_000_000


def number(v: float) -> str:
    """A double literal for SQL text (a bare ``0.5`` would be a decimal)."""
    return f"{float(v)!r}D"


def moving_mean_weight(width: int, no: str = "no", n: str = "n") -> str:
    """SQL text: number of complete frames of ``width`` rows that contain row ``no``."""
    return f"least({no}, {n} - {no} + 1, {width}, {n} - {width} + 1)"


def _hann_cumulative(m: str, width: int) -> str:
    """SQL text: sum of the taps ``0..m`` of a symmetric Hann window (0 for m < 0)."""
    half_angle = math.pi / (width - 1)
    cosines = f"sin(({m} + 1) * {number(half_angle)}) * cos({m} * {number(half_angle)}) * {number(0.5 / math.sin(half_angle))}"
    return f"CASE WHEN {m} < 0 THEN 0D ELSE ({m} + 1) * 0.5D - {cosines} END"


def hann_weight(width: int, no: str = "no", n: str = "n") -> str:
    """SQL text: share of the Hann taps that row ``no`` adds to a same-size convolution."""
    if width < 3:
        raise ValueError("a Hann window needs a width of at least 3")
    start = (width - 1) // 2
    first = f"greatest(0, {start + 1} - {no})"
    last = f"least({width - 1}, {start} + {n} - {no})"
    inside = f"({_hann_cumulative(last, width)}) - ({_hann_cumulative(f'({first} - 1)', width)})"
    return f"CASE WHEN {last} >= {first} THEN ({inside}) / {number((width - 1) / 2)} ELSE 0D END"


def ewma_decay(span: float) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def ewma_table_length(span: float) -> int:
    """Position after which an exponential weight equals 1 in double precision."""
    decay = ewma_decay(span)
    if decay <= 0.0:
        return 1
    return max(1, math.ceil(math.log(1e-18) / math.log(decay)))


def ewma_weights(span: float) -> list[float]:
    """``W[k]`` for k = 1, 2, ... in an endless segment; 1.0 past the list."""
    decay = ewma_decay(span)
    length = ewma_table_length(span)
    weights = [1.0] * (length + 1)
    following = 1.0
    for k in range(length, 0, -1):
        following = (1.0 - decay) / (1.0 - decay**k) + decay * following
        weights[k] = following
    return weights[1:]


def ewma_weight_at(span: float, position: int) -> float:
    weights = ewma_weights(span)
    return weights[position - 1] if position <= len(weights) else 1.0


def ewma_weight_table(spark: SparkSession, spans: list[float]) -> DataFrame:
    """``(no, ew_0, ew_1, ...)``, sized by the largest span only, never by the data."""
    columns = [ewma_weights(s) for s in spans]
    length = max(len(c) for c in columns)
    table = {"no": pa.array(range(1, length + 1), pa.int64())}
    for i, c in enumerate(columns):
        table[f"ew_{i}"] = pa.array(c + [1.0] * (length - len(c)), pa.float64())
    weights = spark.createDataFrame(pa.table(table))
    if length * (len(spans) + 1) <= BROADCAST_CELLS:
        weights = F.broadcast(weights)
    return weights
