"""Rolling, exponential and cumulative values of every row, in segments of any length.

A recursion s -> a * s + x is an affine map, and so is any run of it: a chunk of rows is summed up by one pair
(a ** rows, b).  A two-level prefix over these pairs hands every chunk the value it starts from, and each chunk then
runs alone.  Rolling values need no carry, only the rows before the chunk.

Runs are worked off batch by batch along sorted partitions, all runs of a batch at once: a task holds one batch however
long a run is, and short runs cost no call each.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecut.functions import weights as W
from wavecut.operators.rolling import _rolled, rolling_mean_at, rolling_std_at
from wavecut.operators.segments import KEYS, complete_values, union_sets
from wavecut.sources.storage import cut_lineage

# Workers get this module with the job and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_ROWS = 1 << 18
CHUNKS = 1 << 10


def scan_runs(decays: Sequence[float], pushes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Values after each of the maps s -> decay * s + push, from 0 at the start of each run, in place of ``pushes``.

    ``place`` is a row's distance from the start of its run; the stretch behind a row doubles with every step.
    """
    step, factors = 1, np.asarray(decays, dtype=float)
    while len(at := np.flatnonzero(place >= step)):
        pushes[at] += factors * pushes[at - step]
        step, factors = 2 * step, factors * factors
    return pushes


def run_changes(columns: Sequence[pa.Array]) -> np.ndarray:
    """Whether a row differs from the one before in any of the columns; the first does."""
    out = np.zeros(len(columns[0]), dtype=bool)
    out[:1] = True
    for c in columns:
        code = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out[1:] |= code[1:] != code[:-1]
    return out


def scanned(
    table: DataFrame, group: Sequence[str], order: str, decays: Sequence[float], names: Sequence[str], outs: Sequence[str],
    before: bool = False, started: bool = False, gapless: int | None = None,
) -> DataFrame:
    """``group, order, outs``: the recursions with the pushes ``names`` along ``order`` in each group.

    ``before`` gives the values before each row in place of those after it.  ``started``: the first row of a group is
    what it starts from and is not put out.  ``gapless``: the rows of a chunk, the last column of ``group``; a step other
    than 1 in ``order`` fails the job with its segment.
    """
    k, width = len(group), len(decays)
    types = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in (*group, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, np.zeros(width)  # the row before the batch, and the values after it
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            heads = batch.columns[:k + 1]
            if last is not None:
                heads = [pa.concat_arrays([x, y]) for x, y in zip(last, heads)]
            first = run_changes(heads[:k])
            at = heads[k].to_numpy(zero_copy_only=False)
            if gapless is not None and (bad := np.flatnonzero(~first[1:] & (at[1:] != at[:-1] + 1))).size:
                *where, chunk = (c[int(bad[0])].as_py() for c in heads[:k])
                raise ValueError(f"segment {'/'.join(map(str, where))}: positions after {chunk * gapless} have a gap")
            first = first[-n:]
            if last is None:
                first[0] = True
            starts = np.flatnonzero(first)
            place = np.arange(n) - (starts[np.cumsum(first) - 1] if first[0] else np.concatenate([[0], starts])[np.cumsum(first)])
            values = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[k + 1:]], axis=1).astype(float)
            if not first[0]:
                values[0] += np.asarray(decays) * state
            done = scan_runs(decays, values, place)
            out = done
            if before:
                out = np.concatenate([state[None], done[:-1]])
                out[first] = 0.0
            last, state = [x.slice(n - 1) for x in batch.columns[:k + 1]], done[-1].copy()
            made = pa.RecordBatch.from_arrays(
                [*batch.columns[:k + 1], *(pa.array(np.ascontiguousarray(out[:, i])) for i in range(width))], names=[*group, order, *outs]
            )
            yield made.filter(pa.array(~first)) if started else made

    rows = table.select(*group, order, *names).repartition(*group).sortWithinPartitions(*group, order)
    return rows.mapInArrow(run, f"{types}, " + ", ".join(f"`{o}` double" for o in outs))


def carries(
    summaries: DataFrame, decays: Sequence[float], keys: Sequence[str], chunks: int = CHUNKS
) -> DataFrame:
    """``keys, chunk, s0, s1, ...``: what every chunk starts from.

    ``summaries``: ``keys, chunk, b0, b1, ...`` of all chunks 0, 1, ... of a segment; ``decays`` are those of a whole
    chunk.  Blocks of ``chunks`` chunks are summed up first and scanned for each segment, then the chunks in each block.
    """
    k, block = len(decays), F.floor(F.col("chunk") / chunks).cast("bigint")
    pushes, starts = [f"b{i}" for i in range(k)], [f"s{i}" for i in range(k)]
    blocked = summaries.withColumn("block", block)
    behind = (F.col("block") + 1) * chunks - 1 - F.col("chunk")
    totals = blocked.groupBy(*keys, "block").agg(*(F.sum(F.col(b) * F.pow(F.lit(d), behind)).alias(b) for b, d in zip(pushes, decays)))
    firsts = scanned(totals, keys, "block", [d**chunks for d in decays], pushes, pushes, before=True)
    ahead = firsts.select(*keys, "block", (F.col("block") * chunks - 1).alias("chunk"), *pushes)
    return scanned(
        union_sets(blocked.select(*keys, "block", "chunk", *pushes), ahead), [*keys, "block"], "chunk", decays, pushes, starts, before=True, started=True
    ).drop("block")


def recursions(
    df: DataFrame, decays: Mapping[str, float], keys: Sequence[str] = KEYS, value: str = "x", chunk_rows: int = CHUNK_ROWS,
    chunks: int = CHUNKS,
) -> DataFrame:
    """``keys, no`` and, for each name, the value s = decay * s + x of every row; 1 as decay gives running sums.

    Positions run from 1 without gaps: a chunk that is not full, but for a segment's last, fails the job with its
    segment.  A NULL value fails it with its place.
    """
    names, factors = list(decays), [float(d) for d in decays.values()]
    chunk = F.floor((F.col("no") - 1) / chunk_rows).cast("bigint")
    rows = complete_values(df.select(*keys, "no", F.col(value).cast("double").alias("x")), "x", keys).withColumn("chunk", chunk)
    ahead = (F.col("chunk") + 1) * chunk_rows - F.col("no")
    sums = [F.sum(F.col("x") * F.pow(F.lit(d), ahead)).alias(f"b{i}") for i, d in enumerate(factors)]
    summaries = cut_lineage(rows.groupBy(*keys, "chunk").agg(*sums))
    placed = F.col("chunk").isNotNull()
    for c in keys:
        placed &= F.col(c).isNotNull()
    start = carries(summaries.where(placed), [d**chunk_rows for d in factors], keys, chunks)
    # A chunk's start goes through the recursion as a row in front of it.
    kind, pushes = df.schema["no"].dataType, [f"b{i}" for i in range(len(factors))]
    ahead = start.select(*keys, "chunk", (F.col("chunk") * chunk_rows).cast(kind).alias("no"), *(F.col(f"s{i}").alias(b) for i, b in enumerate(pushes)))
    own = rows.where(placed).select(*keys, "chunk", "no", *(F.col("x").alias(b) for b in pushes))
    return scanned(union_sets(own, ahead), [*keys, "chunk"], "no", factors, pushes, names, started=True, gapless=chunk_rows).drop("chunk")


def ewma_series(
    df: DataFrame, spans: Sequence[int] = (300, 3000, 6000), keys: Sequence[str] = KEYS, value: str = "x",
    chunk_rows: int = CHUNK_ROWS, chunks: int = CHUNKS,
) -> DataFrame:
    """The bias-adjusted exponential moving average of every row: ``keys, no, ewma_<span>, ...``."""
    decays = {f"ewma_{s}": W.ewma_decay(s) for s in spans}
    sums = recursions(df, decays, keys, value, chunk_rows, chunks)
    adjusted = {n: F.col(n) * (1.0 - d) / (1.0 - F.pow(F.lit(d), F.col("no"))) for n, d in decays.items()}
    return sums.withColumns(adjusted)


def cumulative_series(
    df: DataFrame, keys: Sequence[str] = KEYS, value: str = "x", chunk_rows: int = CHUNK_ROWS, chunks: int = CHUNKS
) -> DataFrame:
    """Running sum and running mean of every row: ``keys, no, cum_sum, cum_mean``."""
    sums = recursions(df, {"cum_sum": 1.0}, keys, value, chunk_rows, chunks)
    return sums.withColumn("cum_mean", F.col("cum_sum") / F.col("no"))


def rolling_series(
    df: DataFrame, means: Sequence[int] = (700,), stds: Sequence[int] = (700,), keys: Sequence[str] = KEYS, value: str = "x",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Mean and sample deviation over the last rows of every row, NULL on incomplete frames.

    ``keys, no, ma_<width>, ..., sd_<width>, ...``.  A task holds ``chunk_rows`` rows and the widest frame before them.
    """
    rolled = _rolled(df, means, stds, keys, value, None, chunk_rows)
    columns = [F.expr(rolling_mean_at(w)).alias(f"ma_{w}") for w in means] + [F.expr(rolling_std_at(w)).alias(f"sd_{w}") for w in stds]
    return rolled.select(*keys, "no", *columns)
