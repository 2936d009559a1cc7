"""Statistics of any stretch of a segment from a pyramid of block summaries.

Level k has one row for every aligned block of 2^k positions with its count, sum, sum of squares, smallest and largest
value.  A stretch is the union of at most two blocks of each level and two edges shorter than a base block, so that
it is answered from a logarithmic number of rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecut.operators.segments import KEYS, union_sets
from wavecut.sources.storage import cut_lineage, join_small

# Workers get this module with the job and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE = 10
TOP = 30
PARTS = ("n", "s1", "s2", "low", "high")


def _raw(value: str) -> list:
    x = F.col(value).cast("double")
    return [F.count(x).alias("n"), F.sum(x).alias("s1"), F.sum(x * x).alias("s2"), F.min(x).alias("low"), F.max(x).alias("high")]


def _merged(prefix: str = "") -> list:
    parts = (F.sum, F.sum, F.sum, F.min, F.max)
    return [f(prefix + c).alias(c) for f, c in zip(parts, PARTS)]


def build_pyramid(
    df: DataFrame, path: str, keys: Sequence[str] = KEYS, value: str = "x", base: int = BASE, top: int = TOP
) -> DataFrame:
    """``keys, level, block, n, s1, s2, low, high``, written to ``path`` and read from there.

    Only the base level reads the signal; each further one the level below.  Levels end where no segment has two
    blocks.  Positions count from 1; NULL values are skipped.
    """
    spark = df.sparkSession
    columns = [*keys, "block", *PARTS]
    level = base
    rows = df.groupBy(*keys, F.shiftright(F.col("no") - 1, base).alias("block")).agg(*_raw(value))
    while True:
        rows.select(*columns).write.mode("overwrite").parquet(f"{path}/level={level}")
        rows = spark.read.parquet(f"{path}/level={level}")
        if level >= top or not rows.where("block > 0").limit(1).count():
            break
        rows, level = rows.groupBy(*keys, F.shiftright("block", 1).alias("block")).agg(*_merged()), level + 1
    return spark.read.option("basePath", path).parquet(*(f"{path}/level={k}" for k in range(base, level + 1)))


def cover(first: int, last: int, base: int, top: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Blocks ``(level, block)`` and edges ``(first, last)``, both from 0, that make up a stretch."""
    size, blocks = 1 << base, []
    low, high = -(-first // size), (last + 1) // size  # whole base blocks [low, high)
    if low >= high:
        return [], [(first, last)] if first <= last else []
    edges = [(a, b) for a, b in ((first, low * size - 1), (high * size, last)) if a <= b]
    level = base
    while low < high:
        if level == top:
            blocks += [(level, b) for b in range(low, high)]
            break
        if low & 1:
            blocks.append((level, low))
            low += 1
        if high & 1:
            high -= 1
            blocks.append((level, high))
        low, high, level = low >> 1, high >> 1, level + 1
    return blocks, edges


def range_stats(
    df: DataFrame, pyramid: DataFrame, ranges: DataFrame, keys: Sequence[str] = KEYS, value: str = "x", base: int = BASE,
    top: int | None = None,
) -> DataFrame:
    """Count, mean, sample deviation, minimum and maximum of each range ``id, keys, first, last`` (positions from 1).

    ``id, n, avg, std, min, max, blocks, raw_rows``: also from how many blocks and raw rows it was answered.  The signal is read
    below the edges only, through a join on its base blocks.  A range without rows gives a count of 0 and NULLs.
    """
    top = top if top is not None else pyramid.agg(F.max("level")).first()[0] or base
    head = ", ".join(f"`{k}` {ranges.schema[k].dataType.simpleString()}" for k in keys)
    id_type = ranges.schema["id"].dataType.simpleString()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                own = [row["id"], *(row[k] for k in keys)]
                blocks, edges = cover(row["first"] - 1, row["last"] - 1, base, top)
                out += [[*own, level, block, None, None] for level, block in blocks]
                out += [[*own, None, a >> base, a + 1, b + 1] for a, b in edges for a, b in _within(a, b, base)]
            yield pd.DataFrame(out, columns=["id", *keys, "level", "block", "a", "b"]).astype({"level": "Int64", "a": "Int64", "b": "Int64"})

    pieces = cut_lineage(
        ranges.select("id", *keys, "first", "last").mapInPandas(cut, f"id {id_type}, {head}, level int, block long, a long, b long")
    )
    from_blocks = pieces.where("level is not null").join(pyramid, [*keys, "level", "block"]).select(
        "id", *PARTS, F.lit(1).alias("blocks"), F.lit(0).alias("raw_rows")
    )
    edges = cut_lineage(pieces.where("level is null").select("id", *keys, "block", "a", "b"))
    raw = join_small(df.select(*keys, "no", F.col(value).cast("double").alias("x"), F.shiftright(F.col("no") - 1, base).alias("block")), edges, [*keys, "block"])
    x = F.col("x")
    one = [F.when(x.isNotNull(), 1).otherwise(0).cast("bigint"), x, x * x, x, x]
    from_rows = raw.where(F.col("no").between(F.col("a"), F.col("b"))).select(
        "id", *(c.alias(p) for c, p in zip(one, PARTS)), F.lit(0).alias("blocks"), F.lit(1).alias("raw_rows")
    )
    sums = union_sets(from_blocks, from_rows).groupBy("id").agg(*_merged(), F.sum("blocks").alias("blocks"), F.sum("raw_rows").alias("raw_rows"))
    n = F.col("n")
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.col("s2") - F.col("s1") * F.col("s1") / n) / (n - 1)))
    stats = sums.select(
        F.col("id").alias("_id"), "n", (F.col("s1") / F.when(n > 0, n)).alias("avg"), F.when(n > 1, spread).alias("std"),
        F.col("low").alias("min"), F.col("high").alias("max"), "blocks", "raw_rows",
    )
    all_ = ranges.select("id").distinct()
    return all_.join(stats, all_["id"].eqNullSafe(stats["_id"]), "left").drop("_id").na.fill(0, ["n", "blocks", "raw_rows"])


def _within(a: int, b: int, base: int) -> list[tuple[int, int]]:
    """A short stretch cut at the borders of base blocks."""
    out = []
    while a <= b:
        end = min(b, ((a >> base) + 1 << base) - 1)
        out.append((a, end))
        a = end + 1
    return out


def head_tail_ranges(counts: DataFrame, sizes: Sequence[int], keys: Sequence[str] = KEYS) -> DataFrame:
    """Ranges of the first and last rows of every segment ``keys, n``: ``id`` is ``<keys>/first_<size>`` or ``/last_<size>``."""
    n = F.col("n")
    own = F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
    made = [
        F.struct(F.concat(own, F.lit(f"/{part}_{s}")).alias("id"), a.cast("bigint").alias("first"), b.cast("bigint").alias("last"))
        for s in sizes
        for part, a, b in (("first", F.lit(1), F.least(n, F.lit(s))), ("last", F.greatest(F.lit(1), n - s + 1), n))
    ]
    return counts.select(*keys, F.explode(F.array(*made)).alias("r")).select("r.id", *keys, "r.first", "r.last")
