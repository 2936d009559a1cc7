"""Exact percentiles of groups that are too large for one task.

The built-in ``percentile`` merges the value counts of a group in one buffer.  That is
right for segments of bounded length.  Here a large group is narrowed down instead:
its value range is cut into cells, counted map-side, and only the cells that hold a
wanted rank are cut again, until the values left per cell fit in one task.  No step
brings the rows of a group together, and the result is exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecut.sources.storage import cut_lineage, join_small

CELLS = 4096


def split_by_size(df: DataFrame, keys: Sequence[str], max_group: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary groups, and of groups above ``max_group`` rows (None if there are none)."""
    large = cut_lineage(
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_group).drop("_n")
    )
    if large.isEmpty():
        return df, None
    return join_small(df, large, keys, "left_anti"), join_small(df, large, keys, "left_semi")


def _wanted_ranks(groups: DataFrame, keys: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """``(keys, q, side, rank, weight)``: the two neighbouring ranks of every fraction."""
    entries = []
    for q, p in enumerate(fractions):
        position = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.floor(position), F.ceil(position)
        part = position - low
        entries.append(F.struct(F.lit(q).alias("q"), low.alias("rank"), (1 - part).alias("weight")))
        entries.append(F.struct(F.lit(q).alias("q"), high.alias("rank"), part.alias("weight")))
    return groups.select(*keys, F.inline(F.array(*entries)))


def large_group_percentiles(
    df: DataFrame, keys: Sequence[str], value: Column, fractions: Mapping[str, float],
    max_group: int, cells: int = CELLS,
) -> DataFrame:
    """``keys`` and one interpolated percentile column per entry of ``fractions``."""
    keys = list(keys)
    rows = df.select(*keys, value.alias("_v")).where(F.col("_v").isNotNull())
    groups = cut_lineage(
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    )
    # one root node per group; lo and hi are the extreme values, below the rows before it
    nodes = groups.select(*keys, F.lit(0).cast("bigint").alias("node"), "lo", "hi", F.lit(0).cast("bigint").alias("below"))
    wanted = _wanted_ranks(groups, keys, list(fractions.values())).withColumn("node", F.lit(0).cast("bigint"))
    rows = rows.withColumn("node", F.lit(0).cast("bigint"))
    while True:
        scaled = F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * cells)
        cell = F.when(F.col("hi") > F.col("lo"), F.least(scaled, F.lit(cells - 1))).otherwise(F.lit(0))
        rows = join_small(rows, nodes.select(*keys, "node", "lo", "hi"), [*keys, "node"]).select(
            *keys, "_v", (F.col("node") * cells + cell).alias("node")
        )
        parent = F.floor(F.col("node") / cells)
        counts = rows.groupBy(*keys, "node").agg(
            F.count(F.lit(1)).alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi")
        ).withColumn("_parent", parent)
        earlier = Window.partitionBy(*keys, "_parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        starts = nodes.select(*keys, F.col("node").alias("_parent"), "below")
        counts = (
            counts.withColumn("_before", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
            .join(starts, [*keys, "_parent"])
            .withColumn("below", F.col("below") + F.col("_before"))
        )
        inside = (F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("c"))
        found = cut_lineage(
            wanted.withColumnRenamed("node", "_parent").join(counts, [*keys, "_parent"]).where(inside)
        )
        wanted = found.select(*keys, "q", "rank", "weight", "node")
        nodes = cut_lineage(found.select(*keys, "node", "lo", "hi", "below", "c").distinct())
        if nodes.where((F.col("hi") > F.col("lo")) & (F.col("c") > max_group)).isEmpty():
            break
    # what is left per node is small, or a single repeated value: rank the distinct values
    left = join_small(rows, nodes.select(*keys, "node", "below"), [*keys, "node"])
    distinct = left.groupBy(*keys, "node", "below", "_v").agg(F.count(F.lit(1)).alias("c"))
    earlier = Window.partitionBy(*keys, "node").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = distinct.withColumn("first", F.col("below") + F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    inside = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("c"))
    matched = wanted.join(ranked, [*keys, "node"]).where(inside)
    return matched.groupBy(*keys).agg(
        *(
            F.sum(F.when(F.col("q") == q, F.col("weight") * F.col("_v"))).alias(name)
            for q, name in enumerate(fractions)
        )
    )
