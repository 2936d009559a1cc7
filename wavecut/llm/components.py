"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecut.llm.common import run_path, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """``node, root`` for every node of an edge ``(a, b)``; the root is the smallest node reachable.

    Each round is two aggregations to a minimum (combined map-side) and two joins; no neighbour list is
    gathered, and every round is written to the shared folder.  Loops and repeated edges do no harm; an
    empty table gives no rows.
    """
    folder = folder or run_path(edges.sparkSession, "components")
    pairs = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    current = written(pairs, f"{folder}/round-0")
    state, k = _state(current), 0
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        large = written(large, f"{folder}/large-{k}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        current = written(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct(),
            f"{folder}/round-{k + 1}",
        )
        before, state, k = state, _state(current), k + 1
        if state == before:
            break
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return leaves.union(roots)
