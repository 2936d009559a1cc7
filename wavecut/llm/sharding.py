"""Rendezvous hashing of record keys over weighted shards, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _score(key: Column, shard: int, weight: float | None, seed: int) -> Column:
    h = F.xxhash64(key, F.lit(shard), F.lit(seed))
    if weight is None:
        return h
    # u in (0, 1) from the upper 52 bits; the shard with the largest -weight/ln(u) wins with odds of its weight.
    u = (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / float(1 << 52)
    return -F.lit(float(weight)) / F.log(u)


def rendezvous_shard(
    key: Column, shards: int, weights: Sequence[float] | None = None, seed: int = 17
) -> Column:
    """Shard 0..shards-1 of the key with the highest score.

    Scores depend on key and shard alone, so adding a shard moves rows into it and nowhere else, and
    changing a weight moves rows to or from that shard only.  A NULL key is one key of its own.
    """
    if shards <= 0:
        raise ValueError("shards must be positive")
    if weights is not None and (len(weights) != shards or min(weights) <= 0):
        raise ValueError("one positive weight for each shard")
    best = [
        F.struct(_score(key, s, weights[s] if weights else None, seed).alias("score"), F.lit(s).alias("shard"))
        for s in range(shards)
    ]
    return (F.greatest(*best) if shards > 1 else best[0])["shard"]


def gapless_slots(df: DataFrame, group: str, order: Sequence[str], out: str = "slot", buckets: int = 512) -> DataFrame:
    """Numbers the rows of each group from 0, without one task holding a group.

    Rows are ranked inside hash buckets of a group; the counts of earlier buckets (``buckets`` rows for
    each group) are added.  Rows equal in ``order`` share a bucket and are interchangeable.
    """
    cut = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
        .select(group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    )
    rank = F.row_number().over(Window.partitionBy(group, "_b").orderBy(*order))
    return (
        cut.withColumn("_r", rank).join(offsets, [group, "_b"])
        .withColumn(out, (F.col("_o") + F.col("_r") - 1).cast("bigint")).drop("_b", "_r", "_o")
    )


def shard_records(
    docs: DataFrame, shards: int = 24, weights: Sequence[float] | None = None,
    grown: int | None = None, key: str = "doc_id", text: str = "text", overhead: int = 8,
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, grown_shard`` of every row.

    ``size`` is the UTF-8 length plus ``overhead``; a NULL text has neither bytes nor a checksum other
    than that of the empty text.  A NULL key goes to one fixed shard.  Repeated rows stay apart in slots
    of their own.  Other columns are not read; an empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + overhead).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    k = F.col("doc_id")
    more = None if weights is None or grown is None else [*weights, *[1.0] * (grown - shards)]
    placed = rows.withColumn("shard", rendezvous_shard(k, shards, weights)).withColumn(
        "grown_shard", rendezvous_shard(k, grown, more) if grown else F.lit(None).cast("int")
    )
    return gapless_slots(placed, "shard", ["doc_id", "text_crc32", "size"])
