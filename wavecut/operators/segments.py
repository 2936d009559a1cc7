"""Row numbering, cutting into segments, projections, filters and unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecut.sources.storage import cut_lineage, join_small

KEYS = ("seg",)
#: Bits of an id block that is never split, and rows that a larger one may hold.
SAFE_BITS, BLOCK_ROWS = 20, 1 << 20


def with_row_id(df: DataFrame, start: int | Column = 0, out: str = "uid") -> DataFrame:
    """Unique, increasing (not consecutive) row id, shifted by ``start`` for a second set."""
    shift = start if isinstance(start, Column) else F.lit(start)
    return df.withColumn(out, F.monotonically_increasing_id() + shift)


def max_row_id(df: DataFrame, uid: str = "uid") -> DataFrame:
    """One row ``m``: the largest row id."""
    return df.agg(F.max(uid).alias("m"))


def _exclusive_offsets(counts: DataFrame, block: str, parent_bits: int = 12) -> DataFrame:
    """``(block, offset)``: rows in all smaller blocks.

    Two levels: a window inside groups of at most ``2**parent_bits`` blocks and
    one over the group totals.  With 2**20 ids per block the upper level has one
    row per 4 billion ids, so the only single-partition step stays small for any
    table.
    """
    parent = F.shiftright(F.col(block), parent_bits)
    before = (Window.unboundedPreceding, -1)
    totals = counts.groupBy(parent.alias("_parent")).agg(F.sum("_n").alias("_n"))
    upper = totals.select(
        "_parent",
        F.coalesce(F.sum("_n").over(Window.orderBy("_parent").rowsBetween(*before)), F.lit(0)).alias("_up"),
    )
    inside = Window.partitionBy("_parent").orderBy(block).rowsBetween(*before)
    return (
        counts.withColumn("_parent", parent)
        .withColumn("_low", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(upper, "_parent")
        .select(block, (F.col("_up") + F.col("_low")).alias("_offset"))
    )


def consecutive_index(
    df: DataFrame, order_by: str = "uid", out: str = "idx", block_bits: int = 20, ties: Sequence[str] = ()
) -> DataFrame:
    """Global 1-based row index in the order of a unique integer column.

    Rows are numbered inside blocks of ``2**block_bits`` ids and shifted by the
    number of rows in earlier blocks.  Ids are unique, so no block, and no task,
    can exceed ``2**block_bits`` rows however the ids are spread.  Block counts
    come from a scan of the id column alone and are pre-aggregated map-side.
    For 64-bit hashes use a larger ``block_bits`` (the values are spread evenly)
    and name the columns that break ties.  Where a block of more than ``2**SAFE_BITS`` ids holds over ``BLOCK_ROWS``
    rows after all, as with row ids made by Spark, all blocks are made narrower.
    A NULL id has no place in the order and fails the job.
    """
    kind = df.schema[order_by].dataType
    said = F.raise_error(F.lit(f"NULL in {order_by}: the row has no place in the order")).cast(kind)
    df = df.withColumn(order_by, F.coalesce(F.col(order_by), said))
    place = F.col(order_by).cast("bigint")
    while block_bits > SAFE_BITS:
        held = df.groupBy(F.shiftright(place, block_bits).alias("_block")).agg(F.count(F.lit(1)).alias("_n"))
        if (held.agg(F.max("_n")).first()[0] or 0) <= BLOCK_ROWS:
            break
        block_bits = max(SAFE_BITS, block_bits - 10)
    block = F.shiftright(place, block_bits)
    blocked = df.withColumn("_block", block)
    counts = blocked.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _exclusive_offsets(counts, "_block")
    in_block = F.row_number().over(Window.partitionBy("_block").orderBy(order_by, *ties))
    return (
        blocked.withColumn("_rn", in_block)
        .join(offsets, "_block")
        .withColumn(out, F.col("_offset") + F.col("_rn"))
        .drop("_block", "_rn", "_offset")
    )


def file_order_index(rows: DataFrame, out: str = "idx", within: str | None = None) -> DataFrame:
    """1-based row index in the order of file name, split and row, without moving a raw row.

    ``rows`` has ``_file``, ``_split`` (byte offset of the input split) and ``_id``
    (``monotonically_increasing_id``, consecutive inside a split).  One row for each input split is
    ordered and summed; a raw row adds its distance from the first row of its split.  ``within``
    counts from 1 in each value of that column, for example in each file.
    """
    keys = ["_file", "_split", *([within] if within else [])]
    splits = cut_lineage(rows.groupBy(*keys).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")))
    order = Window.partitionBy(within) if within else Window
    before = order.orderBy("_file", "_split").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1
    offsets = cut_lineage(splits.select("_file", "_split", shift.alias("_shift")))
    largest = splits.groupBy("_file", "_split").agg(F.sum("_n").alias("_n")).agg(F.max("_n")).first()[0] or 0
    placed = join_small(rows, offsets, ["_file", "_split"], largest=largest)
    return placed.withColumn(out, F.col("_id") + F.col("_shift")).drop("_file", "_split", "_id", "_shift")


def with_segments(df: DataFrame, seg_len: int, idx: str = "idx") -> DataFrame:
    """Adds ``seg`` and the 1-based position ``no``; no shuffle is needed."""
    if seg_len <= 0:
        raise ValueError("seg_len must be positive")
    return df.withColumn("seg", F.expr(f"({idx} - 1) div {seg_len}")).withColumn(
        "no", F.col(idx) - F.col("seg") * seg_len
    )


def complete_values(df: DataFrame, value: str = "x", keys: Sequence[str] = KEYS) -> DataFrame:
    """Fails on a NULL value, naming its segment and position.

    Features that look at neighbouring rows have no frame to speak of where a sample is missing, so a
    NULL is refused there instead of being skipped.
    """
    said = F.concat(
        F.lit("NULL value in segment "), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)),
        F.lit(" at position "), F.coalesce(F.col("no").cast("string"), F.lit("NULL")),
    )
    kind = df.schema[value].dataType
    return df.withColumn(value, F.coalesce(F.col(value), F.raise_error(said).cast(kind)))


def only_lengths(grouped: DataFrame, good: Column, keys: Sequence[str], rows: str, wanted: str) -> DataFrame:
    """Fails on a segment whose row count ``rows`` is not ``good``."""
    said = F.concat(
        F.lit("segment "), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)), F.lit(" has "),
        F.col(rows).cast("string"), F.lit(f" rows, not {wanted}"),
    )
    return grouped.where(F.coalesce(F.when(good, F.lit(True)), F.raise_error(said).cast("boolean")))


def with_position(df: DataFrame, keys: Sequence[str] = KEYS, order_by: str = "uid", out: str = "no") -> DataFrame:
    """Position inside an already known segment, by rank of ``order_by``."""
    w = Window.partitionBy(*keys).orderBy(order_by)
    return df.withColumn(out, F.row_number().over(w).cast("bigint"))


def segment_label(seg: Column, prefix: str = "raw_", width: int = 4) -> Column:
    """``raw_0007``; numbers longer than ``width`` keep all their digits."""
    text = seg.cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0")))


def file_label(file_name: Column) -> Column:
    """File-name stem: ``seg_12ab.csv`` -> ``seg_12ab``."""
    return F.substring_index(F.substring_index(file_name, "/", -1), ".", 1)


def number_signal(
    df: DataFrame, seg_len: int, set_tag: int = 0, order_by: str = "uid"
) -> DataFrame:
    """Raw ``x, y`` rows with an id -> ``uid, set, seg, no, name, x, y``.

    Rows that carry their place in the files (``read_ordered_csv``) are numbered in file order and
    get their index as ``uid``; others in the order of the id.
    """
    if {"_file", "_split", "_id"} <= set(df.columns):
        indexed = file_order_index(df)
        numbered = with_segments(indexed.withColumn(order_by, F.col("idx")), seg_len)
    else:
        numbered = with_segments(consecutive_index(df, order_by), seg_len)
    if "y" not in df.columns:
        numbered = with_null_target(numbered)
    return numbered.select(
        F.col(order_by).alias("uid"),
        F.lit(set_tag).alias("set"),
        "seg",
        "no",
        segment_label(F.col("seg")).alias("name"),
        "x",
        "y",
    )


def with_null_target(df: DataFrame, out: str = "y") -> DataFrame:
    return df.withColumn(out, F.lit(None).cast("double"))


def union_sets(*tables: DataFrame) -> DataFrame:
    """Union by column name (sets, batches, fold results)."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def segment_counts(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def incomplete_segments(df: DataFrame, seg_len: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Completeness report: segments whose row count differs from ``seg_len``."""
    return segment_counts(df, keys).where(F.col("n") != seg_len)


def drop_partial(df: DataFrame, seg_len: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keeps segments of exactly ``seg_len`` rows (left-semi join on the counts)."""
    full = segment_counts(df, keys).where(F.col("n") == seg_len)
    return df.join(full, list(keys), "left_semi")


def drop_partial_tail(df: DataFrame, seg_len: int, rows: DataFrame) -> DataFrame:
    """Same for a gap-free numbering, where only the last segment can be short.

    ``rows`` is a one-row count; it becomes a scalar subquery answered from the
    Parquet footers, so no join or second pass over the signal is planned.
    """
    total = rows.scalar()
    return df.where(F.col("seg") < F.floor(total / seg_len))


def holdout_split(df: DataFrame, cut: int | Column) -> tuple[DataFrame, DataFrame]:
    """Time-ordered split: segments below ``cut`` train, the others are held out."""
    return df.where(F.col("seg") < cut), df.where(F.col("seg") >= cut)


def position_range(df: DataFrame, first: int, last: int) -> DataFrame:
    """Rows with ``first <= no <= last``."""
    return df.where(F.col("no").between(first, last))


def point_target(df: DataFrame, position: int, value: str = "y") -> DataFrame:
    """The target at one position of each segment."""
    return df.where(F.col("no") == position).select("seg", value)


def multi_point_targets(
    df: DataFrame, positions: Sequence[int], keys: Sequence[str] = KEYS, value: str = "y"
) -> DataFrame:
    """Targets at several positions, one column each, from a single scan.

    Segments that lack one of the positions are dropped, as an inner self-join
    on every position would do.
    """
    picked = df.where(F.col("no").isin(*positions)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_hits"),
        *(F.max(F.when(F.col("no") == p, F.col(value))).alias(f"y{i}") for i, p in enumerate(positions)),
    )
    return picked.where(F.col("_hits") == len(positions)).drop("_hits")


def last_values(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "y", order_by: str = "no") -> DataFrame:
    """Chunk target: the value on the last row of each segment, partial ones too."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max_by(value, order_by).alias(value)
    )


def systematic_sample(df: DataFrame, step: int, idx: str = "idx") -> DataFrame:
    """Every ``step``-th row of the signal, starting with the first."""
    return df.where(F.pmod(F.col(idx) - 1, F.lit(step)) == 0)


def restrict_to_keys(df: DataFrame, key_list: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in the list (left-semi join)."""
    return df.join(key_list.select(on), on, "left_semi")


def suffixed(df: DataFrame, suffix: str, keep: Sequence[str] = ()) -> DataFrame:
    """All columns renamed to ``<name><suffix>`` but for those in ``keep``."""
    return df.select(*(F.col(c) if c in keep else F.col(c).alias(c + suffix) for c in df.columns))


def in_signal_order(df: DataFrame, order: Sequence[str] = ("set", "seg", "no", "uid")) -> DataFrame:
    return df.orderBy(*order)
