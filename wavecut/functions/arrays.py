"""Array expressions used by the spectral operators (all evaluated in the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def packed(position: Column, value: Column) -> Column:
    """Aggregate: the values of a group as one array ordered by ``position``."""
    rows = F.collect_list(F.struct(position.alias("p"), value.alias("v")))
    return F.transform(F.array_sort(rows), lambda r: r["v"])


def slice_bounds(slice_len: int, n_slices: int, shared_edge: bool = True) -> list[tuple[int, int]]:
    """Inclusive position ranges of the slices of a segment.

    With ``shared_edge`` neighbouring slices both hold the row on their border,
    so every slice but the first has ``slice_len + 1`` rows.
    """
    out = []
    for i in range(n_slices):
        first = i * slice_len + (0 if shared_edge and i > 0 else 1)
        out.append((first, (i + 1) * slice_len))
    return out


def array_slices(values: Column, slice_len: int, n_slices: int, shared_edge: bool = True) -> list[Column]:
    """The slices of an array packed from gap-free positions 1, 2, ..."""
    return [
        F.slice(values, first, last - first + 1)
        for first, last in slice_bounds(slice_len, n_slices, shared_edge)
    ]


def overlapping_band_means(values: Column, count: int, step: int, width: int, divisor: float) -> Column:
    """``sum(abs(values[step*i : step*i+width])) / divisor`` for i in 0..count-1.

    When the width is a multiple of the step every element is visited once:
    sums of ``step`` elements are built first and added up per band.
    """
    def absolute_sum(start: Column, length: int) -> Column:
        return F.aggregate(F.slice(values, start, length), F.lit(0.0), lambda a, v: a + F.abs(v))

    if width % step:
        bands = F.sequence(F.lit(0), F.lit(count - 1))
        return F.transform(bands, lambda i: absolute_sum(i * step + 1, width) / F.lit(float(divisor)))
    per_band = width // step
    blocks = F.transform(
        F.sequence(F.lit(0), F.lit(count + per_band - 2)),
        lambda b: absolute_sum(b * step + 1, step),
    )
    # the one-element outer transform binds the block sums so that they are computed once
    bound = F.transform(
        F.array(blocks),
        lambda sums: F.transform(
            F.sequence(F.lit(1), F.lit(count)),
            lambda i: F.aggregate(F.slice(sums, i, per_band), F.lit(0.0), lambda a, v: a + v)
            / F.lit(float(divisor)),
        ),
    )
    return F.element_at(bound, 1)


def band_range(values: Column, first: int, last: int) -> Column:
    """Elements ``first..last`` (0-based, both included)."""
    return F.slice(values, first + 1, last - first + 1)
