"""SimHash near-duplicates, linked through the general pigeonhole principle.

The 64 bits are grouped into partitions of correlated bits, and each partition gets a threshold of its own.
If the thresholds e_i satisfy sum(e_i + 1) = max_bits + 1, two fingerprints within ``max_bits`` agree in some
partition up to e_i bits (e_i = -1: the partition is not probed).  Dynamic programming picks the number of
partitions and the thresholds that cost least by the candidates estimated from the bit statistics of all
fingerprints; every choice is complete, so the plan changes cost and never the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecut.llm.common import run_path, written
from wavecut.llm.components import connected_components

BITS = 64
ROW_COST, PAIR_COST = 3e-6, 4e-9
GROUP_LIMIT = 20_000


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Majority of the bits of all shingles' XXH64; 0 without words; one shingle if words are few."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(joined, seed)]
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(words) - width + 1].tolist()
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1:].tolist())]
    h = np.array(hashes, dtype=np.uint64)
    return int(_pack((2 * bit_counts(h) > len(h))))


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have each bit set."""
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 255 * 512):
        bits = np.unpackbits(h[at:at + 255 * 512].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255
        if full:
            total += bits[:full].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[full:].sum(axis=0, dtype=np.uint8)
    return total


def _pack(bits: np.ndarray) -> np.uint64:
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<u8")[0]


def with_fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed 64-bit value) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, width, seed) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "doc_id long, fp long")


@dataclass(frozen=True)
class Plan:
    """Bits and threshold of each probed partition."""

    parts: tuple[tuple[tuple[int, ...], int], ...]
    cost: float

    def probes(self) -> list[tuple[int, np.ndarray, int]]:
        """``(mask, flips, threshold)``: the values that a fingerprint is filed under."""
        out = []
        for bits, e in self.parts:
            flips = [0]
            for r in range(1, _radius(e) + 1):
                flips += [sum(1 << b for b in c) for c in combinations(bits, r)]
            out.append((sum(1 << b for b in bits), np.array(flips, dtype=np.uint64), e))
        return out


def _radius(e: int) -> int:
    """Both sides of a pair go half of the way, rounded up, and meet at a common value."""
    return (e + 1) // 2


def _ball(n: int, r: int) -> int:
    return sum(math.comb(n, i) for i in range(r + 1))


def correlated_groups(together: np.ndarray, total: int, parts: int) -> list[list[int]]:
    """Cuts the bits into ``parts`` groups of near-equal size, each grown around its most correlated bits."""
    p = np.diag(together) / max(total, 1)
    cov = together / max(total, 1) - np.outer(p, p)
    scale = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    corr = np.abs(cov) / scale
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        inner = corr[np.ix_(free, free)]
        group = [free[int(np.argmax(inner.max(axis=1)))]]
        while len(group) < size:
            rest = [b for b in free if b not in group]
            group.append(max(rest, key=lambda b: (corr[b, group].mean(), -b)))
        groups.append(sorted(group))
        free = [b for b in free if b not in group]
    return groups


def allocate(total: int, together: np.ndarray, max_bits: int) -> Plan:
    """The cheapest partitioning with its thresholds."""
    p = np.diag(together) / max(total, 1)
    agree = p * p + (1 - p) * (1 - p)
    best: Plan | None = None
    for parts in range(1, max_bits + 2):
        groups = correlated_groups(together, total, parts)

        def cost(bits: list[int], e: int) -> float:
            if e < 0:
                return 0.0
            n, meet = len(bits), float(np.prod(agree[bits]))
            r, s = _radius(e), e - _radius(e)
            pairs = total * total / 2 * meet * _ball(n, r) * _ball(n, s) * (1 if r == s else 2)
            return total * _ball(n, r) * ROW_COST + pairs * PAIR_COST

        # least[s]: cheapest thresholds of the groups so far with sum(e + 1) = s
        least: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for bits in groups:
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for s, (c, chosen) in least.items():
                for e in range(-1, max_bits - s + 1):
                    option = (c + cost(bits, e), (*chosen, e))
                    if s + e + 1 not in step or option < step[s + e + 1]:
                        step[s + e + 1] = option
            least = step
        c, chosen = least[max_bits + 1]
        if best is None or c < best.cost:
            best = Plan(tuple((tuple(b), e) for b, e in zip(groups, chosen) if e >= 0), c)
    return best


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both bits i and j set: 64 x 64 sums over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both, n = both + bits.T @ bits, n + len(fp)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BITS * BITS + 1), pa.int32()), pa.array([*both.ravel().astype(np.int64), n], pa.int64())],
            names=["i", "n"],
        )

    sums = dict(prints.select("fp").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n")).collect())
    both = np.array([sums.get(i, 0) for i in range(BITS * BITS)], dtype=np.float64).reshape(BITS, BITS)
    return sums.get(BITS * BITS, 0), both


def spanning_edges(fp: np.ndarray, side: np.ndarray, near: int, max_bits: int) -> list[tuple[int, int]]:
    """Connects what lies within ``max_bits`` in one group, one edge for each member reached.

    ``side`` 2: filed under its own value, 1: under a value next to it.  ``near`` 0 or 1: only pairs
    with a member filed under its own value need to be compared; 2: all pairs.
    """
    fp, at = np.unique(fp, return_inverse=True)
    own = np.zeros(len(fp), dtype=bool)
    np.logical_or.at(own, at, side == 2)
    out, free = [], np.arange(len(fp))
    while len(free):
        root, queue, free = free[0], [free[0]], free[1:]
        while queue and len(free):
            x = queue.pop()
            hit = np.bitwise_count(fp[free] ^ fp[x]) <= max_bits
            if near < 2 and not own[x]:
                hit &= own[free]
            reached = free[hit]
            if len(reached):
                out += [(root, y) for y in reached]
                queue += reached.tolist()
                free = free[~hit]
    signed = fp.view(np.int64)
    return [(int(signed[a]), int(signed[b])) for a, b in out]


def near_links(prints: DataFrame, max_bits: int = 4, folder: str | None = None, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Edges ``a, b`` that connect all distinct fingerprints within ``max_bits``; few, not all pairs.

    Fingerprints filed under one value are compared in the task that gets the value.  Values with more
    than ``group_limit`` rows are cut into chunks and every pair of chunks is compared in a task of its own.
    """
    folder = folder or run_path(prints.sparkSession, "simhash")
    total, together = bit_statistics(prints)
    probes = allocate(total, together, max_bits).probes()

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for part, (mask, flips, _) in enumerate(probes):
                for at in range(0, len(flips), 64):
                    some = flips[at:at + 64]
                    values = ((fp & np.uint64(mask))[:, None] ^ some[None, :]).ravel()
                    side = np.tile(np.where(some == 0, 2, 1).astype(np.int8), len(fp))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(values), part, dtype=np.int8)), pa.array(values.view(np.int64)),
                         pa.array(np.repeat(fp, len(some)).view(np.int64)), pa.array(side)],
                        names=["part", "value", "fp", "side"],
                    )

    filed = prints.select("fp").mapInArrow(file, "part byte, value long, fp long, side byte")
    large = filed.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_limit)
    chunks = F.ceil(F.col("n") / group_limit).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    dealt = filed.join(large, ["part", "value"], "left").withColumn("own", F.coalesce(own, F.lit(0))).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.coalesce(chunks, F.lit(1)) - 1))
    ).select(
        "part", "value", F.least("own", "other").alias("c"), F.greatest("own", "other").alias("d"), "fp", "side"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)])
            cols = [np.concatenate(x) for x in zip(*held)]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            if len(change):
                yield _edges([c[:change[-1]] for c in cols], change[:-1])
                held = [[c[change[-1]:] for c in cols]]
            else:
                held = [cols]
        if held and len(held[0][0]):
            yield _edges([np.concatenate(x) for x in zip(*held)], np.zeros(0, dtype=np.int64))

    def _edges(cols: list[np.ndarray], change: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate([[0], change])
        ends = np.concatenate([change, [len(cols[0])]])
        fp, side, found = cols[4].view(np.uint64), cols[5], []
        for k in np.flatnonzero(ends - starts > 1).tolist():
            a, b = int(starts[k]), int(ends[k])
            found += spanning_edges(fp[a:b], side[a:b], probes[cols[0][a]][2], max_bits)
        return pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"]
        )

    keys = ["part", "value", "c", "d"]
    ordered = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, max_bits: int = 4, width: int = 4, key: str = "doc_id", text: str = "text", folder: str | None = None
) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; the component is named by its smallest ``doc_id``.

    Equal fingerprints are one class and are never paired.  NULL and word-less texts have fingerprint 0
    and are linked like any other.  Rows with a NULL id belong to a component but never name it; its name
    is NULL if no row has an id.  Repeated rows are kept.  An empty table gives no rows.
    """
    folder = folder or run_path(docs.sparkSession, "simhash")
    prints = written(with_fingerprints(docs, width, key=key, text=text), f"{folder}/prints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), f"{folder}/classes")
    links = near_links(classes, max_bits, folder)
    roots = written(connected_components(links, f"{folder}/components").withColumnRenamed("node", "fp"), f"{folder}/roots")
    members = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = members.groupBy("root").agg(F.min("first").alias("component_id"))
    named = members.join(first, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one_of_each(docs: DataFrame, max_bits: int = 4, width: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of the document that names its component; all columns as they came, whatever their names.

    Rows without an id cannot be named as duplicates and stay.  Repeated rows of a kept document stay.
    """
    found = near_duplicates(docs, max_bits, width, key=key, text=text)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")
