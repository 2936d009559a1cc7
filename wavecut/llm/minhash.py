"""Near-duplicates by the Jaccard similarity of word shingles: MinHash bands and sequential Bayesian verification.

Sets that share a band of minima are candidates.  A candidate pair's signatures are compared batch by batch; after
each batch the posterior of its similarity, given the agreements so far and a uniform prior, bounds the chance that
the pair is similar enough, and the pair is pruned where that chance is below ``miss``.  Survivors are verified on
their full sets.

Equal sets are one class and are never paired.  Each member of a band's group meets the group's first member; groups
that this leaves in several parts are compared in full, in chunks bounded by rows and bytes, every two chunks in a
task of their own; what is connected already is not compared again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecut.llm.common import mix64, run_path, written
from wavecut.llm.components import connected_components
from wavecut.llm.encode import _Bounded
from wavecut.sources.storage import join_small

WIDTH, SIMILARITY = 4, (80, 100)
BANDS, BAND_ROWS, BATCH = 24, 4, 16
HASHES = BANDS * BAND_ROWS
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | bytes | None, known: _Bounded, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of all words if they are fewer; empty without words."""
    raw = (text.encode() if isinstance(text, str) else text or b"").lower()
    words = _WORD.findall(raw)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(len(words), width)
    if not n:
        return h
    out = np.full(len(words) - n + 1, n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = (out ^ (out >> np.uint64(29))) * _ODD + h[j:j + len(out)]
    return np.unique(mix64(out))


def word_hashes(limit: int = 400_000) -> _Bounded:
    return _Bounded(xxhash.xxh64_intdigest, limit)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The low half of ``HASHES`` minima of each set; no set may be empty."""
    flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    seeds = mix64(np.arange(2 * HASHES, dtype=np.uint64), 11).reshape(2, HASHES)
    out = np.empty((len(sets), HASHES), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k, (x, m) in enumerate(zip(seeds[0], seeds[1] | np.uint64(1))):
            h = (flat ^ x) * m
            low = np.minimum.reduceat(h ^ (h >> np.uint64(32)), starts)
            out[:, k] = (low ^ (low >> np.uint64(32))).astype(np.uint32)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One signed 64-bit key for each band of each signature."""
    keys = np.zeros((len(minima), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        h = np.full(len(minima), b, dtype=np.uint64)
        for k in range(BAND_ROWS):
            h = mix64(h ^ minima[:, b * BAND_ROWS + k].astype(np.uint64))
        keys[:, b] = h
    return keys.view(np.int64)


@lru_cache(maxsize=8)
def least_agreements(similarity: float, miss: float) -> tuple[int, ...]:
    """For each number of compared batches, the fewest agreements that keep a pair.

    With m of h agreements and a uniform prior the similarity is Beta(m + 1, h - m + 1) distributed; it is at least s with
    the probability that of h + 1 trials at s no more than m succeed.  Pairs below ``miss`` are pruned.
    """
    out = []
    for h in range(BATCH, HASHES + 1, BATCH):
        chance, m = 0.0, 0
        while True:
            chance += comb(h + 1, m) * similarity**m * (1 - similarity) ** (h + 1 - m)
            if chance >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, similarity: float, miss: float) -> np.ndarray:
    """Indices of the pairs of signatures ``a[i], b[i]`` that no batch prunes; ``a`` may be one signature for all."""
    left = np.arange(len(b))
    agreed = np.zeros(len(b), dtype=np.int64)
    for k, least in enumerate(least_agreements(similarity, miss)):
        some = slice(k * BATCH, (k + 1) * BATCH)
        mine = a[some] if a.ndim == 1 else a[left, some]
        agreed = agreed + (mine == b[left, some]).sum(axis=1)
        keep = agreed >= least
        left, agreed = left[keep], agreed[keep]
        if not len(left):
            break
    return left


def similar(a: np.ndarray, b: np.ndarray, ratio: tuple[int, int]) -> bool:
    """In whole numbers: ``ratio[1] * intersection >= ratio[0] * union``."""
    if ratio[1] * min(len(a), len(b)) < ratio[0] * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return ratio[1] * common >= ratio[0] * (len(a) + len(b) - common)


def connecting_pairs(
    sets: list[np.ndarray], minima: np.ndarray, part: np.ndarray, cross: np.ndarray, ratio: tuple[int, int], miss: float
) -> list[tuple[int, int]]:
    """Pairs of similar sets that connect the parts of a group; ``cross`` tells the two chunks compared apart, if any."""
    out, part, several = [], part.copy(), len(np.unique(cross)) > 1
    for i in range(len(sets) - 1):
        rest = np.flatnonzero(part[i + 1:] != part[i]) + i + 1
        if several:
            rest = rest[cross[rest] != cross[i]]
        if not len(rest):
            continue
        for j in rest[survivors(minima[i], minima[rest], ratio[0] / ratio[1], miss)].tolist():
            if part[i] != part[j] and similar(sets[i], sets[j], ratio):
                out.append((i, j))
                part[part == part[j]] = part[i]
    return out


def with_sets(rows: DataFrame, width: int) -> DataFrame:
    """``doc_id, h, whole, n, keys, minima`` of every ``doc_id, t, h``; ``whole`` names the set, NULL for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_hashes()
        for all_ in batches:
            for first in range(0, all_.num_rows, 400):
                batch = all_.slice(first, 400)
                sets = [shingle_set(t, known, width) for t in batch.column(1).to_pylist()]
                real = [s for s in sets if len(s)]
                minima = signatures(real) if real else np.empty((0, HASHES), dtype=np.uint32)
                at = np.cumsum([bool(len(s)) for s in sets]) - 1
                keys = band_keys(minima)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array([whole_hash(s) if len(s) else None for s in sets], pa.int64()),
                     pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([keys[k].tolist() if len(s) else None for s, k in zip(sets, at)], pa.list_(pa.int64())),
                     pa.array([minima[k].tobytes() if len(s) else None for s, k in zip(sets, at)], pa.binary())],
                    names=["doc_id", "h", "whole", "n", "keys", "minima"],
                )

    return rows.mapInArrow(run, "doc_id long, h long, whole long, n long, keys array<long>, minima binary")


def whole_hash(s: np.ndarray) -> int:
    """One signed 64-bit value for a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), len(s))).astype(np.int64))


def similar_links(
    rows: DataFrame, sets: DataFrame, width: int, ratio: tuple[int, int], miss: float, folder: str, chunk_rows: int, chunk_bytes: int
) -> DataFrame:
    """Edges ``a, b`` between classes of equal sets that connect all similar ones; few, not all pairs."""
    similarity = ratio[0] / ratio[1]
    classes = written(
        sets.where("whole is not null").groupBy("whole").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("minima").alias("minima")),
        f"{folder}/classes",
    )
    filed = classes.select("whole", "n", F.explode("keys").alias("key"))
    groups = filed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"), F.min("whole").alias("lead")).where("members > 1")
    members = written(filed.join(groups, "key"), f"{folder}/members")

    # Every member against the first of its group: pruned on the signatures, then verified on the sets.
    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ma, mb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint32).reshape(-1, HASHES) for k in (2, 3))
            kept = pa.array(survivors(ma, mb, similarity, miss))
            yield pa.RecordBatch.from_arrays([batch.column(k).take(kept) for k in (0, 1)], names=["a", "b"])

    signed = classes.select("whole", "minima")
    of_a, of_b = (signed.select(F.col("whole").alias(x), F.col("minima").alias(f"m{x}")) for x in "ab")
    met = members.where("whole <> lead").select(F.col("lead").alias("a"), F.col("whole").alias("b")).distinct()
    candidates = written(met.join(of_a, "a").join(of_b, "b").select("a", "b", "ma", "mb").mapInArrow(prune, "a long, b long"), f"{folder}/candidates")

    texts_of = sets.where("whole is not null").groupBy("whole").agg(F.min("h").alias("h"))

    def gathered(wanted: DataFrame, name: str) -> DataFrame:
        """``whole, grams`` of the wanted classes: one text of each is read again, found by its hash."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = word_hashes()
            for batch in batches:
                found = [shingle_set(t, known, width) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([whole_hash(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())],
                    names=["whole", "grams"],
                )

        named = written(texts_of.join(wanted, "whole", "left_semi").select("h").distinct(), f"{folder}/{name}-named")
        texts = join_small(rows.select("h", "t").where("t is not null"), named, ["h"]).dropDuplicates(["h"]).select("t")
        return written(texts.mapInArrow(run, "whole long, grams binary").dropDuplicates(["whole"]), f"{folder}/{name}")

    ends = candidates.select(F.col("a").alias("whole")).union(candidates.select(F.col("b").alias("whole"))).distinct()
    grams = gathered(ends, "grams")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ga, gb = (batch.column(k).to_pylist() for k in (2, 3))
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), ratio) for x, y in zip(ga, gb)]
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    of_a, of_b = (grams.select(F.col("whole").alias(x), F.col("grams").alias(f"g{x}")) for x in "ab")
    led = written(candidates.join(of_a, "a").join(of_b, "b").select("a", "b", "ga", "gb").mapInArrow(verify, "a long, b long"), f"{folder}/led")

    # What the first members have connected is one part; groups that still have several parts are compared in full,
    # but for the pairs inside the first member's part.  Of groups with the same members one is enough.
    roots = written(connected_components(led, f"{folder}/led-components"), f"{folder}/led-roots")
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    parts = members.where("members > 2").join(root_of("whole"), "whole", "left").join(root_of("lead"), "lead", "left").select(
        "key", "whole", "n", F.coalesce("whole_root", "whole").alias("part"), F.coalesce("lead_root", "lead").alias("lead_part")
    ).withColumn("led", F.col("part") == F.col("lead_part"))
    sums = [F.sum(F.when(F.col("led") == led_, c).otherwise(0)).alias(name) for name, led_, c in (
        ("led_rows", True, F.lit(1)), ("led_shingles", True, F.col("n")), ("rows", False, F.lit(1)), ("shingles", False, F.col("n")))]
    several = parts.groupBy("key").agg(*sums, F.sum(F.xxhash64("whole").cast("decimal(38,0)")).alias("who")).where("rows > 0")
    one = several.groupBy("led_rows", "led_shingles", "rows", "shingles", "who").agg(F.min("key").alias("key"))
    open_ = written(parts.join(one, "key"), f"{folder}/open")
    wanted = open_.select("whole").distinct()
    open_grams = gathered(wanted.join(grams, "whole", "left_anti"), "open-grams").union(grams.join(wanted, "whole", "left_semi"))
    count = lambda r, n: F.greatest(F.ceil(F.col(r) / chunk_rows), F.ceil(F.col(n) * 8 / chunk_bytes)).cast("int")
    led_chunks, chunks = count("led_rows", "led_shingles"), count("rows", "shingles")
    own = F.when(F.col("led"), F.pmod(F.xxhash64("whole"), led_chunks)).otherwise(led_chunks + F.pmod(F.xxhash64("whole"), chunks)).cast("int")
    first_other = F.when(F.col("led"), led_chunks).otherwise(0)
    dealt = open_.withColumn("own", own).withColumn("other", F.explode(F.sequence(first_other, led_chunks + chunks - 1))).select(
        "key", F.least("own", "other").alias("c"), F.greatest("own", "other").alias("d"), "whole", "own", "part"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def edges() -> pa.RecordBatch:
            sets_ = [np.frombuffer(h[3], np.uint64) for h in held]
            minima = np.frombuffer(b"".join(h[4] for h in held), dtype=np.uint32).reshape(-1, HASHES)
            part, own = (np.array([h[k] for h in held], dtype=np.int64) for k in (2, 1))
            links = connecting_pairs(sets_, minima, part, own, ratio, miss)
            return pa.RecordBatch.from_arrays([pa.array([held[p[k]][0] for p in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for k, c, d, *member in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if (k, c, d) != at:
                    if held:
                        yield edges()
                    held, at = [], (k, c, d)
                held.append(member)
        if held:
            yield edges()

    place = ["key", "c", "d"]
    full = dealt.join(open_grams, "whole").join(signed, "whole").select(*place, "whole", "own", "part", "grams", "minima")
    return led.union(full.repartition(*place).sortWithinPartitions(*place).mapInArrow(compare, "a long, b long"))


def near_copies(
    docs: DataFrame, ratio: tuple[int, int] = SIMILARITY, width: int = WIDTH, miss: float = 1e-7, key: str = "doc_id", text: str = "text",
    folder: str | None = None, chunk_rows: int = 2000, chunk_bytes: int = 1 << 25,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Rows are linked where ``ratio[1] * |A & B| >= ratio[0] * |A | B|`` for their sets of distinct word shingles; words
    are without case of A-Z.  The component is named by its smallest ``doc_id``; ``kept``: that is the row's own.  Two
    sets of similarity s share a band with probability 1 - (1 - s^4)^24 (0.999997 at 0.8), and a pair that does is pruned
    wrongly with a posterior probability below ``miss`` at each of six looks.  No link is made below the ratio.

    NULL, empty and word-less texts have no shingles and are linked with nothing; a text of fewer words than a shingle
    has all its words as one.  Rows without an id link others and never name a component: its id is NULL if no row has
    one, and such rows are kept only then.  Repeated rows are returned each.  Texts may be of any length; other columns
    are not read, whatever their names.  An empty table gives no rows.
    """
    folder = folder or run_path(docs.sparkSession, "minhash")
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("t")).withColumn("h", F.xxhash64("t"))
    sets = written(with_sets(rows, width), f"{folder}/sets")
    links = similar_links(rows, sets, width, ratio, miss, folder, chunk_rows, chunk_bytes)
    roots = written(connected_components(links, f"{folder}/components").withColumnRenamed("node", "whole"), f"{folder}/roots")
    classes = sets.where("whole is not null").groupBy("whole").agg(F.min("doc_id").alias("first"))
    named = classes.join(roots, "whole", "left").withColumn("root", F.coalesce("root", "whole"))
    first = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = named.join(first, "root").select("whole", "component_id")
    linked = sets.where("whole is not null").join(of_class, "whole").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sets.where("whole is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
