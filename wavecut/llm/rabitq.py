"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector is turned by a random rotation and kept as the signs of its components, with two correction scalars:
its length and the cosine between it and its signs.  Inner products are estimated from the packed bits with an
error bound; vectors whose bound reaches the k-th best exact score so far are scored exactly on the originals.
Queries meet the codes in blocks of bounded size; every vector is in the index and every block is searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecut.llm.common import run_path, written


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths, and cosines between vectors and their signs."""
    turned = vectors @ rotation(vectors.shape[1], seed).T
    length = np.linalg.norm(vectors, axis=1)
    cosine = np.abs(turned).sum(axis=1) / (np.sqrt(vectors.shape[1]) * length)
    return np.packbits(turned > 0, axis=1), length, cosine


def estimates(codes: np.ndarray, length: np.ndarray, cosine: np.ndarray, queries: np.ndarray, seed: int, epsilon: float):
    """Estimated inner products and half-widths of their bounds, both queries x vectors."""
    dim = queries.shape[1]
    turned = (queries @ rotation(dim, seed).T).astype(np.float32)
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    scale = (length / (cosine * np.sqrt(dim))).astype(np.float32)
    spread = length * np.sqrt(np.maximum(1 - cosine**2, 0)) / cosine * epsilon / np.sqrt(max(dim - 1, 1))
    estimate = (turned @ signs.T) * scale
    return estimate, np.linalg.norm(queries, axis=1)[:, None].astype(np.float32) * spread.astype(np.float32)


def search_block(
    vectors: np.ndarray, codes: np.ndarray, length: np.ndarray, cosine: np.ndarray, queries: np.ndarray,
    k: int, seed: int, epsilon: float, chunk: int = 64,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(query, rows, scores)``: all rows that can be among the ``k`` nearest, scored exactly."""
    for at in range(0, len(queries), chunk):
        some = queries[at:at + chunk]
        estimate, half = estimates(codes, length, cosine, some, seed, epsilon)
        upper = estimate + half
        for i, q in enumerate(some):
            if len(vectors) > 4 * k:
                first = np.argpartition(-estimate[i], 4 * k)[: 4 * k]
                exact = np.sort(vectors[first] @ q)
                rows = np.flatnonzero(upper[i] >= exact[-k] - 1e-5 * np.abs(exact[-k]))
                rows = np.union1d(rows, first)
            else:
                rows = np.arange(len(vectors))
            yield at + i, rows, vectors[rows] @ q


def usable(vector: str) -> Column:
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def build_index(vectors: DataFrame, k: int, block_rows: int, seed: int) -> DataFrame:
    """``dim, block, ids, v, code, length, cosine``: one row for each distinct vector.

    Of equal vectors only the ``k + 1`` smallest ids can be among the k nearest of a query.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            dims = batch.column(0).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                code, length, cosine = encode(_matrix(part.column(3), int(dim)), seed)
                out.append(pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(length), pa.array(cosine)],
                    names=[*batch.schema.names, "code", "length", "cosine"],
                ))
            yield from out

    near = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    classes = vectors.withColumn("r", near).where(F.col("r") <= k + 1).groupBy("v").agg(
        F.sort_array(F.collect_set("vec_id")).alias("ids")
    )
    sizes = vectors.groupBy(F.size("v").alias("dim")).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
    blocks = classes.withColumn("dim", F.size("v")).join(sizes, "dim").select(
        "dim", F.pmod(F.xxhash64("v"), "blocks").cast("int").alias("block"), "ids", "v"
    )
    return blocks.mapInArrow(
        run, "dim int, block int, ids array<long>, v array<double>, code binary, length double, cosine double"
    )


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest(
    embeddings: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", seed: int = 11,
    epsilon: float = 3.5, block_rows: int = 16_384, query_rows: int = 2_048, folder: str | None = None,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of each row that ``queries`` selects.

    Exact scores in double precision, nearest first, ties to the smaller id; all candidates if they are
    fewer than ``k``.  Rows without an id and vectors that are NULL, empty, zero or hold NULL or
    non-finite components take no part.  Vectors are compared with those of their length.  Repeated rows
    count once, and a row with the id of the query is the query's own.  An empty table gives no rows.
    """
    folder = folder or run_path(embeddings.sparkSession, "nearest")
    rows = embeddings.where(usable(vector) & F.col(key).isNotNull())
    plain = rows.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    index = written(build_index(plain, k, block_rows, seed), f"{folder}/index")
    asked = rows.where(queries).select(
        F.col(key).cast("bigint").alias("query_id"), F.col(vector).cast("array<double>").alias("q")
    ).withColumn("dim", F.size("q"))
    # Every block of codes meets every chunk of queries of the same length, in a task of its own.
    chunks = asked.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("chunks"))
    blocks = index.groupBy("dim").agg((F.max("block") + 1).alias("blocks"))
    shape = chunks.join(blocks, "dim")
    left = index.join(shape, "dim").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks", "blocks")
    right = asked.join(shape, "dim").select(
        "dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("query_id"), "chunks").cast("int").alias("chunk"), "query_id", "q",
    )

    def search(of_block: pa.Table, of_queries: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if of_block.num_rows and of_queries.num_rows:
            dim = of_block.column("dim")[0].as_py()
            vectors, asked_for = _matrix(of_block.column("v"), dim), _matrix(of_queries.column("q"), dim)
            codes = np.frombuffer(b"".join(of_block.column("code").to_pylist()), dtype=np.uint8).reshape(len(vectors), -1)
            ids = of_block.column("ids").combine_chunks()
            flat, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
            names = of_queries.column("query_id").to_numpy()
            lengths, cosines = of_block.column("length").to_numpy(), of_block.column("cosine").to_numpy()
            for i, found, scores in search_block(vectors, codes, lengths, cosines, asked_for, k + 1, seed, epsilon):
                best = np.argsort(-scores, kind="stable")
                cut = scores[best[min(k, len(best) - 1)]]
                best = best[scores[best] >= cut]
                many = offsets[found[best] + 1] - offsets[found[best]]
                v = np.concatenate([flat[offsets[r]:offsets[r + 1]] for r in found[best]])
                s = np.repeat(scores[best], many)
                other = v != names[i]
                v, s = v[other], s[other]
                first = np.lexsort((v, -s))[:k]
                out_q.append(np.full(len(first), names[i]))
                out_v.append(v[first])
                out_s.append(s[first])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
        return pa.table({"query_id": join(out_q, np.int64), "vec_id": join(out_v, np.int64), "score": join(out_s, np.float64)})

    keys = ("dim", "block", "chunk")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
