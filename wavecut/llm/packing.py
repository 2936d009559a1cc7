"""Mixture-controlled packing: deficit round-robin over one queue for each source.

Documents are dealt by hash into blocks.  Each block runs deficit round-robin over its queues, one task for
a block, and the deficits that the earlier blocks leave behind are known beforehand from prefix sums over a
small (block, source) table: share * tokens so far - tokens of the source so far.  Windows are cut from the
tokens of all blocks end to end, so that a window runs on across a block border and only the very last
window of the table is padded.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavecut.llm.common import run_path, written
from wavecut.llm.encode import word_encoder

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
)


class _Queue:
    __slots__ = ("docs", "share", "deficit", "at", "name")

    def __init__(self, name, docs, share: float, deficit: float):
        self.name, self.docs, self.share, self.deficit, self.at = name, docs, share, deficit, 0


def deficit_round_robin(
    queues: list[_Queue], position: int, window: int, min_piece: int
) -> Iterator[tuple[str | None, int, int, int, int]]:
    """``(source, document, start, length, position)`` of each piece, in order.

    Every window credits each queue its share of the window.  A queue is served from its deficit, at
    least ``min_piece`` ids or to the end of its document; what it may not spend yet is carried on.  If no
    deficit is large enough, the queue furthest behind overdraws and pays it back in later windows.
    """
    active = [q for q in queues if q.docs]
    turn = 0
    while active:
        space = window - position % window
        for q in active:
            q.deficit += q.share * space
        while space and active:
            served = False
            for q in active[turn % len(active):] + active[:turn % len(active)]:
                want = min(q.docs[0][1] - q.at, space)
                take = min(want, int(q.deficit))
                if want and take >= min(min_piece, want):
                    served = True
                    yield q.name, q.docs[0][0], q.at, take, position
                    position, space = position + take, space - take
                    _advance(q, take)
                if not space:
                    break
            turn += 1
            if not served and space:
                q = max(active, key=lambda x: x.deficit)
                take = min(q.docs[0][1] - q.at, space, max(min_piece, int(q.deficit)))
                yield q.name, q.docs[0][0], q.at, take, position
                position, space = position + take, space - take
                _advance(q, take)
            active = [q for q in active if q.docs]


def _advance(q: _Queue, take: int) -> None:
    q.deficit -= take
    q.at += take
    if q.at == q.docs[0][1]:
        q.docs.popleft()
        q.at = 0


def _encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        small = max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16
        for batch in batches:
            ids = [encoder.encode(t) + end for t in batch.column(2).to_pylist()]
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            if small:
                ids = [np.frombuffer(x, dtype="<u4").astype("<u2").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), n, pa.array(ids, pa.binary())],
                names=["doc_id", "source", "h", "n", "ids"],
            )

    return docs.mapInArrow(encode, "doc_id long, source string, h long, n long, ids binary")


def pack_mixture(
    docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, min_piece: int = 256,
    weights: dict[str, float] | None = None, block_tokens: int = 1 << 20, folder: str | None = None,
    key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """One row for each piece of a document: see ``PIECES``.  Each id lies in exactly one piece.

    ``weights``: target share of each source, by default its share of all tokens, which lets all queues
    end together; sources that are not named share nothing and are packed where the others run dry.
    NULL text: the end id alone.  NULL source: a source of its own.  NULL or repeated keys: every row is
    packed.  Empty table: no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or run_path(spark, "packing")
    rows = docs.select(
        F.col(key).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"),
        F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("h"),
    )
    coded = written(_encoded(rows, tokenizer, end_id), f"{folder}/ids")
    total = coded.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_tokens))
    block = F.pmod("h", F.lit(blocks)).cast("int").alias("block")
    # A column with NULLs would reach pandas as floats, which do not hold large keys.
    dealt = coded.select(
        block, F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "source", "h", "n", "ids"
    )
    per = spark.read.schema(coded.schema).parquet(f"{folder}/ids").select(block, "source", "n").groupBy("block", "source").agg(F.sum("n").alias("n"))
    before = (Window.unboundedPreceding, -1)
    # NULL sources are told apart by their own flag: window keys and joins below never compare them.
    of_block = per.groupBy("block").agg(F.sum("n").alias("m")).select(
        "block", F.coalesce(F.sum("m").over(Window.orderBy("block").rowsBetween(*before)), F.lit(0)).alias("position")
    )
    if weights is None:
        share = F.sum("n").over(Window.partitionBy("source")) / F.lit(float(max(total, 1)))
    else:
        whole = float(sum(weights.values()))
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("source") == name, F.lit(w / whole)).otherwise(share)
    sent = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("block").rowsBetween(*before)), F.lit(0))
    plan = (
        per.withColumn("share", share).withColumn("sent", sent).join(of_block, "block")
        .select("block", "source", "share", "position", (F.col("share") * F.col("position") - F.col("sent")).alias("deficit"))
    )

    def pack(docs_of: pd.DataFrame, plan_of: pd.DataFrame) -> pd.DataFrame:
        docs_of = docs_of.sort_values(["h", "doc_id", "n"], kind="stable", ignore_index=True)
        ids, n = docs_of["ids"].tolist(), docs_of["n"].tolist()
        width = "<u2" if len(ids[0]) == 2 * n[0] else "<u4"
        queues: dict = {}
        names = [None if pd.isna(s) else s for s in docs_of["source"]]
        for i, name in enumerate(names):
            queues.setdefault(name, deque()).append((i, n[i]))
        known = {None if pd.isna(s) else s: (a, d) for s, a, d in zip(plan_of["source"], plan_of["share"], plan_of["deficit"])}
        listed = [_Queue(s, queues[s], *known[s]) for s in sorted(queues, key=lambda x: (x is None, x or ""))]
        out, k = [], [None if x else i for i, x in zip(docs_of["doc_id"].tolist(), docs_of["no_id"].tolist())]
        for name, i, start, length, position in deficit_round_robin(listed, int(plan_of["position"].iloc[0]), window, min_piece):
            part = np.frombuffer(ids[i], dtype=width)[start:start + length].astype("<u4")
            out.append((k[i], start, length, zlib.crc32(part.tobytes()), n[i], position // window, position % window, name))
        columns = [c.split()[0] for c in PIECES.split(", ")]
        return pd.DataFrame({c: pd.Series(v, dtype="object" if c == "source" else "Int64") for c, v in zip(columns, zip(*out))})

    return dealt.groupBy("block").cogroup(plan.groupBy("block")).applyInPandas(pack, PIECES)
