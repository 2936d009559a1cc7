"""Token ids in raw binary shards with a minimal perfect hash index for keyed access.

One shard is two files: ``*.ids``, the ids of its documents one after the other (little-endian unsigned
16- or 32-bit), and ``*.idx``, a NumPy archive with the index: bit levels of the hash, ranks, and for each
slot a 32-bit fingerprint, an offset and a length in ids.  The keys in file order are kept beside it for
enumeration only; a lookup hashes the key, reads one slot and compares the fingerprint.
A manifest table names the files of each shard; a shard counts only when its manifest row is committed,
so files of lost or repeated tasks are never read.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavecut.llm.common import mix64, open_folder, run_path
from wavecut.llm.encode import word_encoder

MANIFEST = "shard int, ids_file string, idx_file string, first_key long, last_key long, n_docs long, n_tokens long"
_NULL_KEY = 0x5BD1E995


@dataclass
class KeyIndex:
    """Minimal perfect hash over 64-bit keys: levels of bit arrays, each key set alone in its first free level."""

    sizes: np.ndarray
    words: np.ndarray
    ranks: np.ndarray
    fingerprints: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> tuple["KeyIndex", np.ndarray]:
        """Index and the slot of each key; keys must differ."""
        bits, sizes, rest, level = [], [], np.arange(len(keys)), 0
        at, base = np.zeros(len(keys), dtype=np.int64), 0
        while len(rest):
            size = -(-max(64, int(gamma * len(rest))) // 64) * 64
            h = (mix64(keys[rest], level + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(h, minlength=size)[h] == 1
            row = np.zeros(size, dtype=np.uint8)
            row[h[alone]] = 1
            at[rest[alone]] = base + h[alone]
            bits.append(row)
            sizes.append(size)
            rest, base, level = rest[~alone], base + size, level + 1
        flat = np.concatenate(bits) if bits else np.zeros(0, dtype=np.uint8)
        words = np.packbits(flat, bitorder="little").view("<u8")
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))]).astype(np.int64)
        out = cls(np.array(sizes, dtype=np.int64), words, ranks, np.zeros(len(keys), dtype=np.uint32))
        slots = out._rank(at)
        out.fingerprints[slots] = fingerprint(keys)
        return out, slots

    def _rank(self, at: np.ndarray) -> np.ndarray:
        w, low = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[w] & ((np.uint64(1) << low) - np.uint64(1))
        return self.ranks[w] + np.bitwise_count(below).astype(np.int64)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where its fingerprint is not stored."""
        found, rest, base = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + (mix64(keys[rest], level + 1) % np.uint64(size)).astype(np.int64)
            hit = (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            found[rest[hit]] = self._rank(at[hit])
            rest, base = rest[~hit], base + int(size)
            if not len(rest):
                break
        wrong = found >= 0
        wrong[wrong] = self.fingerprints[found[wrong]] != fingerprint(keys[wrong])
        found[wrong] = -1
        return found


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys, 0) >> np.uint64(32)).astype(np.uint32)


def slot_keys(keys: np.ndarray, is_null: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash keys of sorted document keys; the k-th repetition of a key has a hash of its own."""
    n = len(keys)
    first = np.ones(n, dtype=bool)
    first[1:] = (keys[1:] != keys[:-1]) | (is_null[1:] != is_null[:-1])
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, dtype=np.int64)
    nth = (np.arange(n) - start).astype(np.uint64)
    base = mix64(keys.astype(np.int64).view(np.uint64) ^ np.where(is_null, np.uint64(_NULL_KEY), np.uint64(0)), 90 + salt)
    return np.where((nth > 0) | is_null, mix64(base + nth * np.uint64(0x9E3779B97F4A7C15), 91), base)


class ShardWriter:
    """Streams documents in key order into one shard."""

    def __init__(self, folder: str, name: str, dtype: str):
        self.fs, self.path = open_folder(folder)
        self.dtype, self.ids_name, self.idx_name = dtype, f"{name}.ids", f"{name}.idx"
        self.sink = self.fs.open_output_stream(f"{self.path}/{self.ids_name}")
        self.keys: list[int] = []
        self.nulls: list[bool] = []
        self.lengths: list[int] = []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.sink.write(ids.astype(self.dtype).tobytes())
        self.keys.append(0 if key is None else key)
        self.nulls.append(key is None)
        self.lengths.append(len(ids))

    def close(self) -> tuple[str, str, int, int]:
        self.sink.close()
        keys, nulls = np.array(self.keys, dtype=np.int64), np.array(self.nulls, dtype=bool)
        lengths = np.array(self.lengths, dtype=np.int64)
        salt, hashed = 0, slot_keys(keys, nulls)
        while len(np.unique(hashed)) < len(hashed):
            salt += 1
            hashed = slot_keys(keys, nulls, salt)
        index, slots = KeyIndex.build(hashed)
        offsets, by_slot, long_by_slot = np.cumsum(lengths) - lengths, np.zeros_like(lengths), np.zeros_like(lengths)
        by_slot[slots], long_by_slot[slots] = offsets, lengths
        body = io.BytesIO()
        np.savez(
            body, dtype=np.array(self.dtype), salt=np.array(salt), sizes=index.sizes, words=index.words,
            ranks=index.ranks, fingerprints=index.fingerprints, offsets=by_slot, lengths=long_by_slot,
            keys=keys, nulls=nulls,
        )
        with self.fs.open_output_stream(f"{self.path}/{self.idx_name}") as out:
            out.write(body.getvalue())
        return self.ids_name, self.idx_name, len(keys), int(lengths.sum())


class ShardReader:
    """Keyed access to one shard."""

    def __init__(self, folder: str, ids_name: str, idx_name: str):
        self.fs, path = open_folder(folder)
        with self.fs.open_input_file(f"{path}/{idx_name}") as f:
            parts = np.load(io.BytesIO(f.read()))
        self.dtype, self.salt = str(parts["dtype"]), int(parts["salt"])
        self.index = KeyIndex(parts["sizes"], parts["words"], parts["ranks"], parts["fingerprints"])
        self.offsets, self.lengths = parts["offsets"], parts["lengths"]
        self.keys, self.nulls = parts["keys"], parts["nulls"]
        self.file = self.fs.open_input_file(f"{path}/{ids_name}")

    def slots(self, keys: np.ndarray, nulls: np.ndarray) -> np.ndarray:
        """Slots of sorted keys; a key asked for twice means its first and second document."""
        return self.index.lookup(slot_keys(keys, nulls, self.salt))

    def get(self, key: int | None) -> np.ndarray | None:
        slot = self.slots(np.array([0 if key is None else key]), np.array([key is None]))[0]
        return None if slot < 0 else self.ids_at(slot)

    def ids_at(self, slot: int) -> np.ndarray:
        width = np.dtype(self.dtype).itemsize
        self.file.seek(int(self.offsets[slot]) * width)
        return np.frombuffer(self.file.read(int(self.lengths[slot]) * width), dtype=self.dtype)


def write_token_shards(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encodes every document and writes shards in ascending key order; returns the manifest.

    NULL text: only the end id.  NULL key: first, as a key of its own.  Repeated keys: kept, told apart
    by their order.  Empty table: no shard.  Other columns are not read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        dtype = "<u2" if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        shard, out = TaskContext.get().partitionId(), None
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out is None:
                    out = ShardWriter(folder, f"shard-{shard:06d}-{uuid.uuid4().hex[:8]}", dtype)
                out.add(k, np.frombuffer(encoder.encode(t) + end, dtype="<u4"))
        if out is not None:
            ids_name, idx_name, n, tokens = out.close()
            known = [k for k, null in zip(out.keys, out.nulls) if not null]
            yield pa.RecordBatch.from_pylist([{
                "shard": shard, "ids_file": ids_name, "idx_file": idx_name, "first_key": known[0] if known else None,
                "last_key": known[-1] if known else None, "n_docs": n, "n_tokens": tokens,
            }], schema=pa.schema([("shard", pa.int32()), ("ids_file", pa.string()), ("idx_file", pa.string()),
                                  ("first_key", pa.int64()), ("last_key", pa.int64()), ("n_docs", pa.int64()),
                                  ("n_tokens", pa.int64())]))

    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    ordered = rows.repartitionByRange("k").sortWithinPartitions("k", F.xxhash64("t"))
    ordered.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, each fetched by key from its shard."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = ShardReader(folder, row["ids_file"], row["idx_file"])
                slots = reader.slots(reader.keys, reader.nulls)
                if (slots < 0).any():
                    raise ValueError(f"{row['idx_file']}: a key is missing from its index")
                crc = [zlib.crc32(reader.ids_at(s).astype("<u4").tobytes()) for s in slots]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.keys, pa.int64(), mask=reader.nulls),
                     pa.array(row["base"] + reader.offsets[slots], pa.int64()),
                     pa.array(reader.lengths[slots], pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard file
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    # A row stands for a whole shard: the number of tasks must not follow the bytes of the manifest.
    most = 4 * int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = based.select("ids_file", "idx_file", "base").repartition(max(1, min(manifest.count(), most)))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1) -> DataFrame:
    """Writes the shards of a table and reads every document back by its key."""
    folder = folder or run_path(docs.sparkSession, "token-shards")
    return read_token_shards(write_token_shards(docs, folder, tokenizer, end_id), folder)
