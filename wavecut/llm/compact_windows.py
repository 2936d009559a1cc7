"""Near-duplicate passages by compact windows.

Tokens are shingles of five words.  Under one hash function, all subsequences whose smallest hash is that of
token c form the compact window (l, c, r): they begin in l..c and end in c..r.  The windows of a text are the
nodes of the Cartesian tree over its hashes; those that span fewer tokens than a passage hold none and are
left out, and as every ancestor of a long window is long, the tree of the long ones is built alone.
Windows with the same smallest token meet in one group.  Pairs of windows laid over each other give intervals, the
intervals of several hash functions are joined, and texts whose intervals share a passage's length are verified.

Tokens that too many windows meet under would cost all pairs of their groups; texts that hold them are done again in an
order that puts such tokens last; in the end equal stretches of such tokens are taken as one and the others all paired.  Equal texts are one from the start.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecut.llm.common import mix64, run_path, written
from wavecut.operators.segments import union_sets
from wavecut.sources.storage import join_small

WIDTH = 5
#: Number of bits for hot tokens, and the mark of pairs that need no second function.
HOT_BITS, SURE = 1 << 24, 7
FN_KEYS = mix64(np.arange(8, dtype=np.uint64), 200)
#: Later texts that are compared together.
BLOCK_TEXTS = 256
#: Windows of a large group that are compared together.
BLOCK_WINDOWS = 256
#: Pairs of windows that are given in one batch, about.
PAIRS_AT_ONCE = 1 << 16
_SPAN = re.compile(r"\S+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text hashed at once, and a random value for each byte.
BLOCK = 1 << 21
_BYTES = mix64(np.arange(256, dtype=np.uint64), 31)
#: Bytes that fit the processor's cache with their sums.
PIECE = 1 << 16
#: Beginnings of the characters beyond ASCII that ``str.split`` takes for white space.
_WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
#: ASCII letters in lower case, and a blank for what ``str.split`` takes for white space.
_PLAIN = bytes(32 if chr(x).isspace() and x < 128 else x + 32 if 65 <= x <= 90 else x for x in range(256))
SPANS = (
    "doc_id long, text_hash long, word_start int, word_end int, char_start int, char_end int, source_doc_id long, "
    "source_start int, source_end int, similarity double"
)
WINDOWS = "key long, cls long, at long, lr long"
FOUND = "doc_id long, text_hash long, word_start int, word_end int, source_doc_id long, source_start int, source_end int, similarity double"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_BASE ** i`` and its inverse, for i up to n."""
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
        return up, np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))]))


_POWERS = _powers(BLOCK)


def _plain_bytes(text: str) -> bytes:
    """The text in which ``_PLAIN`` finds the words: letters but A-Z in lower case, white space beyond ASCII replaced."""
    data = (text if text.isascii() else text.lower()).encode("utf-8", "surrogatepass")
    if len(data) > len(text) and any(x in data for x in _WIDE):
        return " ".join(text.lower().split()).encode("utf-8", "surrogatepass")
    return data


def word_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, end to end, and the number of words of each text.

    A word's hash is a polynomial of its bytes, read off prefix sums over a block of text; a word that does not fit a
    block is hashed alone.
    """
    parts = [_plain_bytes(t) for t in texts]
    data, out, where, at = b" ".join([*parts, b""]).translate(_PLAIN), [], [], 0
    block = min(BLOCK, PIECE)
    while at < len(data):
        end = len(data) if len(data) - at <= block else data.rfind(b" ", at, at + block) + 1
        if end <= at:
            end = data.find(b" ", at) + 1
            out.append(np.array([xxhash.xxh64_intdigest(data[at:end - 1])], dtype=np.uint64))
            where.append(np.array([at]))
        else:
            part = np.frombuffer(data, np.uint8, end - at, at)
            space = np.concatenate([[True], part == 32])
            edges = np.flatnonzero(space[1:] != space[:-1])
            starts, ends = edges[::2], edges[1::2]
            with np.errstate(over="ignore"):
                prefix = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[part] * _POWERS[0][: len(part)])])
                out.append((prefix[ends] - prefix[starts]) * _POWERS[1][starts])
            where.append(starts + at)
        at = end
    if not out:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    borders = np.cumsum([len(x) + 1 for x in parts])
    return mix64(np.concatenate(out)), np.diff(np.searchsorted(np.concatenate(where), borders), prepend=0)


def text_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``WIDTH`` words of all texts, end to end, and their number in each text."""
    words, counts = word_tokens(texts)
    every = shingles(words)
    sizes = np.maximum(counts - WIDTH + 1, 0)
    starts = np.cumsum(counts) - counts
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return every[at], sizes


def shingles(words: np.ndarray) -> np.ndarray:
    """Hash of every run of ``WIDTH`` words."""
    n = max(0, len(words) - WIDTH + 1)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(WIDTH):
            h = (h ^ (h >> np.uint64(29))) * _BASE + words[j:j + n]
    return mix64(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window, by doubling."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    got, m = 1, x
    while 2 * got <= width:
        m = np.minimum(m[:-got], m[got:])
        got *= 2
    return np.minimum(m[:n], m[width - got:width - got + n])


def nearest_smaller(values: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value on the side of ``near``, the direct neighbours; values differ.

    ``near`` of the smallest is itself.  All between a value and its ``near`` are larger, so those of a larger neighbour are skipped at once.
    """
    open_ = np.flatnonzero(values[near] > values)
    while len(open_):
        near[open_] = near[near[open_]]
        open_ = open_[values[near[open_]] > values[open_]]
    return near


def compact_windows(tokens: np.ndarray, doc: np.ndarray, shortest: int, seed: int, hot: np.ndarray | None = None):
    """Index arrays ``c, l, r`` of the windows of at least ``shortest`` tokens; texts lie end to end.

    Tokens in ``hot`` come behind all others.
    """
    empty = np.zeros(0, dtype=np.int64)
    if len(tokens) < shortest:
        return empty, empty, empty
    packed = (demote(mix64(tokens, seed), tokens, hot) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(tokens), dtype=np.uint64)
    low = sliding_min(packed, shortest)
    low = low[doc[: len(low)] == doc[shortest - 1:]]
    if not len(low):
        return empty, empty, empty
    low = low[np.concatenate([[True], low[1:] != low[:-1]])]
    c = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    borders = np.flatnonzero(np.concatenate([[True], doc[c[1:]] != doc[c[:-1]], [True]]))
    own = doc[c[borders[:-1]]]
    first, last = np.searchsorted(doc, own, "left"), np.searchsorted(doc, own, "right") - 1
    # a bound before each text and one behind the last, smaller than all values
    n, of = len(borders) - 1, np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    inner = np.arange(len(c)) + of + 1
    values, ends = np.zeros(len(c) + n + 1, dtype=np.uint64), np.append(inner[borders[:-1]] - 1, len(c) + n)
    values[inner] = low + np.uint64(1)
    at = np.arange(len(values))
    left, right = at - 1, at + 1
    left[ends] = right[ends] = ends
    left, right = nearest_smaller(values, left)[inner], nearest_smaller(values, right)[inner]
    place = np.zeros(len(values), dtype=np.int64)
    place[inner] = c
    l = np.where(values[left] == 0, first[of], place[left] + 1)
    r = np.where(values[right] == 0, last[of], place[right] - 1)
    return c, l, r


def demote(order: np.ndarray, tokens: np.ndarray, hot: np.ndarray | None) -> np.ndarray:
    """Hash values with those of hot tokens behind all others, whatever the function."""
    if hot is None:
        return order >> np.uint64(1)
    return (order >> np.uint64(1)) | (is_marked(tokens, hot).astype(np.uint64) << np.uint64(63))


def is_marked(tokens: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = tokens & np.uint64(HOT_BITS - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def stretch_hashes(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers for ``stretch_hash``."""
    powers, inverse = _POWERS if len(tokens) <= BLOCK else _powers(len(tokens))
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(0)], np.cumsum(tokens * powers[: len(tokens)])]), inverse


def stretch_hash(prefix: np.ndarray, inverse: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the tokens ``first .. end - 1``, the same at every place."""
    with np.errstate(over="ignore"):
        return mix64((prefix[end] - prefix[first]) * inverse[first], 17)


class Batch:
    """Tokens of some texts, end to end."""

    def __init__(self, texts: list[str]):
        self.tokens, sizes = text_shingles(texts)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.start = np.cumsum(sizes) - sizes
        self.end = self.start + sizes
        self._stretches = None

    def stretches(self) -> tuple[np.ndarray, np.ndarray]:
        """For ``stretch_hash``, made once."""
        if self._stretches is None:
            self._stretches = stretch_hashes(self.tokens)
        return self._stretches

    def windows(self, shortest: int, fn: int, hot: np.ndarray | None):
        """``c, l, r`` of the windows; of those of a text with the same tokens all around, the first."""
        c, l, r = compact_windows(self.tokens, self.doc, shortest, fn, hot)
        if len(c) < 2:
            return c, l, r
        tokens, doc = self.tokens[c], self.doc[c]
        order = np.argsort(tokens, kind="stable")
        ranked, doc = tokens[order], doc[order]
        same = np.flatnonzero((ranked[1:] == ranked[:-1]) & (doc[1:] == doc[:-1]))
        if not len(same):
            return c, l, r
        prefix, inverse = self.stretches()
        again = np.unique(np.concatenate([order[same], order[same + 1]]))
        d = self.doc[c[again]]
        first, end = np.maximum(c[again] - shortest + 1, self.start[d]), np.minimum(c[again] + shortest, self.end[d])
        around = stretch_hash(prefix, inverse, first, end) ^ mix64((c[again] - first).astype(np.uint64) << np.uint64(32) | d.astype(np.uint64), 18)
        keep = np.ones(len(c), dtype=bool)
        keep[again] = False
        keep[again[np.unique(around, return_index=True)[1]]] = True
        return c[keep], l[keep], r[keep]


def window_rows(
    source: DataFrame, hashes: int, shortest: int, hot: np.ndarray | None = None, marked: np.ndarray | None = None
) -> DataFrame:
    """``key, cls, at, lr``: each compact window of every ``cls, t`` under its smallest token.

    The key is the token with the function's own bits turned over; ``at`` holds the place of the token and
    the function.  With ``hot`` tokens last, only windows that hold such a token are given: the
    others are the same in every order.  With ``marked`` only those under a marked token.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in few_rows(batches):
            b = Batch(rows.column(1).to_pylist())
            ids = rows.column(0).to_numpy(zero_copy_only=False)
            held = np.concatenate([[0], np.cumsum(is_marked(b.tokens, hot))]) if hot is not None else None
            found = []
            for fn in range(hashes):
                c, l, r = b.windows(shortest, fn, hot)
                if hot is not None:
                    keep = held[r + 1] > held[l]  # without a hot token inside, the window was there before
                    c, l, r = c[keep], l[keep], r[keep]
                if marked is not None:
                    keep = is_marked(b.tokens[c], marked)
                    c, l, r = c[keep], l[keep], r[keep]
                found.append((c, l, r, np.full(len(c), fn)))
            c, l, r, of = (np.concatenate(x) for x in zip(*found))
            yield window_batch(b, ids, b.tokens[c], b.doc[c], c, l, r, of)

    return source.select("cls", "t").mapInArrow(run, WINDOWS)


def window_batch(b: Batch, ids: np.ndarray, token: np.ndarray, d: np.ndarray, c: np.ndarray, l: np.ndarray, r: np.ndarray, fn: int | np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array((token ^ FN_KEYS[fn]).view(np.int64)), pa.array(ids[d]), pa.array((c - b.start[d]) << 3 | fn),
         pa.array((l - b.start[d]) << 32 | (r - b.start[d]))], names=["key", "cls", "at", "lr"],
    )


def frequent_tokens(rows: DataFrame, hashes: int, shortest: int, hot: np.ndarray, marked: np.ndarray, largest: int) -> DataFrame:
    """``diag``: tokens at more than ``largest`` places of stretches whose smallest token is marked, hot tokens last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few_rows(batches):
            b = Batch(part.column(0).to_pylist())
            edge = np.zeros(len(b.tokens) + 1, dtype=np.int64)
            for fn in range(hashes):
                c, l, r = compact_windows(b.tokens, b.doc, shortest, fn, hot)
                few = is_marked(b.tokens[c], marked)
                c, l, r = c[few], l[few], r[few]
                np.add.at(edge, np.maximum(l, c - shortest + 1), 1)
                np.add.at(edge, np.minimum(r, c + shortest - 1) + 1, -1)
            tokens, n = np.unique(b.tokens[np.cumsum(edge)[:-1] > 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n)], names=["diag", "n"])

    return rows.select("t").mapInArrow(run, "diag long, n long").groupBy("diag").agg(F.sum("n").alias("n")).where(F.col("n") > largest).select("diag")


def hot_stretches(rows: DataFrame, shortest: int, hot: np.ndarray) -> DataFrame:
    """``key, id, cls, at``: every stretch of ``shortest`` hot tokens, by its hash; a text's first of equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few_rows(batches):
            b = Batch(part.column(1).to_pylist())
            ids, docs = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            held = np.concatenate([[0], np.cumsum(is_marked(b.tokens, hot))])
            first = np.arange(max(0, len(b.tokens) - shortest + 1))
            first = first[(held[first + shortest] - held[first] == shortest) & (b.doc[first] == b.doc[first + shortest - 1])]
            prefix, inverse = b.stretches()
            key = stretch_hash(prefix, inverse, first, first + shortest)
            once = np.unique(key ^ mix64(b.doc[first], 18), return_index=True)[1]
            key, first = key[once], first[once]
            d = b.doc[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(docs[d]), pa.array(ids[d]), pa.array(first - b.start[d])], names=["key", "id", "cls", "at"],
            )

    return rows.select("cls", "t", "id").mapInArrow(run, "key long, id long, cls long, at long")


def owned_windows(owners: DataFrame, hashes: int, shortest: int, marked: np.ndarray | None = None) -> DataFrame:
    """``WINDOWS`` of the runs of stretches that a text owns; with ``marked`` those under a marked token.

    ``cls, t, first, last`` of the owners: the places where the first and the last stretch of each run begin.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few_rows(batches):
            b = Batch(part.column(1).to_pylist())
            ids = part.column(0).to_numpy(zero_copy_only=False)
            first, last = (part.column(k).flatten().to_numpy() for k in (2, 3))
            d = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(2)).to_numpy())
            sizes = last - first + shortest
            of = np.repeat(np.arange(len(sizes)), sizes)
            places = np.repeat(b.start[d] + first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            tokens = b.tokens[places]
            for fn in range(hashes):
                c, l, r = compact_windows(tokens, of, shortest, fn)
                if marked is not None:
                    keep = is_marked(tokens[c], marked)
                    c, l, r = c[keep], l[keep], r[keep]
                yield window_batch(b, ids, tokens[c], d[of[c]], places[c], places[l], places[r], fn)

    return owners.select("cls", "t", "first", "last").mapInArrow(run, WINDOWS)


def group_pairs(windows: DataFrame, shortest: int, largest: int, dealt: bool) -> DataFrame:
    """``b, a, diag, fn, low, high``: windows of two classes under one token whose stretches, laid over each other
    at it, are long enough for a passage; ``low .. high`` is the common stretch in b.

    All pairs of a group of up to ``largest`` windows.  A larger group makes its token hot: it gives ``b`` and the token
    as ``diag`` with a NULL ``a``.  Windows ``dealt`` to cells meet all others of their cell, whatever its size: see ``block_pairs``.
    """
    names = ["b", "a", "diag", "fn", "low", "high"]

    def pairs(k, d, at, lr, i, j) -> pa.RecordBatch:
        swap = d[i] < d[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        ci, cj = at[i] >> 3, at[j] >> 3
        before = np.minimum(ci - (lr[i] >> 32), cj - (lr[j] >> 32))
        behind = np.minimum((lr[i] & 0xFFFFFFFF) - ci, (lr[j] & 0xFFFFFFFF) - cj)
        wide = before + behind + 1 >= shortest
        i, j, ci, cj, before, behind = (x[wide] for x in (i, j, ci, cj, before, behind))
        return pa.RecordBatch.from_arrays(
            [pa.array(d[i]), pa.array(d[j]), pa.array(ci - cj), pa.array((at[i] & 7).astype(np.int8)), pa.array(ci - before), pa.array(ci + behind)],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over = [np.zeros(0, dtype=np.int64)] * (5 if dealt else 4), None

        def settle(cols: list[np.ndarray], final: bool) -> Iterator[pa.RecordBatch]:
            """Pairs of the complete groups; the last group is held back unless ``final``."""
            nonlocal held, over
            k, d, at, lr = cols[:4]
            n = len(k)
            if not n:
                held = cols
                return
            group = np.concatenate([[True], k[1:] != k[:-1]])
            if dealt:
                cell, side = cols[4] >> 1, cols[4] & 1
                one_block = (cell >> 31) == (cell & 0x7FFFFFFF)
                group[1:] |= cell[1:] != cell[:-1]
                again = np.concatenate([[False], np.all([x[1:] == x[:-1] for x in cols], axis=0)])
                if again.any():  # equal rows lie side by side: one is enough
                    yield from settle([x[~again] for x in cols], final)
                    return
            starts = np.flatnonzero(group)
            ends = np.append(starts[1:], n)
            own = np.cumsum(group) - 1
            size = (ends - starts)[own]
            large = (size > largest) & (not dealt)
            if over is not None and over == k[0]:  # the group of the held rows was too large already
                large |= own == 0
            open_ = np.zeros(n, dtype=bool)
            if not final:
                open_ = (own == own[-1]) & ~large
            ready = ~large & ~open_
            found, waiting = [], 0
            for step in range(1, n if dealt else largest):
                i = np.flatnonzero(ready[step:] & (own[step:] == own[:-step])) + step
                if not len(i):
                    break
                i = i[d[i] != d[i - step]]
                if dealt:
                    i = i[one_block[i] | (side[i] != side[i - step])]
                found.append((i, i - step))
                waiting += len(i)
                if waiting >= PAIRS_AT_ONCE:
                    yield pairs(k, d, at, lr, *(np.concatenate(x) for x in zip(*found)))
                    found, waiting = [], 0
            if waiting:
                yield pairs(k, d, at, lr, *(np.concatenate(x) for x in zip(*found)))
            if large.any():
                rows = np.flatnonzero(large)
                marks = np.unique(np.stack([d[rows], (k[rows].view(np.uint64) ^ FN_KEYS[at[rows] & 7]).view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(marks[0]), pa.nulls(len(marks[0]), pa.int64()), pa.array(marks[1]), *(pa.nulls(len(marks[0]), t) for t in (pa.int8(), pa.int64(), pa.int64()))],
                    names=names,
                )
                if large[-1]:
                    over = k[-1]
            held = [x[open_] for x in cols]

        for batch in batches:
            if batch.num_rows:
                yield from settle([np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)], False)
        yield from settle(held, True)

    if dealt:
        ordered = windows.repartition("key", F.expr("cell >> 1")).sortWithinPartitions("key", "cell", "cls", "at", "lr").select("key", "cls", "at", "lr", "cell")
    else:
        ordered = windows.repartition("key").sortWithinPartitions("key").select("key", "cls", "at", "lr")
    return ordered.mapInArrow(run, "b long, a long, diag long, fn byte, low long, high long")


def block_pairs(windows: DataFrame, shortest: int, folder: str) -> DataFrame:
    """All pairs of groups of any size: a group is cut into blocks of about ``BLOCK_WINDOWS`` windows, and a cell is a pair of blocks."""
    windows = written(windows, f"{folder}/windows")
    sizes = windows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_WINDOWS).alias("blocks"))
    sizes = written(sizes, f"{folder}/sizes")
    cut = join_small(windows, sizes, ["key"]).withColumn("own", F.expr("pmod(xxhash64(cls, at), blocks)"))
    cells = cut.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    # both blocks of a cell, the smaller one first, and which of them a window is from
    cell = F.expr("shiftleft(least(own, other), 32) | shiftleft(greatest(own, other), 1) | if(own > other, 1, 0)")
    return group_pairs(cells.select("key", "cls", "at", "lr", cell.alias("cell")), shortest, BLOCK_WINDOWS, True)


def all_pairs(
    windows: Callable[[np.ndarray | None], DataFrame], shortest: int, largest: int, folder: str, hot: np.ndarray | None = None
) -> list[DataFrame]:
    """Pairs of all groups but large ones under ``hot`` tokens; ``windows`` gives all of them, or those under marked tokens."""
    pairs = written(group_pairs(windows(None), shortest, largest, False), f"{folder}/pairs")
    found, marked = [pairs.where("a is not null")], hot_words(pairs.where("a is null"))
    if hot is not None:
        marked &= ~hot
    return found + ([block_pairs(windows(marked), shortest, folder)] if marked.any() else [])


def agreeing(diag: np.ndarray, fn: np.ndarray, low: np.ndarray, high: np.ndarray, need: int, shortest: int, slack: int) -> bool:
    """Whether ``need`` functions have stretches near one diagonal that share a passage's length."""
    if need < 2 or (fn == SURE).any():
        return True
    if len(np.unique(fn)) < need:
        return False
    if need == 2:
        for at in range(0, len(fn), 500):
            i = slice(at, at + 500)
            shared = np.minimum(high[i, None], high) - np.maximum(low[i, None], low) + 1 >= shortest
            if (shared & (fn[i, None] != fn) & (np.abs(diag[i, None] - diag) <= slack)).any():
                return True
        return False
    for i in range(len(fn)):
        near = np.abs(diag - diag[i]) <= slack
        # of all intersections with interval i the best begins where one of its partners does
        for at in np.unique(np.maximum(low[near], low[i])):
            inside = near & (low <= at) & (np.minimum(high, high[i]) - at + 1 >= shortest)
            if len(np.unique(fn[inside])) >= need:
                return True
    return False


def hot_words(marks: DataFrame) -> np.ndarray:
    """The hot tokens as a fixed number of bits; tokens that share a bit with one are treated alike."""
    slot = F.col("diag").bitwiseAND(HOT_BITS - 1)
    words = marks.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast(diag & {HOT_BITS - 1} & 63 as int))").alias("bit"))
    rows = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toPandas()  # HOT_BITS / 64 rows at most
    out = np.zeros(HOT_BITS // 64, dtype=np.uint64)
    out[rows["w"].to_numpy()] = rows["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def last_pairs(rows: DataFrame, hashes: int, shortest: int, hot: np.ndarray, marked: np.ndarray, largest: int, folder: str) -> list[DataFrame]:
    """Pairs of the texts whose groups stay too large, with the hot tokens behind all others: all pairs of all groups.

    Tokens are hot then that are marked or frequent around marked ones, so that few others have large groups.
    Groups of hot tokens hold stretches of nothing else.  Equal ones are one: the earliest document that holds a stretch owns
    it and stands for all others.  No stretch has two owners; the windows of what each text owns are paired.
    """
    hot = hot | marked | hot_words(frequent_tokens(rows, hashes, shortest, hot, marked, largest))
    found = all_pairs(lambda only: window_rows(rows, hashes, shortest, hot, only), shortest, largest, f"{folder}/last", hot)
    keyed = written(hot_stretches(rows, shortest, hot), f"{folder}/stretches")
    leads = written(keyed.groupBy("key").agg(F.min(F.struct("id", "cls", "at")).alias("lead")), f"{folder}/leads")
    led = written(join_small(keyed, leads, ["key"]).select("id", "cls", "at", "lead"), f"{folder}/led")
    # one stretch stands for all of a pair on a diagonal
    met = led.where("id <> lead.id and cls <> lead.cls").groupBy(
        F.col("cls").alias("b"), F.col("lead.cls").alias("a"), (F.col("at") - F.col("lead.at")).alias("diag")
    ).agg(F.min("at").alias("low"), (F.max("at") + shortest - 1).alias("high"))
    # texts of one document hold its stretches alike
    starts = led.where("id = lead.id").groupBy("cls").agg(F.array_sort(F.collect_set("at")).alias("at"))
    runs = written(starts.select(
        "cls", F.expr("filter(at, (x, i) -> i = 0 or at[i - 1] < x - 1)").alias("first"),
        F.expr("filter(at, (x, i) -> i = size(at) - 1 or at[i + 1] > x + 1)").alias("last"),
    ), f"{folder}/owned")
    owners = join_small(rows, runs, ["cls"])
    found += all_pairs(lambda only: owned_windows(owners, hashes, shortest, only), shortest, largest, f"{folder}/owners")
    return [met.select("b", "a", "diag", F.lit(SURE).cast("byte").alias("fn"), "low", "high"), *found]


def candidate_pairs(source: DataFrame, hashes: int, need: int, shortest: int, slack: int, largest: int, folder: str) -> DataFrame:
    """``b, a, diags``: pairs of classes that ``need`` functions agree on.

    Tokens of groups beyond ``largest`` are hot.  The texts in such groups are done again with the hot tokens behind all
    others in every order, so that a passage that holds any other token has one of those as its smallest; and again,
    with the tokens that are hot then, as long as this leaves less than half of the texts.  In the last round all pairs
    of all groups meet, whatever their size, but that equal stretches of hot tokens are found by their hash and count once.
    """
    rows, hot, found, left, k = source, None, [], None, 0
    while True:
        pairs = written(group_pairs(window_rows(rows, hashes, shortest, hot), shortest, largest, False), f"{folder}/round-{k}")
        found.append(pairs.where("a is not null"))
        marks = pairs.where("a is null")
        marked = hot_words(marks)
        if not marked.any():
            break
        touched = written(marks.select(F.col("b").alias("cls")).distinct(), f"{folder}/touched-{k}")
        rows, before, left = join_small(source, touched, ["cls"]), left, touched.count()
        if before is not None and 4 * left < before:  # all further rounds read these few
            rows = source = written(rows.select("cls", "t", "id"), f"{folder}/texts-{k}")
        if before is not None and 2 * left > before:
            found += last_pairs(rows, hashes, shortest, hot, marked, largest, folder)
            break
        hot, k = marked if hot is None else marked | hot, k + 1

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def settle() -> pa.RecordBatch:
            return agreed(*(np.concatenate(x) for x in zip(*held)), need, shortest, slack)

        for batch in batches:
            if batch.num_rows:
                cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
                b, a = cols[:2]
                last = np.flatnonzero((b != b[-1]) | (a != a[-1]))  # all before the pair that may go on
                cut = last[-1] + 1 if len(last) else 0
                if held and (cut or held[-1][0][-1] != b[0] or held[-1][1][-1] != a[0]):
                    held.append([x[:cut] for x in cols])
                    yield settle()
                    held = []
                elif cut:
                    held = [[x[:cut] for x in cols]]
                    yield settle()
                    held = []
                held.append([x[cut:].copy() for x in cols])
        if held:
            yield settle()

    # Both orders of a text give many windows twice; a pair of texts meets in one row for each diagonal and function.
    # Dealt by the pair once, for both groupings.
    every = union_sets(*found).repartition("b", "a").groupBy("b", "a", "diag", "fn").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return every.sortWithinPartitions("b", "a").mapInArrow(check, "b long, a long, diags array<long>")


def agreed(
    b: np.ndarray, a: np.ndarray, diag: np.ndarray, fn: np.ndarray, low: np.ndarray, high: np.ndarray, need: int, shortest: int, slack: int,
) -> pa.RecordBatch:
    """``b, a, diags`` of the pairs that are ``agreeing``; the rows of a pair lie side by side."""
    starts = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (a[1:] != a[:-1])]))
    sizes = np.diff(np.append(starts, len(b)))
    highest = np.maximum.reduceat(fn, starts)
    ok = (highest == SURE) | (need < 2)
    open_ = ~ok & (np.minimum.reduceat(fn, starts) != highest)  # most pairs meet under one function alone
    small = open_ & (sizes <= 64) & (need == 2)
    rows = np.flatnonzero(np.repeat(small, sizes))
    own, d, f, x, y = (v[rows] for v in (np.repeat(np.arange(len(starts)), sizes), diag, fn, low, high))
    for step in range(1, int(sizes[small].max(initial=1))):
        shared = np.minimum(y[step:], y[:-step]) - np.maximum(x[step:], x[:-step]) + 1 >= shortest
        ok[own[step:][shared & (own[step:] == own[:-step]) & (f[step:] != f[:-step]) & (np.abs(d[step:] - d[:-step]) <= slack)]] = True
    for k in np.flatnonzero(open_ & ~small).tolist():
        part = slice(starts[k], starts[k] + sizes[k])
        ok[k] = agreeing(diag[part], fn[part], low[part], high[part], need, shortest, slack)
    rows = np.flatnonzero(np.repeat(ok, sizes))
    own, diag = np.repeat(np.cumsum(ok)[ok] - 1, sizes[ok]), diag[rows]
    order = np.lexsort((diag, own))
    own, diag = own[order], diag[order]
    once = np.concatenate([[True], (own[1:] != own[:-1]) | (diag[1:] != diag[:-1])])[:len(own)]
    ends = np.cumsum(np.bincount(own[once], minlength=int(ok.sum())))
    diags = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(diag[once]))
    return pa.RecordBatch.from_arrays([pa.array(b[starts[ok]]), pa.array(a[starts[ok]]), diags], names=["b", "a", "diags"])


class Places:
    """Where the tokens of a text are."""

    def __init__(self, tokens: np.ndarray):
        self.tokens, self.order = tokens, np.argsort(tokens, kind="stable")
        ranked = tokens[self.order]
        self.starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(tokens) else np.zeros(0, dtype=np.int64)
        self.values, self.ends = ranked[self.starts], np.append(self.starts[1:], len(tokens))
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[tokens & 0xFFFF] = True

    def equal(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """All ``(i, j)`` with ``b[i] == tokens[j]``; None if repeated tokens would make them too many to list."""
        i = self.seen[b & 0xFFFF].nonzero()[0]  # few others have the same last bits
        run = self.values.searchsorted(b[i])
        run[run == len(self.values)] = 0
        same = self.values[run] == b[i]
        i, run = i[same], run[same]
        low = self.starts[run]
        many = self.ends[run] - low
        total = int(many.sum())
        if total > 8 * (len(self.tokens) + len(b)):
            return None
        if total == len(i):
            return i, self.order[low]
        return np.repeat(i, many), self.order[np.repeat(low - np.cumsum(many) + many, many) + np.arange(total)]


def matching_spans(
    b: np.ndarray, a: np.ndarray, diags: list[int], shortest: int, similarity: float, slack: int, gap: int,
    places: Places | None = None,
) -> list[tuple[int, int, int, int, float]]:
    """``(b_first, b_last, a_first, a_last, jaccard)`` of the longest runs near the diagonals, in tokens.

    Besides the given diagonals all those are looked at near which enough tokens are equal.
    """
    out, clusters, least = [], [], similarity * shortest
    pairs = (places or Places(a)).equal(b)
    if pairs is not None:
        i, j = pairs
        if len(i) < least:
            return out
        off = i - j
        # before[d + margin]: equal tokens on diagonals under d
        margin = len(a) + slack
        before = np.bincount(off + (margin + 1), minlength=len(a) + len(b) + 2 * slack + 1).cumsum()
        at = (before[1:] > before[:-1]).nonzero()[0]
        near = before[at + (slack + 1)] - before[at - slack]
        some = near >= least
        at -= margin
        if len(off) > 2 * (len(a) + len(b)):  # repetitive texts match everywhere: the best diagonal besides the given
            some &= np.arange(len(at)) == near.argmax()
        diags = [*diags, *at[some].tolist()]
    for d in sorted(diags):
        if clusters and d - clusters[-1][1] <= slack and d - clusters[-1][0] <= 2 * slack:
            clusters[-1][1] = d
        else:
            clusters.append([d, d])
    for low, high in clusters:
        if pairs is not None:
            top = len(before) - 1
            if before[min(max(high + slack + 1 + margin, 0), top)] - before[min(max(low - slack + margin, 0), top)] < least:
                continue
            near = ((off >= low - slack) & (off <= high + slack)).nonzero()[0]
            run, at = i[near], j[near]
            if (run[1:] == run[:-1]).any():  # b[i] lies opposite a[where[i]]; of several places the nearest diagonal is written last
                near = near[np.argsort(-np.abs(2 * off[near] - low - high), kind="stable")]
                where = np.full(len(b), -1, dtype=np.int64)
                where[i[near]] = j[near]
                run = np.flatnonzero(where >= 0)
                at = where[run]
        else:
            where = np.full(len(b), -1, dtype=np.int64)
            for d in sorted(range(low - slack, high + slack + 1), key=lambda d: abs(2 * d - low - high), reverse=True):
                i0, i1 = max(0, d), min(len(b), len(a) + d)
                if i0 < i1:
                    hit = np.flatnonzero(b[i0:i1] == a[i0 - d:i1 - d]) + i0
                    where[hit] = hit - d
            run = np.flatnonzero(where >= 0)
            at = where[run]
        steps, across = run[1:] - run[:-1], at[1:] - at[:-1]
        borders = [0, *((steps > gap).nonzero()[0] + 1).tolist(), len(run)]
        stack = [(x, y, False) for x, y in zip(borders, borders[1:])]
        while stack:
            x, y, ordered = stack.pop()
            if y - x < least:
                continue
            first, last = run.item(x), run.item(y - 1)
            length = last - first + 1
            # repeated tokens of one side lie opposite one of the other
            ordered = ordered or y - x == 1 or bool(across[x:y - 1].min() > 0)
            if ordered:
                common, a_first, a_last = y - x, at.item(x), at.item(y - 1)
            else:
                common, a_first, a_last = min(y - x, len(np.unique(at[x:y]))), at[x:y].min().item(), at[x:y].max().item()
            jaccard = common / (length + a_last - a_first + 1 - common)
            if y - x > 1 and jaccard < similarity:
                cut = x + int(steps[x:y - 1].argmax()) + 1
                if steps.item(cut - 1) == 1:  # no gap in b: the other side jumps; cut there
                    cut = x + int(np.abs(across[x:y - 1] - 1).argmax()) + 1
                stack += [(x, cut, ordered), (cut, y, ordered)]
            elif length >= shortest:
                out.append((first, last, a_first, a_last, jaccard))
    return out


def verified(pairs: DataFrame, grams: DataFrame, shortest: int, similarity: float, slack: int, gap: int, folder: str) -> DataFrame:
    """``FOUND`` rows of the pairs: every pair is compared, in blocks of later texts that share their first earlier one.

    Pairs of a family of texts lie mostly in one block then, and a text is sent once to a block instead of once for each of its
    pairs.  A block holds about ``BLOCK_TEXTS`` later texts; the earlier ones pass by them one at a time.
    """
    homes = pairs.groupBy("hb").agg(F.min(F.struct("a", "ha")).alias("first")).select("hb", F.col("first.ha").alias("home"))
    homes = written(homes, f"{folder}/homes")
    large = written(
        homes.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS).cast("int").alias("blocks")).where("blocks > 1"), f"{folder}/large"
    )
    block = F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.expr("pmod(xxhash64(hb), blocks)")).cast("int").alias("block")
    dealt = written(join_small(homes, large, ["home"], "left").select("hb", "home", block), f"{folder}/dealt")
    met = pairs.join(dealt, "hb").groupBy("home", "block", "ha").agg(F.collect_list(F.struct("hb", "b", "a", "diags")).alias("met"))
    none = F.lit(None).cast(met.schema["met"].dataType)
    later = dealt.join(grams, dealt["hb"] == grams["cls"]).select("home", "block", none.alias("met"), "cls", "grams")
    earlier = met.join(grams, met["ha"] == grams["cls"]).select("home", "block", "met", "cls", "grams")
    rows = later.union(earlier).repartition("home", "block").sortWithinPartitions("home", "block", F.col("met").isNotNull(), "cls")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 2, pa.int64(), *[pa.int32()] * 2, pa.float64()]
        names = [c.split()[0] for c in FOUND.split(", ")]
        at, held = None, {}
        for batch in batches:
            out = []
            for home, k, met, cls, tokens in zip(*batch.columns):
                unit, tokens = (home.as_py(), k.as_py()), np.frombuffer(tokens.as_buffer(), np.uint32)
                if unit != at:
                    at, held = unit, {}
                if not met.is_valid:
                    held[cls.as_py()] = tokens.copy()  # the batch need not stay
                    continue
                places = Places(tokens)
                for x in met.as_py():
                    for i0, i1, j0, j1, jaccard in matching_spans(held[x["hb"]], tokens, x["diags"], shortest, similarity, slack, gap, places):
                        out.append((x["b"], x["hb"], i0, i1 + WIDTH, x["a"], j0, j1 + WIDTH, jaccard))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    return rows.mapInArrow(verify, FOUND)


def repeated_passages(
    docs: DataFrame, min_words: int = 50, similarity: float = 0.8, hashes: int = 5, need: int = 2,
    slack: int = 10, gap: int = 12, largest: int = 64, key: str = "doc_id", text: str = "text", folder: str | None = None,
) -> DataFrame:
    """Passages of at least ``min_words`` words that an earlier document (by id) holds too: see ``SPANS``.

    One row for a passage and the document it was verified against; a copy of a whole text has one row, against the
    first document with that text, which stands for all of them.  A pair of texts is verified where ``need`` of the
    ``hashes`` functions agree on a stretch; at similarity s one agrees with probability s.  Exact repeats always agree.

    NULL or short texts and rows without an id give no rows; passages repeated inside one document only
    give none; rows that repeat an id are one document.  Words are compared without case.  Texts may be of any length,
    other columns are not read, whatever their names, and an empty table gives no rows.  Of documents with the same
    passage the smallest id is the earlier one.
    """
    if not 1 <= hashes < SURE or not 1 <= need <= hashes:
        raise ValueError(f"1 <= need <= hashes < {SURE}")
    folder = folder or run_path(docs.sparkSession, "passages")
    shortest = max(3, min_words - WIDTH + 1)
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).where("id is not null and t is not null")
    rows = rows.withColumn("cls", F.xxhash64("t"))
    named = rows.select("id", "cls")
    classes = written(named.groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), f"{folder}/classes")
    several = written(classes.where("n > 1").select("cls", "rep"), f"{folder}/several")
    later = written(join_small(named, several, ["cls"]).where("id <> rep").select("cls", "id").distinct(), f"{folder}/later")
    source = join_small(rows, later, ["cls", "id"], "left_anti")
    wanted = candidate_pairs(source, hashes, need, shortest, slack, largest, folder)

    # The later document of a pair is the one with the larger id.
    of_b, of_a = (classes.select(F.col("cls").alias(x), F.col("rep").alias(f"{x}_id")) for x in "ba")
    placed = wanted.join(of_b, "b").join(of_a, "a").where("a_id <> b_id")
    turned = F.col("a_id") > F.col("b_id")
    either = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    pairs = written(placed.select(
        either("b", "a").alias("hb"), either("a", "b").alias("ha"), either("b_id", "a_id").alias("b"), either("a_id", "b_id").alias("a"),
        F.when(turned, F.transform("diags", lambda d: -d)).otherwise(F.col("diags")).alias("diags"),
    ), f"{folder}/pairs")
    needed = written(pairs.select(F.col("hb").alias("cls")).union(pairs.select("ha")).distinct(), f"{folder}/needed")
    texts = join_small(source, needed, ["cls"]).dropDuplicates(["cls"]).select("cls", "t")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                rows = whole.slice(begin, 500)
                tokens, sizes = text_shingles(rows.column(1).to_pylist())
                grams = [part.tobytes() for part in np.split(tokens.astype(np.uint32), np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(grams, pa.binary())], names=["cls", "grams"])

    grams = written(texts.mapInArrow(hashed, "cls long, grams binary"), f"{folder}/grams")
    spans = verified(pairs, grams, shortest, similarity, slack, gap, folder).distinct()
    per_text = written(spans.groupBy("text_hash").agg(F.collect_set(F.struct(*(c.split()[0] for c in FOUND.split(", ") if not c.startswith("text")))).alias("spans")), f"{folder}/found")
    cut = join_small(source, per_text.select(F.col("text_hash").alias("cls")), ["cls"]).dropDuplicates(["cls"]).select(F.col("cls").alias("text_hash"), "t")

    def placed_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The characters of the spans, found once for a text."""
        for batch in few_rows(batches):
            out = []
            for h, found, t in zip(*(c.to_pylist() for c in batch.columns)):
                at = [m.span() for m in _SPAN.finditer(t)]
                for f in found:
                    first, end = f["word_start"], f["word_end"]
                    out.append((f["doc_id"], h, first, end, at[first][0], at[end - 1][1], f["source_doc_id"], f["source_start"], f["source_end"], f["similarity"]))
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64(), *[pa.int32()] * 2, pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in SPANS.split(", ")])

    repeats = per_text.join(cut, "text_hash").select("text_hash", "spans", "t").mapInArrow(placed_in, SPANS)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            spans = [(h, *_whole_span(t)) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            spans = [x for x in spans if x[1] >= min_words]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in spans], pa.int64()) for k in range(4)], names=["cls", "words", "first", "end"])

    copied = join_small(source, several, ["cls"]).dropDuplicates(["cls"]).select("cls", "t")
    ends = written(copied.mapInArrow(whole, "cls long, words long, first long, end long").join(several, "cls"), f"{folder}/whole")
    int_ = lambda c: (F.col(c) if isinstance(c, str) else F.lit(c)).cast("int")
    copies = join_small(later, ends, ["cls"]).select(
        F.col("id").alias("doc_id"), F.col("cls").alias("text_hash"), int_(0).alias("word_start"), int_("words").alias("word_end"),
        int_("first").alias("char_start"), int_("end").alias("char_end"), F.col("rep").alias("source_doc_id"),
        int_(0).alias("source_start"), int_("words").alias("source_end"), F.lit(1.0).alias("similarity"),
    )
    return repeats.union(copies)


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """The batches in pieces whose texts a task may hold as Python strings."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def _whole_span(text: str) -> tuple[int, int, int]:
    """Number of words, first character and end of a text without the space around it."""
    inner = text.lstrip()
    first = len(text) - len(inner)
    return len(inner.split()), first, first + len(inner.rstrip())


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: str | None = "n_chars", **options) -> DataFrame:
    """Cuts every repeated passage but its first occurrence; texts left blank by that go.

    All columns are returned, whatever their names; ``chars`` is counted anew for cut texts.  Rows without a repeat stay
    as they came, those without an id or text too; an empty table stays one.
    """
    spans = repeated_passages(docs, key=key, text=text, **options).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).agg(
        F.array_sort(F.collect_set(F.struct("char_start", "char_end"))).alias("_cuts")
    )
    names, at = docs.columns, docs.columns.index(text)
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))  # no column of the table can clash with those joined to it
    own = (plain[f"c{names.index(key)}"] == spans["_id"]) & (F.xxhash64(plain[f"c{at}"]) == spans["_h"])
    marked = plain.join(spans, own, "left").drop("_id", "_h")
    count_at = names.index(chars) if chars in names else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            cuts = batch.column(len(names)).to_pylist()
            texts, changed = batch.column(at).to_pylist(), [c is not None for c in cuts]
            for i, c in enumerate(cuts):
                if c:
                    kept, done = [], 0
                    for s in c:
                        if s["char_start"] > done:
                            kept.append(texts[i][done:s["char_start"]].strip())
                        done = max(done, s["char_end"])
                    kept.append(texts[i][done:].strip())
                    texts[i] = "\n".join(x for x in kept if x)
            columns = list(batch.columns[:len(names)])
            columns[at] = pa.array(texts, columns[at].type)
            if count_at is not None:
                n = [len(t) if x else None for t, x in zip(texts, changed)]
                old = columns[count_at].to_pylist()
                columns[count_at] = pa.array([o if v is None else v for o, v in zip(old, n)], columns[count_at].type)
            keep = pa.array([not x or bool(t) for t, x in zip(texts, changed)])
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(keep)

    return marked.mapInArrow(cut, docs.schema)
