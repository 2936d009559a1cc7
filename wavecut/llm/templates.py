"""Benchmark decontamination by template: questions are found again when numbers, names or units change.

Texts become token sequences in which numbers, names and units are typed placeholders.  Windows of tokens
are hash-joined with the windows of the benchmark items; a filter of fixed size keeps windows that cannot
match from being shuffled.  An occurrence needs most windows of an item in step, and the slots must be
consistent: one value of the item always stands for one value of the document.  A second stream of the words as they are, without
case, finds copies in which names can no longer be told from words, and items that are all slots.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavecut.llm.common import mix64, run_path, written
from wavecut.sources.storage import BROADCAST_ROWS

PLAIN, NUMBER, NAME, UNIT = 0, 1, 2, 3
_SKIP, _WORD, _NUM, _NUM_UNIT, _TITLE, _UNIT_WORD = range(6)
# Common units of measure.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz pound pounds ton tons ml cl "
    "l liter liters litre litres gal gallon gallons s sec second seconds min minute minutes h hr hour hours day days week "
    "weeks month months year years k c f degrees hz khz mhz ghz w kw mw v a j kj cal kcal pa kpa bar b kb mb gb tb mph "
    "kmh percent % $ € £ ¥ usd eur gbp dollar dollars euro euros cent cents meter meters metre metres gram grams "
    "kilogram kilograms kilometer kilometers kilometre kilometres".split()
)
# Numbers in words; "one" is too often a pronoun.
NUMBER_WORDS = frozenset(
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
)
_MARKS = "".join(c for c in string.punctuation if c not in "%$") + "«»“”„‘’…–—¿¡"
_NUMBER = re.compile(r"([€$£¥]?)([+-]?\d+(?:[.,:/]\d+)*)([^\W\d_]*|[%€$£¥])$")
_POSSESSIVE = re.compile(r"(\w\w+)['’]s$")
_HASH_BASE = np.uint64(0x100000001B3)
#: Texts whose windows a task holds at once.
SCAN_ROWS = 250


class WordKinds:
    """Kind, hash and slot values of each distinct word, in a bounded table."""

    def __init__(self, limit: int = 100_000):
        self.limit = limit
        self._reset()

    def _reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.values: list[tuple[str, ...]] = []
        self._kind, self._hash, self._ends = [], [], []  # of the words since the arrays were last made longer
        self.kind = np.zeros(0, dtype=np.int8)
        self.hash, self.ends = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)

    def _add(self, word: str) -> None:
        core, kind, values = word.strip(_MARKS), _WORD, ()
        low = core.lower()
        if not core:
            kind = _SKIP
        elif core.isalpha():
            if low in UNITS:
                kind, values = _UNIT_WORD, (low,)
            elif low in NUMBER_WORDS:
                kind, values = _NUM, (low,)
            elif len(core) > 1 and core[0].isupper() and core[1:].islower():
                kind, values = _TITLE, (low,)
        elif (m := _POSSESSIVE.match(core)) and m[1].isalpha() and m[1][0].isupper() and m[1][1:].islower():
            kind, values = _TITLE, (m[1].lower(),)
        elif m := _NUMBER.match(core):
            before, number, after = m.groups()
            unit = (before + after).lower()
            kind, values = (_NUM_UNIT, (number, unit)) if unit else (_NUM, (number,))
        elif low in UNITS:
            kind, values = _UNIT_WORD, (low,)
        self.rows[word] = len(self.rows)
        self.values.append(values)
        self._kind.append(kind)
        self._hash.append(xxhash.xxh64_intdigest(low))
        self._ends.append(word.rstrip("\"'”»)]")[-1:] in (".", "!", "?", ":"))

    def tokens(self, texts: list[str | None]) -> "Tokens":
        if len(self.rows) > self.limit:
            self._reset()
        split = [(t or "").split() for t in texts]
        known = self.rows
        for words in split:
            for w in words:
                if w not in known:
                    self._add(w)
        if self._kind:
            self.kind = np.concatenate([self.kind, np.array(self._kind, dtype=np.int8)])
            self.hash = np.concatenate([self.hash, np.array(self._hash, dtype=np.uint64)])
            self.ends = np.concatenate([self.ends, np.array(self._ends, dtype=bool)])
            self._kind, self._hash, self._ends = [], [], []
        sizes = np.array([len(w) for w in split], dtype=np.int64)
        row = np.fromiter((known[w] for words in split for w in words), dtype=np.int64, count=int(sizes.sum()))
        return Tokens(self, row, np.repeat(np.arange(len(split)), sizes))


class Tokens:
    """Tokens of many texts, end to end."""

    def __init__(self, kinds: WordKinds, row: np.ndarray, doc: np.ndarray):
        kind = kinds.kind[row]
        opens = np.ones(len(row), dtype=bool)
        opens[1:] = kinds.ends[row[:-1]] | (doc[1:] != doc[:-1])
        opens &= kind == _TITLE
        kind = np.where(opens, _WORD, kind)
        n = int(doc[-1]) + 1 if len(doc) else 0
        said = kind != _SKIP
        self.word_hash, self.word_doc = kinds.hash[row[said]], doc[said]
        self.word_first = np.searchsorted(self.word_doc, np.arange(n + 1))
        # names in a row are one
        more = np.zeros(len(row), dtype=bool)
        more[1:] = (kind[1:] == _TITLE) & (kind[:-1] == _TITLE) & (doc[1:] == doc[:-1]) & ~kinds.ends[row[:-1]]
        word = np.repeat(np.arange(len(row)), np.where(~said | more, 0, np.where(kind == _NUM_UNIT, 2, 1)))
        self.kinds, self.row, self.doc, self.opener = kinds, row[word], doc[word], opens[word]
        self.second = np.zeros(len(word), dtype=bool)
        self.second[1:] = word[1:] == word[:-1]
        k = kind[word]
        self.type = np.select(
            [k == _NUM, (k == _NUM_UNIT) & ~self.second, k == _NUM_UNIT, k == _TITLE], [NUMBER, NUMBER, UNIT, NAME], PLAIN
        )
        after = np.zeros(len(word), dtype=bool)
        after[1:] = (self.type[:-1] == NUMBER) & (self.doc[1:] == self.doc[:-1])
        self.type[(k == _UNIT_WORD) & after] = UNIT
        self.hash = np.where(self.type == PLAIN, kinds.hash[self.row], self.type.astype(np.uint64))
        self.exact = kinds.hash[self.row] ^ self.second.astype(np.uint64)
        self.first = np.searchsorted(self.doc, np.arange(n + 1))

    def literal_windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each window of words as they are, without case and marks."""
        n = len(self.word_hash) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.word_doc[:n] == self.word_doc[width - 1:])
        h = np.full(len(at), width, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(width):
                h = (h ^ (h >> np.uint64(31))) * _HASH_BASE + self.word_hash[at + j]
        return at, mix64(h, 2)

    def windows(self, width: int, literal: int) -> tuple[np.ndarray, ...]:
        """Start and hash of each window inside one text, and three marks for each.

        ``typed``: it has at least ``literal`` plain tokens; windows with fewer are hashed with the values in
        their slots and are found verbatim only.  ``names``: bits of the capitalised sentence openers that are read as
        names; a typed window has one row for each such reading.  ``firm``: typed even if all of them are names.
        """
        n = len(self.hash) - width + 1
        if n <= 0:
            none = np.zeros(0, dtype=np.int64)
            return none, none.astype(np.uint64), none.astype(bool), none, none.astype(bool)
        plain, openers = np.zeros(n, dtype=np.int8), np.zeros(n, dtype=np.int64)
        for j in range(width):
            plain += self.type[j:j + n] == PLAIN
            openers |= self.opener[j:j + n].astype(np.int64) << j
        inside = self.doc[:n] == self.doc[width - 1:]
        firm = plain - np.bitwise_count(openers).astype(np.int8) >= literal

        def hashed(at: np.ndarray, names: int = 0, exact: bool = False) -> np.ndarray:
            h = np.full(len(at), width, dtype=np.uint64)
            with np.errstate(over="ignore"):
                for j in range(width):
                    token = np.uint64(NAME) if names >> j & 1 else (self.exact if exact else self.hash)[at + j]
                    h = (h ^ (h >> np.uint64(31))) * _HASH_BASE + token
            return mix64(h, int(exact))

        rows = []
        for exact in (False, True):
            at = np.flatnonzero(inside & ((plain < literal) if exact else (plain >= literal)))
            rows.append((at, hashed(at, exact=exact), 0))
        some = np.flatnonzero(inside & (openers > 0) & (plain > literal))
        for names in range(1, 1 << width):
            at = some[(openers[some] & names == names) & (plain[some] - names.bit_count() >= literal)]
            if len(at):
                rows.append((at, hashed(at, names), names))
        at, h = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
        return at, h, plain[at] >= literal, np.repeat([r[2] for r in rows], [len(r[0]) for r in rows]), firm[at]

    def slots(self, at: int, width: int, names: int = 0) -> list[str]:
        """Type and value of each slot in a window."""
        types = [NAME if names >> j & 1 else int(self.type[at + j]) for j in range(width)]
        return [
            f"{'-#@%'[k]}{self.kinds.values[self.row[i]][int(self.second[i])]}" for i, k in enumerate(types, at) if k != PLAIN
        ]


def _window_table(texts: list[str | None], kinds: WordKinds, width: int, literal: int):
    """Windows of items: those of ``width`` tokens, or the whole item if it is shorter."""
    t = kinds.tokens(texts)
    sizes = np.diff(t.first) if len(t.first) else np.zeros(0, dtype=np.int64)
    for w in sorted({min(width, int(s)) for s in sizes if s}):
        at, h, *marks = t.windows(w, min(literal, w))
        for i, x, typed, names, firm in zip(at.tolist(), h.view(np.int64).tolist(), *(m.tolist() for m in marks)):
            d = int(t.doc[i])
            if min(width, int(sizes[d])) == w:
                yield d, i - int(t.first[d]), w, int(sizes[d]), x, t.slots(i, w, names), typed, names > 0, firm


def _literal_table(texts: list[str | None], kinds: WordKinds, width: int):
    """The same of the words as they are: a second stream, with places of its own."""
    t = kinds.tokens(texts)
    sizes = np.diff(t.word_first)
    for w in sorted({min(width, int(s)) for s in sizes if s}):
        at, h = t.literal_windows(w)
        for i, x in zip(at.tolist(), h.view(np.int64).tolist()):
            d = int(t.word_doc[i])
            if min(width, int(sizes[d])) == w:
                yield d, i - int(t.word_first[d]), w, int(sizes[d]), x


def item_windows(items: DataFrame, width: int = 5, literal: int = 3, key: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, item_pos, width, n_tokens, h, item_slots, typed, named, firm, folded`` of each window of each item.

    ``folded`` windows are of the words as they are, without case, and find copies in other case.  The others are of
    the template.  Windows with fewer than ``literal`` plain tokens are not ``typed``: they match verbatim.  A capitalised sentence
    opener is read as a word, and once more as a name (``named``).  Items of fewer
    than ``literal`` words give no window and match nothing; others are found at least verbatim.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = WordKinds()
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for d, *row in _window_table(batch.column(1).to_pylist(), kinds, width, literal):
                if row[2] >= literal:
                    out.append((ids[d], *row, False))
            for d, *row in _literal_table(batch.column(1).to_pylist(), kinds, width):
                if row[1] >= literal:
                    out.append((ids[d], *row, [], False, False, False, True))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate(
                    (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), *[pa.bool_()] * 4))],
                names=["item_id", "item_pos", "width", "n_tokens", "h", "item_slots", "typed", "named", "firm", "folded"],
            )

    rows = items.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(
        run, "item_id long, item_pos int, width int, n_tokens int, h long, item_slots array<string>, typed boolean, named boolean, firm boolean, folded boolean"
    )


def _filter_words(windows: DataFrame, bits: int) -> np.ndarray:
    """Bit filter over the window hashes, ``2**bits`` bits whatever the number of items."""
    place = F.shiftrightunsigned("h", 64 - bits)
    words = windows.groupBy(F.shiftright(place, 6).alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")).alias("b")
    )
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    for w, b in words.collect():  # at most 2**(bits - 6) rows
        out[w] = np.uint64(b & ((1 << 64) - 1))
    return out


def contaminated(
    docs: DataFrame, items: DataFrame, width: int = 5, similarity: float = 0.8, literal: int = 3, filter_bits: int = 23,
    key: str = "doc_id", text: str = "text", folder: str | None = None,
) -> DataFrame:
    """``doc_id, item_id, similarity, kind, n_slots, token_start`` of each document that holds an item.

    ``similarity``: share of the item's windows found in step; the best occurrence of each item counts.
    ``kind``: ``verbatim`` if all slots agree, ``edited`` if most do but they are not consistent, else
    ``reparameterised``.  NULL, empty and clean texts give no rows; rows with a NULL id are reported
    without one; repeated rows are reported once; an empty benchmark gives no rows.
    """
    spark = docs.sparkSession
    folder = folder or run_path(spark, "templates")
    targets = written(item_windows(items, width, literal), f"{folder}/items")
    widths = sorted(r[0] for r in targets.select("width").distinct().collect())  # at most ``width`` values
    words = spark.sparkContext.broadcast(_filter_words(targets, filter_bits))  # fixed size

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, shift = WordKinds(), np.uint64(64 - filter_bits)
        for whole in batches:
            for first in range(0, whole.num_rows, SCAN_ROWS):
                batch = whole.slice(first, SCAN_ROWS)
                t, ids, out = kinds.tokens(batch.column(1).to_pylist()), batch.column(0).to_pylist(), []
                for w in widths:
                    at, h, _, names, _ = t.windows(w, min(literal, w))
                    place = h >> shift
                    maybe = (words.value[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                    for i, x, m in zip(at[maybe].tolist(), h[maybe].view(np.int64).tolist(), names[maybe].tolist()):
                        d = int(t.doc[i])
                        out.append((ids[d], i - int(t.first[d]), x, t.slots(i, w, m), m > 0))
                    at, h = t.literal_windows(w)
                    place = h >> shift
                    maybe = (words.value[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                    for i, x in zip(at[maybe].tolist(), h[maybe].view(np.int64).tolist()):
                        d = int(t.word_doc[i])
                        out.append((ids[d], i - int(t.word_first[d]), x, [], False))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in out], x) for i, x in enumerate(
                        (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.bool_()))],
                    names=["doc_id", "doc_pos", "h", "doc_slots", "doc_named"],
                )

    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    found = rows.mapInArrow(scan, "doc_id long, doc_pos int, h long, doc_slots array<string>, doc_named boolean")
    # Level 0 judges the typed windows alone, so that changed numbers cost nothing; level 1 judges all windows; level 2
    # also reads sentence openers as names, on the windows that are typed even then; level 3 judges the words as they are.
    word = F.when(F.col("named"), F.array().cast("array<int>")).when(F.col("typed"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    word = F.when(F.col("folded"), F.array(F.lit(3))).otherwise(word)
    levels = targets.withColumn("level", F.explode(F.concat(word, F.when(F.col("firm"), F.array(F.lit(2))).otherwise(F.array().cast("array<int>")))))
    sizes = levels.groupBy("item_id", "level").agg(F.countDistinct("item_pos").alias("n_windows"))
    pairs = found.join(levels.join(sizes, ["item_id", "level"]), "h").where("level = 2 or not doc_named").withColumn(
        "diag", F.col("doc_pos") - F.col("item_pos")
    )

    # Occurrences: runs of nearby diagonals; edits move the diagonal by a few tokens.
    order = Window.partitionBy("doc_id", "item_id", "level").orderBy("diag", "item_pos")
    slack = F.greatest(F.lit(1), F.floor(F.col("n_tokens") * (1 - similarity)))
    jump = F.coalesce((F.col("diag") - F.lag("diag").over(order) > slack).cast("int"), F.lit(1))
    occurrences = pairs.withColumn("jump", jump).withColumn("occ", F.sum("jump").over(order))
    # An item that repeats a template also meets itself on other diagonals: each position keeps its longest run.
    along = Window.partitionBy("doc_id", "item_id", "level", "occ", "diag")
    island = F.col("item_pos") - F.dense_rank().over(along.orderBy("item_pos"))
    run = Window.partitionBy("doc_id", "item_id", "level", "occ", "diag", "island")
    length = F.max("item_pos").over(run) - F.min("item_pos").over(run)
    choice = Window.partitionBy("doc_id", "item_id", "level", "occ", "item_pos").orderBy(
        F.desc("length"), F.col("named") | F.col("doc_named"), "diag"
    )
    occurrences = occurrences.withColumn("island", island).withColumn("length", length).withColumn(
        "choice", F.dense_rank().over(choice)
    ).where("choice = 1")
    occurrences = occurrences.withColumn("doc_slots", F.when(F.col("typed"), F.col("doc_slots")).otherwise(F.col("item_slots")))
    zipped = F.arrays_zip("item_slots", "doc_slots")
    same = F.col("item_slots") == F.col("doc_slots")
    merged = occurrences.groupBy("doc_id", "item_id", "level", "occ", "n_windows").agg(
        (F.countDistinct("item_pos") / F.col("n_windows")).alias("similarity"),
        (F.countDistinct(F.when(same, F.col("item_pos"))) / F.col("n_windows")).alias("literal"),
        F.min("doc_pos").alias("token_start"),
        F.array_distinct(F.flatten(F.collect_set(zipped))).alias("slots"),
    ).where(F.col("similarity") >= similarity)
    names = F.filter("slots", lambda s: F.substring(s["item_slots"], 1, 1) == "@")
    one_to_one = (F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["item_slots"])))) & (
        F.size(names) == F.size(F.array_distinct(F.transform(names, lambda s: s["doc_slots"])))
    )
    equal = ~F.exists("slots", lambda s: s["item_slots"] != s["doc_slots"])
    kind = F.when(equal, "verbatim").when(one_to_one, "reparameterised").when(F.col("literal") >= similarity, "edited")
    judged = merged.withColumn("kind", kind).where("kind is not null").withColumn("n_slots", F.size("slots"))
    best = F.max_by(F.struct("kind", "n_slots", "token_start"), F.struct("similarity", "literal", -F.col("token_start")))
    return judged.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), best.alias("b")).select(
        "doc_id", "item_id", "similarity", "b.kind", "b.n_slots", "b.token_start"
    )


def without_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Rows of the documents that hold no item, as they came; rows without an id stay.

    The ids of the others are written first: up to ``BROADCAST_ROWS`` of them are broadcast, so that the texts are not moved.
    """
    found = contaminated(docs, items, key=key, **options).select(F.col("doc_id").alias("_gone")).distinct()
    found = written(found, f"{run_path(docs.sparkSession, 'contaminated')}/ids")
    small = found.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(found) if small else found, docs[key] == found["_gone"], "left_anti")
