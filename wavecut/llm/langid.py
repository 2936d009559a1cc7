"""Language identification by segmentation-marginalised unigram models.

The pieces are a fixed public vocabulary; each language has its own piece probabilities, counted on
labelled texts.  The probability of a word is the sum over all its segmentations into pieces, by a forward
algorithm that runs over many words at once; a text is the product of its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNDETERMINED = "und"
_RUN = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 20
_LONGEST = 16


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def letter_runs(word: str) -> list[str]:
    """Lower-cased runs of a word that hold a letter."""
    return [r for r in _RUN.findall(word.lower()) if any(map(str.isalpha, r))]


class PieceTable:
    """Finds the pieces of a vocabulary at all places of many words."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.encode = sp.encode
        special = {i for i in range(sp.vocab_size()) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.size = sp.vocab_size()
        pieces = {i: sp.id_to_piece(i) for i in range(self.size) if i not in special}
        self.ids = np.array([i for i, p in pieces.items() if len(p) <= _LONGEST], dtype=np.int64)
        texts = [pieces[i] for i in self.ids.tolist()]
        self.longest = max(map(len, texts), default=1)
        hashes = np.array([self._hash(p) for p in texts], dtype=np.uint64)
        # Two tables by different bits of the hash; what finds both slots taken goes to a short list.
        self.tables = []
        rest = np.arange(len(hashes))
        while len(rest):
            slot = self._slot(hashes[rest], len(self.tables))
            _, first = np.unique(slot, return_index=True)
            key, value = np.zeros(1 << _SLOT_BITS, dtype=np.uint64), np.full(1 << _SLOT_BITS, -1, dtype=np.int64)
            key[slot[first]], value[slot[first]] = hashes[rest[first]], self.ids[rest[first]]
            self.tables.append((key, value))
            rest = np.delete(rest, first)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & ((1 << 64) - 1)
        return h

    @staticmethod
    def _slot(h: np.ndarray, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
        return (mixed >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each substring hash, -1 where there is none."""
        out = np.full(len(h), -1, dtype=np.int64)
        for k, (key, value) in enumerate(self.tables):
            slot = self._slot(h, k)
            hit = key[slot] == h
            out[hit] = value[slot[hit]]
        return out


@dataclass
class Model:
    """``log_p[piece, language]`` as probabilities; the last row is a character outside the vocabulary."""

    languages: list[str]
    p: np.ndarray

    @classmethod
    def fit(cls, counts: dict[str, np.ndarray], size: int, smoothing: float = 0.1) -> "Model":
        languages = sorted(counts)
        p = np.zeros((size + 1, len(languages)))
        for k, name in enumerate(languages):
            seen = counts[name] + smoothing
            p[:size, k] = seen / (seen.sum() + 1)
            p[size, k] = smoothing / (seen.sum() + 1) / 100
        return cls(languages, p)


#: Longer runs of letters are scored by themselves.
LONG_RUN = 512


def word_log_probabilities(words: list[str], table: PieceTable, model: Model) -> np.ndarray:
    """log P(word | language), summed over all segmentations; words without white space."""
    out = np.zeros((len(words), len(model.languages)))
    order = sorted((i for i, w in enumerate(words) if len(w) <= LONG_RUN), key=lambda i: len(words[i]))
    for i, w in enumerate(words):
        if len(w) > LONG_RUN:
            out[i] = _forward_long("▁" + w, table, model)
    at = 0
    while at < len(order):
        longest = len(words[order[min(at + 20_000, len(order)) - 1]]) + 1
        some = order[at:at + max(1, min(20_000, 2_000_000 // longest))]
        out[some] = _forward(["▁" + words[i] for i in some], table, model)
        at += len(some)
    return out


def _forward(words: list[str], table: PieceTable, model: Model) -> np.ndarray:
    n, longest, langs = len(words), max(map(len, words)), len(model.languages)
    size = np.array([len(w) for w in words])
    chars = np.array(words, dtype=f"<U{longest}").view(np.uint32).reshape(n, longest).astype(np.uint64)
    unknown = len(model.p) - 1
    window = table.longest
    alpha = np.zeros((longest + 1, n, langs))
    alpha[0] = 1.0
    logs, result = np.zeros((n, langs)), np.zeros((n, langs))
    # suffix[j]: hash of the characters from j to the current end
    suffix: dict[int, np.ndarray] = {}
    with np.errstate(over="ignore"):
        for end in range(1, longest + 1):
            c = chars[:, end - 1] + np.uint64(1)
            suffix = {j: h * _BASE + c for j, h in suffix.items() if end - j <= window}
            suffix[end - 1] = c
            live = size >= end
            total = np.zeros((n, langs))
            for j, h in suffix.items():
                piece = table.find(h[live])
                if j == end - 1:
                    piece[piece < 0] = unknown
                hit = piece >= 0
                if hit.any():
                    rows = np.flatnonzero(live)[hit]
                    total[rows] += alpha[j, rows] * model.p[piece[hit]]
            alpha[end] = total
            if end % 16 == 0 or end == longest:
                top = np.where(live[:, None], total, 1.0)
            else:
                top = None
            done = size == end
            result[done] = np.log(total[done]) + logs[done]
            if top is not None and end < longest:
                alpha[max(0, end - window):end + 1] /= top
                logs += np.log(top)
    return result


def _forward_long(word: str, table: PieceTable, model: Model, block: int = 4096) -> np.ndarray:
    """The sum of ``_forward`` for one word of any length.

    The pieces that end at each character of a block are looked up at once; what is kept beside the block are
    the sums of the last ``table.longest`` ends.
    """
    window, langs, unknown = table.longest, len(model.languages), len(model.p) - 1
    block = max(block, window)
    chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    p = np.vstack([model.p, np.zeros(langs)])  # the last row stands for no piece
    alpha, logs = np.zeros((window, langs)), np.zeros(langs)
    alpha[-1] = 1.0
    for at in range(0, len(chars), block):
        before = min(at, window)
        c = chars[at - before:at + block]
        m = len(c) - before
        pieces = np.empty((m, window), dtype=np.int64)
        h = np.zeros(len(c), dtype=np.uint64)  # hash of the last characters up to each end
        for length in range(1, window + 1):
            h = np.concatenate([np.zeros(1, np.uint64), h[:-1]]) * _BASE + c
            found = table.find(h[before:])
            if length == 1:
                found[found < 0] = unknown
            found[:max(0, length - 1 - at)] = -1  # would start before the word
            pieces[:, window - length] = found
        weights = p[pieces]
        rows = np.concatenate([alpha, np.empty((m, langs))])
        for k in range(m):
            total = (rows[k:k + window] * weights[k]).sum(axis=0)
            rows[k + window] = total
            if (at + k + 1) % 16 == 0:
                rows[k + 1:k + window + 1] /= total
                logs += np.log(total)
        alpha = rows[-window:].copy()
    return np.log(alpha[-1]) + logs


class _Scorer:
    """Word scores in a bounded table, computed for all new words of a batch at once."""

    def __init__(self, table: PieceTable, model: Model, limit: int = 300_000):
        self.table, self.model, self.limit = table, model, limit
        self._reset()

    def _reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)))

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each text and language, and whether the text has a letter."""
        if len(self.rows) > self.limit:
            self._reset()
        split = [(t or "").split() for t in texts]
        known, new = self.rows, []
        for words in split:
            for w in words:
                if w not in known:
                    known[w] = len(known)
                    new.append(w)
        if new:
            runs = [letter_runs(w) for w in new]
            flat = list(dict.fromkeys(r for x in runs for r in x))
            place = {r: i for i, r in enumerate(flat)}
            each = word_log_probabilities(flat, self.table, self.model)
            owner = np.repeat(np.arange(len(new)), [len(x) for x in runs])
            added = np.zeros((len(new), each.shape[1]))
            np.add.at(added, owner, each[[place[r] for x in runs for r in x]])
            # A word without letters has no evidence; marked by NaN to tell it from a sure word.
            added[np.array([not x for x in runs], dtype=bool)] = np.nan
            self.scores = np.concatenate([self.scores, added])
        total, letters = np.zeros((len(texts), self.scores.shape[1])), np.zeros(len(texts), dtype=bool)
        for i, words in enumerate(split):
            if words:
                got = self.scores[np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))]
                total[i] = np.nansum(got, axis=0)
                letters[i] = not np.isnan(got).all()
        return total, letters


def held_out(key: str = "doc_id", folds: int = 3, fold: int = 1):
    """Whether a row is kept from training: CRC-32 of its id as text; a NULL id is not."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))


def train(labelled: DataFrame, vocabulary: str, text: str = "text", lang: str = "lang") -> Model:
    """Piece probabilities of each language from all rows with a text and a label.

    Each task sums its words, then their pieces; at most vocabulary x languages sums reach the driver.
    """
    size = sentencepiece.SentencePieceProcessor(model_file=vocabulary).vocab_size()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        words: dict[str, Counter] = {}
        sums: dict[str, np.ndarray] = {}

        def flush() -> None:
            for name, counter in words.items():
                runs: Counter = Counter()
                for w, n in counter.items():
                    for r in letter_runs(w):
                        runs[r] += n
                listed, into = list(runs.items()), sums.setdefault(name, np.zeros(size, dtype=np.int64))
                for at in range(0, len(listed), 50_000):
                    part = listed[at:at + 50_000]
                    ids = sp.encode([w for w, _ in part])
                    times = np.repeat([n for _, n in part], [len(x) for x in ids])
                    into += np.bincount(np.fromiter((i for x in ids for i in x), dtype=np.int64), times, size).astype(np.int64)
            words.clear()

        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(name, Counter()).update(t.split())
            if sum(map(len, words.values())) > 300_000:
                flush()
        flush()
        for name, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(s[at], pa.int64())],
                names=["lang", "piece", "n"],
            )

    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    sums = rows.mapInArrow(count, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for name, piece, n in sums.collect():
        counts.setdefault(name, np.zeros(size))[piece] = n
    return Model.fit(counts, size)


def with_language(
    docs: DataFrame, model: Model, vocabulary: str, text: str = "text", pred: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """All columns and rows as they came, with the likeliest language and its posterior probability.

    NULL texts, texts without a letter, and all texts under a model without languages: ``und`` with
    score 0.  Equal scores: the first language by name.  ``pred`` and ``score`` must be new names.
    """
    clash = {pred, score} & set(docs.columns)
    if clash:
        raise ValueError(f"columns exist: {sorted(clash)}")
    at, names = docs.columns.index(text), [*docs.columns, pred, score]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most vocabulary x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(PieceTable(vocabulary), shared.value)
        languages = scorer.model.languages
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                if not languages:
                    best, sure = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
                else:
                    logs, letters = scorer.texts(batch.column(at).to_pylist())
                    odds = np.exp(logs - logs.max(axis=1, keepdims=True))
                    top = logs.argmax(axis=1)
                    best = [languages[k] if ok else UNDETERMINED for k, ok in zip(top, letters)]
                    sure = np.where(letters, (odds.max(axis=1) / odds.sum(axis=1)), 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(sure)], names=names)

    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: trained on the rows that are not held out, applied to all."""
    rows = docs.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), F.col(text).alias("text"))
    model = train(docs.where(~held_out(key)), vocabulary, text, lang)
    return with_language(rows, model, vocabulary).drop("text")
