"""Encoding of whole texts with a public tokenizer, one encoding per distinct word.

A text splits at spaces and line feeds, which the tokenizer drops and never merges across, so the ids
of the text are those of its words in order.  Words are looked up in a bounded table of encoded words.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

_PLAIN_TAIL = ".,;:!?|#$%&*"
_LATIN_END = "ɐ"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Bounded(dict):
    """A dict that fills itself and starts anew at ``limit`` entries."""

    def __init__(self, make, limit: int):
        super().__init__()
        self._make, self._limit = make, limit

    def __missing__(self, key):
        if len(self) >= self._limit:
            self.clear()
        value = self[key] = self._make(key)
        return value


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level models use for each byte (public byte-to-letter rule)."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in keep}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


class WordEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, limit: int = 400_000):
        self.tokenizer = Tokenizer.from_file(path)
        self._letters = _byte_letters()
        self._cores = _Bounded(self._run, limit)
        self._words = _Bounded(self._word, limit)

    def _run(self, letters: str) -> bytes:
        """One run of letters, or of marks, in the model's alphabet."""
        tokens = self.tokenizer.model.tokenize(letters.encode().decode("latin-1").translate(self._letters))
        return np.array([t.id for t in tokens], dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        low = unicodedata.normalize("NFC", word).lower()
        core = low.rstrip(_PLAIN_TAIL)
        if core.isalpha() and max(core) < _LATIN_END:
            tail = low[len(core):]
            return self._cores[core] + (self._cores[tail] if tail else b"")
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self._words.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each worker process."""
    return WordEncoder(path)
