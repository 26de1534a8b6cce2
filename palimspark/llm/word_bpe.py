"""Token ids of whole texts by a word-level BPE file of the tokenizers library.

The tokenizer drops white space and never merges across it, and it cuts words into pieces (letters, a
digit, symbols) before it merges. Words repeat far more than texts do, so each worker cuts a word once, asks the
library for a piece once, and keeps their ids in a bounded dictionary; a text is then a row of look-ups. Texts that hold a special
token's string, or whose cutting or lower-casing could differ between Python and the library, go through the library word
by word.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterable

#: Distinct words in each of a worker's two generations of memory, about 100 MB each, and the longest word in them.
MEMO_ENTRIES = 500_000
MEMO_CHARS = 64

#: Fixed value: the tokenizer's cutting rule, for lower-cased text.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")

CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")

#: Categories (numbers but digits, unassigned ones) and characters that Python treats, or may treat, in another way than the library.
ODD_CATEGORIES = frozenset(("Nl", "No", "Cn"))
ODD = frozenset(map(chr, (*range(9), *range(14, 32), 127, 0x85, 0x130, 0x3A3)))

_as_is = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: Byte-level spelling of the vocabulary: printable bytes stand for themselves, the others follow from 256.
BYTE_SPELLING = dict(zip(sorted({*range(256)} - _as_is), range(256, 512), strict=False))

_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary file, loaded once."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class _Words(dict):
    """Ids of a word, by its pieces at its first use. Words that the last MEMO_ENTRIES new ones have not met again go."""

    def __init__(self, model, most: int) -> None:
        self._tokenize, self._most, self._older = model.tokenize, most, {}

    def __missing__(self, word: str) -> bytes:
        got = self._older.get(word)
        if got is None:
            pieces = [word] if word.isalpha() else PIECES.findall(word)
            if pieces == [word]:
                spelled = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_SPELLING)
                got = array("I", [t.id for t in self._tokenize(spelled)]).tobytes()
            else:
                got = b"".join([self[p] for p in pieces])
        if len(word) <= MEMO_CHARS:
            self[word] = got
        return got

    def trim(self) -> None:
        if len(self) > self._most:
            self._older = dict(self)
            self.clear()


class WordEncoder:
    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = re.compile("|".join(re.escape(t.content) for t in self._tokenizer.get_added_tokens_decoder().values()))
        self._plain: set[str] = set()  # characters seen and found fit for Python's way
        self._words = _Words(self._tokenizer.model, memo_entries)

    def _by_library(self, text: str) -> bytes:
        words = [w.decode() for w in text.encode().split()]
        return b"".join(array("I", e.ids).tobytes() for e in self._tokenizer.encode_batch_fast(words, add_special_tokens=False))

    def _is_odd(self, text: str) -> bool:
        """Whether the library has to cut this text."""
        if "<|" in text and self._special.search(text):
            return True
        if text.isascii():
            return CONTROL.search(text) is not None
        fresh = set(text) - self._plain
        if any(c in ODD or unicodedata.category(c) in ODD_CATEGORIES for c in fresh):
            return True
        self._plain |= fresh
        return not unicodedata.is_normalized("NFC", text)

    def encode(self, texts: Iterable[str | None], end_id: int) -> list[bytes]:
        """For each text its ids and then ``end_id``, as little-endian unsigned 32-bit integers."""
        end, out = array("I", [end_id]).tobytes(), []
        for text in texts:
            self._words.trim()
            if not text:
                out.append(end)
            elif self._is_odd(text):
                out.append(self._by_library(text) + end)
            else:
                out.append(b"".join([*map(self._words.__getitem__, text.lower().split()), end]))
        return out
