"""Token ids of whole texts through the tokenizers library, with a bounded cache of words.

The tokenizer drops white space and never joins across it, so a text's ids are those of its
white-space separated parts in order.  Only parts not met before go to the library, when they
are looked up; ids are kept as little-endian unsigned 32-bit bytes, so a text's ids are one join.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np

#: Parts of one generation that a worker keeps (about 80 MB).  A full generation becomes the old
#: one, from which parts that are met again move on; so common words stay known.
CACHE_PARTS = 320_000
#: str.split() also splits at these, which the tokenizer takes for ordinary characters.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_WHITE = re.compile(r"[^\S\x1c-\x1f]+")
#: Words on which the short way for Latin words is compared with the tokenizer before it is used.
PROBES = ("word", "Word", "WORD.", "Éclair,", "ÑANDÚ", "straße", "łódź", "antidisestablishmentarianism", "x", "Qqzv.", "déjà", "Ąć,", "WORD!!", "Éclair.###", "łódź,&&&")
#: Marks that may close a word, and how many of them are told from the word.
MARKS, MOST_MARKS = ".,;:!?#$%&*", 4


def _byte_letters() -> list[str]:
    """The letter for each byte in byte-level vocabularies: itself if printable, else the next
    of those from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


_BYTE_LETTERS = _byte_letters()


class _Known(dict):
    """Ids of parts; a part that is not there is learned."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, part: str) -> bytes:
        self[part] = found = self.learn(part)
        return found


class WordEncoder:
    """For tokenizers whose pre-tokenizer removes white space (word_bpe_49k.json is one)."""

    def __init__(self, path: str, cache_parts: int = CACHE_PARTS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.cache_parts = self.tokenizer.model, cache_parts
        self.marks = {"": b""}
        self.ids, self.old = _Known(self._learn), {}
        # whether this tokenizer reads Latin words as _learn takes them; if not, all go to it whole
        self.plain = all(self._whole(x) == self._word(w.lower()) + self._closing(x[len(w) :]) for x in PROBES for w in [x.rstrip(MARKS)])

    @staticmethod
    def parts(text: str) -> list[str]:
        if any(x in text for x in _SEPARATORS):
            return [x for x in _WHITE.split(text) if x]
        return text.split()

    def _word(self, word: str) -> bytes:
        """Ids of a lower-case Latin word straight from the tokenizer's model: such a word is one
        pre-token that the normaliser leaves alone, and the model reads its bytes as letters."""
        tokens = self.model.tokenize(word if word.isascii() else "".join(map(_BYTE_LETTERS.__getitem__, word.encode())))
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def _whole(self, part: str) -> bytes:
        return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    def _closing(self, marks: str) -> bytes:
        """Ids of few marks; there are not many such strings, so all are kept."""
        found = self.marks.get(marks)
        if found is None:
            self.marks[marks] = found = self._whole(marks)
        return found

    def _learn(self, part: str) -> bytes:
        found = self.old.get(part)
        if found is not None:
            return found
        # "Word.#" is "word" and ".#": letters and the marks after them are separate pre-tokens
        bare = part.rstrip(MARKS)
        word, marks = bare.lower(), part[len(bare) :]
        if not (self.plain and word.isalpha() and len(marks) <= MOST_MARKS and (word.isascii() or max(word) < "\u0250")):
            return self._whole(part)
        found = self.ids.get(word) or self.old.get(word) or self._word(word)
        if word != part:
            self.ids[word] = found
        return found + self._closing(marks) if marks else found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        if len(self.ids) > self.cache_parts:
            self.ids, self.old = _Known(self._learn), self.ids
        known = self.ids.__getitem__
        return [b"".join(map(known, self.parts(x))) for x in texts]


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder: its words stay known from task to task."""
    return WordEncoder(path)
