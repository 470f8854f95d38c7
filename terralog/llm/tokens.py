"""Token ids of whole texts with a public tokenizer file, memoised per word.

The tokenizer drops white space and never merges across it, so a text's ids are those of its words in order. Each distinct word goes
through the tokenizers library once per worker; ids are kept as little-endian bytes, so a text is one join. Words that differ in the case
of Latin letters or in trailing punctuation share their parts. This holds for the byte-level word vocabulary named below.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

END_ID = 1
WORDS_KEPT, LONGEST_KEPT = 1_000_000, 64        # bound of the memo: words, and code points a word
#: Python splits at these, the tokenizer does not: such texts are encoded whole.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: A run of these after a letter is a word of its own to the tokenizer.
TAIL = ".,!?;:*#%&$()-\""
#: Below this every letter is in composed form, and lower case is one letter for another.
LATIN_END = "\u0250"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte of a Latin letter: itself if printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    letter = {b: chr(b) if b in plain else chr(next(free)) for b in range(256)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(128, ord(LATIN_END))}


class WordMemo(dict):
    """word -> its ids as little-endian bytes, two bytes an id if the vocabulary allows, else four."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def pack(self, ids: list[int]) -> bytes:
        return np.asarray(ids, dtype=self.kind).tobytes()

    def _ids(self, word: str) -> bytes:
        bare = word.rstrip(TAIL)
        if len(bare) < len(word):
            return self[bare] + self[word[len(bare):]] if bare and bare[-1].isalpha() else self.whole(word)
        small = word.lower()
        if not small.isalpha() or max(word) >= LATIN_END or max(small) >= LATIN_END:
            return self.whole(word)
        # one run of composed Latin letters: nothing to normalise or split, so it is the model's own input
        return self.pack([t.id for t in self.model.tokenize(small if small.isascii() else small.translate(self.letters))])

    def __missing__(self, word: str) -> bytes:
        ids = self._ids(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text and the end id; null is empty."""
        end = self.pack([END_ID])
        if not text:
            return end
        if any(s in text for s in SEPARATORS):
            return self.whole(text) + end
        return b"".join(map(self.__getitem__, text.split())) + end


def wide(ids: bytes, kind: str) -> bytes:
    """The ids as unsigned 32-bit integers."""
    return np.frombuffer(ids, dtype=kind).astype("<u4").tobytes()


@lru_cache(maxsize=2)
def memo(path: str) -> WordMemo:
    return WordMemo(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)

