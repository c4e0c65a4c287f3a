"""Token ids of whole texts by a public tokenizer file, through a bounded cache of encoded words."""

from __future__ import annotations

import os
import struct
import sys

#: Marks that never join with a letter before them into one token of the pre-tokenizer.
_TRAILING = ".,;:!?%&$*#)\"-"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet for the letters of Latin-1: visible bytes stand for themselves, the others, in order, for code points from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    of = {b: chr(b) if b in shown else chr(next(hidden)) for b in range(256)}
    return {c: "".join(of[b] for b in chr(c).encode()) for c in range(128, 256) if chr(c).isalpha()}


class WordCache(dict):
    """Word -> its ids as little-endian unsigned 32-bit integers.

    The pre-tokenizer of the file drops white space and never joins across it, so a text's ids are those of its
    space-separated parts in order. A part of Latin-1 letters is one token of the pre-tokenizer, so the tokenizer's model takes
    it as it is. There are at most two generations of `limit` entries: full, the younger becomes the older, from which
    words in use come back. Parts over `longest` characters are not kept.
    """

    def __init__(self, path: str, limit: int = 300_000, longest: int = 48):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.limit, self.longest = Tokenizer.from_file(path), limit, longest
        self.model, self.letters, self.older = self.tokenizer.model, _byte_letters(), {}
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self[""] = b""

    def _ids(self, word: str) -> bytes:
        if word.isalpha() and max(word) < "\u0100":
            low = word.lower()
            if low != word:
                return self[low]
            found = [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.letters))]
            return struct.pack(f"<{len(found)}I", *found)
        head = word.rstrip(_TRAILING)
        if head and len(head) < len(word) and head[-1].isalpha() and ord(head[-1]) < 256:
            return self[head] + self[word[len(head):]]
        found = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._ids(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def cached(path: str) -> WordCache:
    """The worker process's cache, kept over tasks."""
    kept = sys.modules[__name__].__dict__.setdefault("_kept", {})
    if path not in kept:
        kept[path] = WordCache(path)
    return kept[path]
