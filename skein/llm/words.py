"""Token ids of whole texts as packed bytes, equal to the tokenizers library's own.

The word-end vocabulary drops white space and never merges over a word's end,
so the ids of a text are those of its words in order. A worker keeps the ids
of words it has seen and has the library encode a batch's new words together.
Special tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

#: Words that a worker keeps; beyond that it starts anew.
MOST = 1_000_000


def _letters(kind: str) -> str:
    """The lower cases of the characters below U+0250 that are of a general category."""
    return "".join(sorted({c.lower() for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == kind and c != "\u0130"}))


#: Characters whose case and composition need more than a look at the one character.
OTHER = re.compile("[^\x00-\u012f\u0131-\u024f]")
#: The vocabulary's own pattern for lower-case text of other characters (fixed value, classes written out).
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_letters('L')}]+|[{_letters('N')}]|[^ \\t-\\r\x85\xa0{_letters('L')}{_letters('N')}]+")


class WordEndIds:
    """``encode(texts)``: the little-endian ids of each text, ``dtype`` wide."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        # \x1c-\x1f aren't white space to the vocabulary, so this isn't str.split()
        self.chunks = re.compile(r"[^ \t-\r]+").findall
        self.seen: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        # words in lower case where that is safe, so that few are new; else what stands between white space
        cut = [self.chunks(t) if OTHER.search(t) else WORD.findall(t.lower()) for t in texts]
        if len(self.seen) > MOST:
            self.seen.clear()
        new = list(set().union(*cut).difference(self.seen))
        if new:
            got = self.library.encode(new, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(got.ids, self.dtype).tobytes()
            at = (np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(new) + 1)) * self.dtype.itemsize).tolist()
            self.seen.update(zip(new, map(ids.__getitem__, map(slice, at, at[1:])), strict=True))
        get = self.seen.__getitem__
        return [b"".join(map(get, c)) for c in cut]


class ByteLevelIds:
    """The same for a byte-level vocabulary given as ranks, with the pattern that cuts a text."""

    def __init__(self, path: str, pattern: str) -> None:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(self.library.encode_ordinary(t), self.dtype).tobytes() for t in texts]


@lru_cache(2)
def word_end_ids(path: str) -> WordEndIds:
    return WordEndIds(path)


@lru_cache(2)
def byte_level_ids(path: str, pattern: str) -> ByteLevelIds:
    return ByteLevelIds(path, pattern)
