"""Whole-text token ids from a ``tokenizers`` file, each distinct word encoded once per worker.

The library spends most of its time on words that it has met before.  Both supported kinds of
pre-tokenizer cut at positions that plain string splitting finds too, so a text's ids are the joined
ids of its chunks:

* byte-level (``add_prefix_space=False``): a token ends before a single space, or before and after a
  single line feed, that stands between two characters that aren't white space;
* word kind (white space removed): at every space and line feed.

Marks after letters (``word,`` or ``word$$$``) are pre-tokens of their own in both kinds.

Everything else (added tokens, runs of white space next to a space, long chunks) goes to the library
as it is.  Ids are carried as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import array
import re
import struct
import sys
from functools import lru_cache

#: Chunks kept by a worker, and the longest chunk kept, in characters.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 64

_SAFE = re.compile(r"(?<=\S)(?= \S)")
_LINES = re.compile(r"\S+(?:\n\S+)+")


#: Marks that part from the letters before them (the apostrophe and the underscore don't in every kind).
_MARKS = ".,;:!?$%&*#@+=~^|/"

#: Below it every letter is its own composed form.
_LATIN_END = "\u0250"

#: The byte-level alphabet: bytes that print stand for themselves, the others, in order, for U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PRINTED)}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Unsafe(Exception):
    pass


class _Ids(dict):
    """Chunk (without the prefix) -> ids of prefix + chunk."""

    def __init__(self, owner: ChunkEncoder, prefix: str):
        self.owner, self.prefix = owner, prefix
        self.byte_level, self.tokenize = owner.byte_level, owner.model.tokenize
        self.space = _BYTE_LEVEL[32] if prefix else ""

    def __missing__(self, chunk: str) -> bytes:
        owner = self.owner
        # most words that weren't met before: one pre-token of letters, straight to the model
        if chunk.isascii() and chunk.isalpha() and len(chunk) <= CACHE_CHARS:
            tokens = self.tokenize(self.space + chunk if self.byte_level else chunk.lower())
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            ids = self[chunk] = _packed([x.id for x in tokens])
            return ids
        if owner.byte_level:
            if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                raise _Unsafe
            if "\n" in chunk and _LINES.fullmatch(chunk):
                first, *rest = chunk.split("\n")
                return self[first] + b"".join([owner.newline + owner.plain[x] for x in rest])
        elif not chunk:
            return b""
        if chunk[-1] in _MARKS and (word := chunk.rstrip(_MARKS)).isalpha() and chunk.isprintable() and word.lower().isalpha():
            marks = chunk[len(word) :]
            ids = self[word] + (owner.plain[marks] if len(marks) <= CACHE_CHARS else owner.ids(marks))
        elif chunk.isalpha() and max(chunk) < _LATIN_END:
            ids = owner.word(self.prefix, chunk)
        else:
            ids = owner.ids(self.prefix + chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = ids
        return ids


class ChunkEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        # a byte-level pre-tokenizer with its own pattern prints as ByteLevel(...)
        self.byte_level = str(self.tokenizer.pre_tokenizer).startswith("ByteLevel")
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain, self.spaced = _Ids(self, ""), _Ids(self, " ")
        self.newline = self.ids("\n") if self.byte_level else b""

    def ids(self, text: str) -> bytes:
        """The library's ids for ``text``."""
        out = array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def word(self, prefix: str, letters: str) -> bytes:
        """``ids(prefix + letters)`` for composed Latin letters: one pre-token, so straight to the model."""
        if not self.byte_level:
            letters = letters.lower()
            if not letters.isalpha():
                return self.ids(letters)
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(_BYTE_LEVEL)
        if prefix:
            letters = _BYTE_LEVEL[32] + letters
        return _packed([x.id for x in self.model.tokenize(letters)])

    def encode(self, text: str) -> bytes:
        """Ids of the whole text, as ``ids(text)`` gives them."""
        if not text:
            return b""
        if "<" in text and any(t in text.lower() for t in self.added):
            return self.ids(text)
        if not self.byte_level:
            return b"".join(map(self.plain.__getitem__, text.replace("\n", " ").split(" ")))
        first, *rest = text.split(" ")
        try:
            return self.plain[first] + b"".join(map(self.spaced.__getitem__, rest))
        except _Unsafe:
            chunks = _SAFE.split(text)
            out = []
            for c in chunks:
                try:
                    out.append(self.spaced[c[1:]] if c[0] == " " else self.plain[c])
                except _Unsafe:
                    out.append(self.ids(c))
            return b"".join(out)


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    """One per Python worker and file."""
    return ChunkEncoder(path)
