"""Library tokenizers behind a bounded cache of units.

A unit ends where a non-white-space character is followed by a space.  No alternative of the
byte-level splitting pattern matches a non-white-space character and a white-space one after
it in one go, none looks behind, and what follows such a place is matched from there on in
either case; so the ids of a text are the ids of its units, one after another.  Special strings
hold no space, so they lie within one unit.  Each unit is encoded by the library itself once
and then looked up; texts whose spaces are not all of that kind go through a regular
expression that cuts only at proven places.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: Entries of one of the two generations of the cache: about 100 MB for each Python worker.
CACHE_UNITS = 500_000
_UNITS = re.compile(r"\s*\S+|\s+")
#: A word of Latin letters and then punctuation: the splitting pattern makes one unit of either.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!\"#$%&()*+,./:;=?@|_-]*)")
#: The first character beyond the letters that are looked at one by one, the letter that stands for a space, and marks that often follow a word.
_LATIN, _SPACE, _MARKS = "\u0250", "\u0120", frozenset(",.;:!?")
_BYTE_PATTERN = "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next of those from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_ENCODERS: dict[str, "UnitEncoder"] = {}


class _Cache(dict):
    """unit -> packed ids; two generations, the older one is dropped when the younger is full."""

    def __init__(self, encode):
        self.encode, self.old = encode, {}

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= CACHE_UNITS:
            self.old = dict(self)
            self.clear()
        if (got := self.old.get(unit)) is None:
            got = self.encode(unit)
        self[unit] = got
        return got


class UnitEncoder:
    """Ids of whole texts as the tokenizers library gives them for the file at *path*."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.first = _Cache(self._bare)
        self.model = self.library.model if self.library.normalizer is None and str(self.library.pre_tokenizer) == _BYTE_PATTERN else None
        #: Each id as it is stored.
        self.packs = [i.to_bytes(self.dtype.itemsize, "little") for i in range(max(self.library.get_vocab().values()) + 1)]
        letters = _byte_letters()
        # What stands for the bytes of a character below U+0250, as all are that _PLAIN takes.
        self.direct = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x250)}
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        # Keys are what follows a space; a unit that ends in white space isn't stable, so it has no ids here.
        self.spaced = _Cache(self._after_space)

    def _packed(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """The model's ids of one unit of the splitting pattern."""
        return b"".join([self.packs[t.id] for t in self.model.tokenize(word.translate(self.direct))])

    def _after_space(self, unit: str) -> bytes | None:
        # Letters are one unit of the splitting pattern with the space before them, and a mark behind them is one by itself.
        if self.model and unit:
            if (plain := unit.isascii()) or max(unit) < _LATIN:
                if unit.isalpha():
                    tokens = self.model.tokenize(_SPACE + (unit if plain else unit.translate(self.direct)))
                    return b"".join([self.packs[t.id] for t in tokens])
                if unit[-1] in _MARKS and unit[:-1].isalpha():
                    return self.spaced[unit[:-1]] + self.first[unit[-1]]
        if not unit or unit[-1].isspace():
            return None
        if self.model:
            if m := _PLAIN.fullmatch(unit):
                word, marks = m.groups()
                return self.spaced[word] + self.first[marks] if marks else self._word(" " + word)
            if "\n" in unit:
                head, *rest = _UNITS.findall(" " + unit)
                if rest:
                    return self.spaced[head[1:]] + b"".join(map(self.first.__getitem__, rest))
        return self._packed(" " + unit)

    def _bare(self, unit: str) -> bytes:
        if self.model and (m := _PLAIN.fullmatch(unit)):
            word, marks = m.groups()
            return self.first[word] + self.first[marks] if marks else self._word(word)
        if self.model and unit[0] == "\n" and len(unit) > 1 and not unit[1].isspace():
            return self.first["\n"] + self.first[unit[1:]]
        return self._packed(unit)

    def packed(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian integers of ``dtype``."""
        if self.model and "\n" in text:
            # A line's end between two characters that aren't white space is a unit by itself.
            lines = text.split("\n")
            if all(lines) and not any(x[0].isspace() or x[-1].isspace() for x in lines):
                return self.first["\n"].join(map(self._line, lines))
        return self._line(text)

    def _line(self, text: str) -> bytes:
        if not text:
            return b""
        head, *rest = text.split(" ")
        if head and not head[-1].isspace():
            try:
                return self.first[head] + b"".join(map(self.spaced.__getitem__, rest))
            except TypeError:  # a unit without ids: other white space next to a space
                pass
        return b"".join(map(self.first.__getitem__, _UNITS.findall(text)))

    def count(self, text: str) -> int:
        return len(self.packed(text)) // self.dtype.itemsize


def encoder(path: str) -> UnitEncoder:
    """One encoder for each Python worker and file; workers are reused by later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]
