"""Word shingles of whole texts as 64-bit hashes, in numpy.

Words are the longest runs of bytes other than space and 0x09 to 0x0D, with A-Z in lower case.  A
word's hash is a polynomial over random bytes' values, a shingle's a sum of its words' hashes times
odd constants, either finished by a bijection; equal shingles have equal hashes, and two different
ones in a pair of sets meet with a chance below 2**-40 for sets of thousands.
"""

from __future__ import annotations

import numpy as np

SIZE = 5
_RANDOM = np.random.RandomState(5)
_VALUES = _RANDOM.randint(1 << 62, size=256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _RANDOM.randint(1 << 62, size=2 * SIZE).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(max(n, 1 << 20), base, np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors)
    return _powers


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of each text, text by text; and their number in each text."""
    coded = [(t or "").encode().lower() for t in texts]
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    sizes = np.array([len(c) + 1 for c in coded])
    inside = np.zeros(len(data) + 1, bool)
    inside[1:] = _IN_WORD[data]
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    forward, back = _grown(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * forward[: len(data)], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _STEPS[0])
    return words, np.bincount(np.searchsorted(np.cumsum(sizes), starts, "right"), minlength=len(texts))


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, text by text; and their number in each text."""
    words, n = word_hashes(texts)
    first = np.cumsum(n) - n
    many = np.where(n >= SIZE, n - SIZE + 1, 0)
    own = np.repeat(np.arange(len(texts)), many)
    at = np.arange(len(own)) + np.repeat(first - (np.cumsum(many) - many), many)
    total = np.zeros(len(own), np.uint64)
    for j in range(SIZE):
        total += words[at + j] * _STEPS[j]
    tokens = mix(total)
    few = np.flatnonzero((n > 0) & (n < SIZE))
    if len(few):
        whole = np.array([np.add.reduce(words[f : f + k] * _STEPS[:k]) for f, k in zip(first[few], n[few])], np.uint64) + _STEPS[SIZE + n[few]]
        place = np.cumsum(many)[few]
        tokens, many = np.insert(tokens, place, mix(whole)), many.copy()
        many[few] = 1
        own = np.repeat(np.arange(len(texts)), many)
    stop = np.cumsum(many)
    for a, b in zip((stop - many).tolist(), stop.tolist()):
        tokens[a:b].sort()
    keep = np.ones(len(tokens), bool)
    keep[1:] = (tokens[1:] != tokens[:-1]) | (own[1:] != own[:-1])
    return tokens[keep], np.bincount(own[keep], minlength=len(texts))


def set_hashes(tokens: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set."""
    out = []
    for k in (3, 7):
        h = np.zeros(len(n), np.uint64)
        full = np.flatnonzero(n)
        if len(full):
            h[full] = np.add.reduceat(mix(tokens * _STEPS[k] + _STEPS[k + 1]), (np.cumsum(n) - n)[full])
        out.append((h + n.astype(np.uint64)).view(np.int64))
    return out[0], out[1]
