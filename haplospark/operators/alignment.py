"""Alignment kernels: reads to paths without gaps, paths to the reference with gaps, new CIGARs, and distances in batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISMATCH, UNKNOWN, OPEN, EXTEND = 3, 1, 5, 3
#: Penalty of a read's (row) against a path's letter, both reduced: 0 A, 1 C or G, 2 T, 3 N. N in a path fits anything.
PENALTY = np.array([[0, 3, 3, 0], [3, 0, 3, 0], [3, 3, 0, 0], [1, 1, 1, 0]])
_CODES = np.full(256, 3, np.uint8)
_CODES[list(b"ACGT")] = [0, 1, 1, 2]
_OPS = re.compile(r"(\d+)([MIDNSHP=XB])")
QUERY, REFERENCE = set("MIS=X"), set("MDN=X")
#: Cells of the matrices that are filled at once; three bits are kept of each.
CELLS = 1 << 25


def codes(text: str) -> np.ndarray:
    """A converted text in the reduced alphabet."""
    return _CODES[np.frombuffer(text.encode(), np.uint8)]


@lru_cache(1 << 16)
def operations(cigar: str) -> tuple[tuple[int, str], ...]:
    return tuple((int(n), op) for n, op in _OPS.findall(cigar))


def ungapped(path: np.ndarray, reads: list[np.ndarray], k: int, likely: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Penalty and offset of the best place of each read in a path, k letters from either end at least; penalty -1 if it doesn't fit.

    The likely offset wins ties, then the lowest.  Only where no penalty is below 3 (len / 4) does the likely offset, if
    it is outside the range, lose its place.  All reads meet all offsets in one product: a read is a row of
    what each letter would cost at each of its places, an offset a column of the letters that stand there.
    """
    size = np.array([len(r) for r in reads], np.int64)
    most, n = int(size.max(initial=0)), len(path)
    costs = np.zeros((len(reads), most, 4), np.float32)
    for i, r in enumerate(reads):
        costs[i, : len(r)] = PENALTY[r]
    letters = np.zeros((n + most, 4), np.float32)
    letters[np.arange(n), path] = 1
    places = np.lib.stride_tricks.sliding_window_view(letters, most, 0)[: n + 1].transpose(0, 2, 1).reshape(n + 1, -1) if most else np.zeros((n + 1, 0), np.float32)
    scores = (costs.reshape(len(reads), 4 * most) @ places.T).astype(np.int64)
    at, rows = np.arange(n + 1)[None], np.arange(len(reads))
    never = 4 * (most + 1)
    inside = np.where((at >= k) & (at <= (n - size - k)[:, None]), scores, never)
    offset = inside.argmin(1)
    best = inside[rows, offset]
    likely = np.array(likely, np.int64)
    fits = (likely >= 0) & (likely <= n - size)
    first = np.where(fits, scores[rows, np.where(fits, likely, 0)], never)
    ahead = (first < MISMATCH * (size >> 2)) & (first <= best)
    best, offset = np.where(ahead, first, best), np.where(ahead, likely, offset)
    return np.where(best < never, best, -1), offset


def gapped(paths: list[np.ndarray], references: list[np.ndarray], k: int) -> list[str]:
    """The CIGARs of paths on their references, of which both ends are alike: gaps are as far left as they can be.

    The first letter of a gap costs 8, a further one 3, where a gap goes on if the move into the cell beside is one
    of the best ways there.  From the end, the last move goes on while it may; else a match is taken before an insertion before a
    deletion.
    """
    out: list[str | None] = [f"{len(p)}M" if len(p) == len(r) and (p == r).all() else None for p, r in zip(paths, references)]
    rest = sorted((i for i, x in enumerate(out) if x is None), key=lambda i: len(paths[i]))
    while rest:
        cells = (len(paths[rest[-1]]) + 2) * (max(len(references[i]) for i in rest) + 2)
        part, rest = rest[-max(1, CELLS // cells) :], rest[: -max(1, CELLS // cells)]
        for i, steps in zip(part, _aligned([paths[i][k - 1 : len(paths[i]) - k + 1] for i in part], [references[i][k - 1 : len(references[i]) - k + 1] for i in part])):
            # The middle begins one letter before the k that both share, so that is a match of k - 1 more on either side.
            out[i] = packed("M" * (k - 1) + steps + "M" * (k - 1))
    return out


def _aligned(paths: list[np.ndarray], references: list[np.ndarray]) -> list[str]:
    """Moves (M, I, D) of each path on its reference. Cells of one anti-diagonal of all pairs depend on the two before it only, so they are filled at once."""
    n = len(paths)
    rows, columns = np.array([len(p) for p in paths]), np.array([len(r) for r in references])
    high, wide = int(rows.max()), int(columns.max())
    own, other = np.full((n, high), 3, np.uint8), np.full((n, wide), 3, np.uint8)
    for i, (p, r) in enumerate(zip(paths, references)):
        own[i, : len(p)], other[i, : len(r)] = p, r
    score = [np.zeros((n, high + 1), np.int32) for _ in range(3)]
    # For the last diagonal whether a gap is among the best ways into a row's cell, and for all diagonals the masks of the three moves.
    inserted, deleted = np.zeros((n, high + 1), bool), np.zeros((n, high + 1), bool)
    kept: list[tuple[int, tuple]] = [(0, ())]
    for d in range(1, high + wide + 1):
        now, before, two = score[d % 3], score[(d - 1) % 3], score[(d - 2) % 3]
        low, top = max(1, d - wide), min(high, d - 1)
        i = np.arange(low, top + 1)
        into_match = two[:, i - 1] - PENALTY[own[:, i - 1], other[:, d - i - 1]]
        into_insertion = before[:, i - 1] - EXTEND - OPEN * ~inserted[:, i - 1]
        into_deletion = before[:, i] - EXTEND - OPEN * ~deleted[:, i]
        best = np.maximum(into_match, np.maximum(into_insertion, into_deletion))
        masks = into_match == best, into_insertion == best, into_deletion == best
        kept.append((low, tuple(np.packbits(m, 1) for m in masks)))
        now[:, i], inserted[:, i], deleted[:, i] = best, masks[1], masks[2]
        if d <= wide:  # the upper rim: a gap in the path
            now[:, 0], deleted[:, 0], inserted[:, 0] = -OPEN - EXTEND * d, True, False
        if d <= high:  # the left rim: a gap in the reference
            now[:, d], inserted[:, d], deleted[:, d] = -OPEN - EXTEND * d, True, False
    letters, moves = "MID", ((1, 1), (1, 0), (0, 1))
    out = []
    for pair in range(n):
        i, j, steps, last = int(rows[pair]), int(columns[pair]), [], 0
        while i and j:
            low, masks = kept[i + j]
            byte, bit = divmod(i - low, 8)
            open_ways = [bool(m[pair, byte] << bit & 128) for m in masks]
            last = last if open_ways[last] else open_ways.index(True)
            steps.append(letters[last])
            i, j = i - moves[last][0], j - moves[last][1]
        out.append("D" * j + "I" * i + "".join(reversed(steps)))
    return out


def spread(cigar: str) -> str:
    """One letter for each base or gap of a CIGAR."""
    return "".join(op * n for n, op in operations(cigar))


def packed(ops: str) -> str:
    return "".join(f"{len(m[0])}{m[1]}" for m in re.finditer(r"(.)\1*", ops))


def positions(pos: int, cigar: str) -> list[int]:
    """The reference position of each base; inserted and clipped bases have the next one."""
    at, out = pos, []
    for n, op in operations(cigar):
        if op in "M=X":
            out += range(at, at + n)
        elif op in "IS":
            out += [at] * n
        at += n if op in REFERENCE else -n if op == "B" else 0
    return out


def bounds(pos: int, cigar: str, n_bases: int, lo: int, hi: int) -> tuple[int, int, int, int] | None:
    """First and last of a read's bases at a position from lo to before hi, and their positions."""
    at, base, found = pos, 0, None
    for n, op in operations(cigar):
        if op in "M=X":
            first, last = max(at, lo), min(at + n, hi) - 1
            span = (base + first - at, base + last - at, first, last) if first <= last else None
        else:
            span = (base, base + n - 1, at, at) if op in "IS" and n and lo <= at < hi else None
        if span and span[0] < n_bases:
            if span[1] >= n_bases:  # the CIGAR has more bases than the read
                cut = span[1] - n_bases + 1
                span = span[0], n_bases - 1, span[2], span[3] - cut if op in "M=X" else at
            found = (*(found or span)[:1], span[1], (found or span)[2], span[3])
        base += n if op in QUERY else 0
        at += n if op in REFERENCE else -n if op == "B" else 0
    return found


def rewritten(pos: int, cigar: str, first: int, last: int, path_cigar: str, path_first: int, path_last: int, ref_start: int) -> tuple[int, str]:
    """Position and CIGAR of a read whose bases first to last lie on a path's letters path_first to path_last.

    Bases before *first* and after *last* keep their operations.  Without bases before, the read starts where the path's letter
    does, after a deletion that ends there.
    """
    own, of_path = spread(cigar), spread(path_cigar)

    def cut(ops: str, bases: int) -> int:
        """The place in ops just after so many bases."""
        at = 0
        while bases:
            bases -= ops[at] in QUERY
            at += 1
        return at

    begin, end = cut(of_path, path_first), cut(of_path, path_last + 1)
    middle = of_path[begin:end]
    head = own[: cut(own, first)] if first else re.match("H*", own)[0]
    if not first:
        skipped = re.match("D*", middle)[0]
        pos = ref_start + sum(op in REFERENCE for op in of_path[:begin]) + len(skipped)
        middle = middle[len(skipped) :]
    tail = own[cut(own, last + 1) :]
    if not any(op in QUERY for op in tail):
        tail = re.sub("[^H]", "", tail)
    return pos, packed(head + middle + tail)


def distance(pos: int, cigar: str, seq: str, reference: str, ref_start: int) -> tuple[int, int]:
    """Mismatches of a read with the unconverted reference from ref_start on, and how many bases it covers."""
    wrong, covered = distances([pos], [cigar], [seq], [reference], [ref_start])
    return int(wrong[0]), int(covered[0])


_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32


def distances(pos: list[int], cigars: list[str], seqs: list[str], references: list[str], ref_starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The same for many reads: all stretches of matched bases are laid side by side and compared at once. Bases without a partner differ."""
    own, there, lengths, rows = [], [], [], []
    base_at = ref_end = 0
    texts: dict[int, tuple[int, str]] = {}  # a reference that many reads share is laid down once
    for row, (p, cigar, seq, ref, start) in enumerate(zip(pos, cigars, seqs, references, ref_starts)):
        if id(ref) not in texts:
            texts[id(ref)], ref_end = (ref_end, ref), ref_end + len(ref)
        base, at, ref_at = 0, p - start, texts[id(ref)][0]
        for n, op in operations(cigar):
            if op in "M=X" and n:
                skip = min(max(0, -at), n)
                both = max(0, min(n - skip, len(seq) - base - skip, len(ref) - at - skip))
                rows.append(row), lengths.append((n, both))
                own.append(base_at + base + skip), there.append(ref_at + at + skip)
            base += n if op in QUERY else 0
            at += n if op in REFERENCE else -n if op == "B" else 0
        base_at += len(seq)
    if not rows:
        return np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    rows, (n, both) = np.array(rows), np.array(lengths).T
    before = np.cumsum(both) - both
    steps = np.arange(int(both.sum()))
    flat = lambda starts: np.repeat(np.array(starts) - before, both) + steps
    letters, bases = (_UPPER[np.frombuffer("".join(x).encode("latin-1", "replace"), np.uint8)] for x in (seqs, [t for _, t in texts.values()]))
    same = np.bincount(np.repeat(rows, both), letters[flat(own)] == bases[flat(there)], len(pos)).astype(np.int64)
    covered = np.bincount(rows, n, len(pos)).astype(np.int64)
    return covered - same, covered


def with_distance(rows: DataFrame, pos: str, cigar: str, seq: str, reference: str, ref_start: str, names: tuple[str, str]) -> DataFrame:
    """rows with two more columns: mismatches with the reference that starts at ref_start, and covered bases. Null where an input is null."""
    inputs = (pos, cigar, seq, reference, ref_start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.num_columns - len(inputs) + i).to_pylist() for i in range(len(inputs))]
            whole = [i for i, r in enumerate(zip(*columns)) if None not in r]
            out = np.zeros((2, batch.num_rows), np.int64)
            out[:, whole] = distances(*([c[i] for i in whole] for c in columns))
            missing = np.ones(batch.num_rows, bool)
            missing[whole] = False
            yield pa.RecordBatch.from_arrays([*batch.columns[: -len(inputs)], *(pa.array(x.astype(np.int32), mask=missing) for x in out)], [*batch.schema.names[: -len(inputs)], *names])

    schema = T.StructType([*rows.schema.fields, *(T.StructField(x, T.IntegerType()) for x in names)])
    return rows.select(*rows.columns, *(F.col(c).alias(f"_in{i}") for i, c in enumerate(inputs))).mapInArrow(run, schema)
