"""Operator 9, SentencePiece encoding and decoding: sampled segmentations that decode without loss.

A text becomes units: a run of spaces (one is put before the text, as the model does) and what
follows up to the next space.  No piece of the model continues past a non-space into a space, so
units segment independently.  The lattice of a unit has an edge for each piece of the
vocabulary found in it, and byte pieces for characters that no piece covers.  An edge weighs
-sharpness * ln(1 + rank).  Forward filtering sums the weights of all paths to each place, in logs,
for the distinct units of a batch at once; backward sampling then draws an edge into each place,
from the end, with the share it has in that sum.  The draws come from a counter-based generator
keyed by seed, row key, unit and step, and shares are integers of 24 bits, so a row's
segmentation depends on nothing but its key, its text and the parameters: weights are summed as
whole numbers, so that what else is in a batch has no part in any rounding.

Decoding joins the pieces' bytes, turns the model's space mark into a space and drops the first
one; that mark as a character of a text is written as bytes, so every text comes back.  Within units the mark as a
character is a lone surrogate, which no text in UTF-8 can hold.

Null texts have null pieces, empty texts none.  Equal keys with equal texts give equal pieces.
Further columns are ignored by ``encode`` and kept by ``with_pieces``; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from haplospark.llm import _common

MARK = "▁"
SHARE_BITS = 24
#: Bits of an edge's weight beside the heaviest one into its node.
PART_BITS = 30
SCHEMA = "doc_id bigint, n_pieces bigint, ids_crc32 bigint, lossless boolean, pieces array<int>"
_MODELS: dict[tuple, "Lattice"] = {}
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class _Places:
    """Places of 64-bit hashes in a sorted array: their leading bits say where to begin."""

    BITS = 17

    def __init__(self, known: np.ndarray):
        self.known = np.append(known, np.uint64((1 << 64) - 1))
        slots = np.arange(1 << self.BITS, dtype=np.uint64) << np.uint64(64 - self.BITS)
        self.begin = np.searchsorted(known, slots).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hash the place of the first one that isn't below it, and whether that is the same."""
        place = self.begin[(h >> np.uint64(64 - self.BITS)).astype(np.int32)]
        there = self.known[place]
        below = np.flatnonzero(there < h)
        while len(below):
            place[below] += 1
            there[below] = self.known[place[below]]
            below = below[there[below] < h[below]]
        # The greatest hash of all stands for the end of the array; a piece of that hash would not be found.
        return place, (there == h) & (place < len(self.known) - 1)


class Lattice:
    def __init__(self, path: str, sharpness: float):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_ids, self.weights = np.zeros(256, np.int64), np.zeros(n)
        pieces: dict[str, int] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
                self.byte_ids[self.bytes_of[i][0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if MARK in piece.lstrip(MARK):
                    raise ValueError("a piece goes on past the end of a unit")
                pieces[piece] = i
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
                self.weights[i] = -sharpness * np.log1p(-model.get_score(i))
        self.byte_weight = -sharpness * np.log1p(n)
        self.single = {p for p in pieces if len(p) == 1}
        # For each length the hashes of the pieces' prefixes, sorted, and the piece that each is, or -1.
        self.prefixes: list[tuple[_Places, np.ndarray]] = []
        for length in range(1, max(map(len, pieces)) + 1):
            found = {p[:length]: pieces.get(p[:length], -1) for p in pieces if len(p) >= length}
            h = np.zeros(len(found), np.uint64)
            codes = np.frombuffer("".join(found).encode("utf-32-le"), "<u4").reshape(-1, length)
            for k in range(length):
                h = self._longer(h, codes[:, k])
            order = np.argsort(h)
            self.prefixes.append((_Places(h[order]), np.array([*found.values()])[order]))
        lengths = np.array([len(b) for b in self.bytes_of])
        self.flat, self.lengths, self.starts = np.frombuffer(b"".join(self.bytes_of), np.uint8), lengths, np.cumsum(lengths) - lengths

    @staticmethod
    def _longer(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        h = (h + codes + np.uint64(1)) * _GOLDEN
        return h ^ h >> np.uint64(32)

    def filtered(self, units: list[str], deepest: int = 1 << 22):
        """The units' lattices as arrays: last node of each unit, the first edge into each node, and for all edges, ordered by the
        node they end in, the cumulated share, the node they start from, and the place and number of their ids."""
        n = np.array([len(u) for u in units])
        own = np.repeat(np.arange(len(units)), n)
        before = np.cumsum(n) - n  # characters before the unit; its nodes begin at before + unit
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        left = before[own] + n[own] - np.arange(len(codes))
        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        edges: list[tuple[np.ndarray, np.ndarray, int]] = []
        for length, (known, ids) in enumerate(self.prefixes, 1):
            keep = left[at] >= length
            at, h = at[keep], h[keep]
            h = self._longer(h, codes[at + length - 1])
            place, keep = known.find(h)
            at, h, place = at[keep], h[keep], place[keep]
            whole = ids[place] >= 0
            edges.append((at[whole], ids[place[whole]], length))
        start = np.concatenate([a for a, _, _ in edges])
        piece = np.concatenate([i for _, i, _ in edges])
        end = start + np.repeat([k for _, _, k in edges], [len(a) for a, _, _ in edges])
        place, many, weight = piece.astype(np.int32), np.ones(len(piece), np.int32), self.weights[piece]
        # Characters without a piece of their own: an edge with their bytes' ids, which stand behind the vocabulary's.
        lone = np.ones(len(codes), bool)
        lone[edges[0][0]] = False
        del edges, at, h, piece
        extra = np.flatnonzero(lone)
        kinds, kind = np.unique(codes[extra], return_inverse=True)
        text = [chr(c).replace(_ESCAPED, MARK).encode("utf-8", "surrogatepass") for c in kinds.tolist()]
        each = np.array([len(t) for t in text], np.int64)
        sizes = each[kind]
        emitted = np.concatenate([np.arange(len(self.weights)), self.byte_ids[np.frombuffer(b"".join(text), np.uint8)]])
        start, end = np.concatenate([start, extra]), np.concatenate([end, extra + 1])
        place, many = np.concatenate([place, (len(self.weights) + np.cumsum(each) - each)[kind].astype(np.int32)]), np.concatenate([many, sizes.astype(np.int32)])
        weight = np.concatenate([weight, sizes * self.byte_weight])
        # From characters to nodes: a unit has one node more than characters.
        shift = own[start]
        depth = end - before[shift]
        # An edge is known by its end and its length, which is below 64; edges too deep for one number are sorted by three.
        order = np.argsort((depth << 40) + (end + shift << 6) + end - start) if depth.max(initial=0) < deepest and len(codes) < 1 << 33 else np.lexsort((end - start, end, depth))
        start, end = (start + shift)[order], (end + shift)[order]
        del shift
        # One after another, so that no more than one of them is there twice.
        depth = depth[order]
        place = place[order]
        many = many[order]
        weight = weight[order]
        del order
        total = np.zeros(len(codes) + len(units))
        share = np.empty(len(start), np.int64)
        steps = np.searchsorted(depth, np.arange(1, (depth[-1] if len(depth) else 0) + 2))
        for lo, hi in zip(steps, steps[1:]):
            value, node = total[start[lo:hi]] + weight[lo:hi], end[lo:hi]
            first = np.flatnonzero(np.diff(node, prepend=-1))
            size = np.diff(first, append=hi - lo)
            top = np.maximum.reduceat(value, first)
            # Whole numbers: their sums are exact, whatever stands before a node in the batch.
            part = np.round(np.exp(value - np.repeat(top, size)) * (1 << PART_BITS)).astype(np.int64)
            whole = np.add.reduceat(part, first)
            total[node[first]] = np.round(top + np.log(whole) - PART_BITS * np.log(2), 9)
            sums = np.cumsum(part)
            inside = sums - np.repeat(sums[first] - part[first], size)
            share[lo:hi] = np.round(inside / np.repeat(whole, size) * (1 << SHARE_BITS) / 16).astype(np.int64) * 16
            share[lo:hi][np.append(first[1:], hi - lo) - 1] = 1 << SHARE_BITS
        by_node = np.argsort((end << 6) - start + end)
        into = np.bincount(end, minlength=len(total) + 1)
        return np.cumsum(n + 1) - 1, np.cumsum(into) - into, share[by_node], start[by_node], place[by_node], many[by_node], emitted

    def encode(self, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text by text, and the number for each text."""
        split = [_units(t) for t in texts]
        words = [*chain.from_iterable(split)]
        counts = np.array([len(s) for s in split])
        units = {u: i for i, u in enumerate(dict.fromkeys(words))}
        if not units:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        last, begin, share, start, place, many, emitted = self.filtered([*units])
        unit = np.fromiter(map(units.__getitem__, words), np.int64, len(words))
        ordinal = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
        seed = _mix(np.repeat(seeds, counts) + ordinal.astype(np.uint64) * _GOLDEN)
        node, live, chosen = last[unit], np.arange(len(words)), []
        first = (np.append(0, last[:-1] + 1))[unit]
        step = 0
        while len(live):
            draw = _mix(seed[live] + np.uint64(step * int(_GOLDEN) & (1 << 64) - 1)) >> np.uint64(64 - SHARE_BITS)
            # The first edge into the node whose share is above the draw; the last one's is.
            draw, edge = draw.astype(np.int64), begin[node]
            under = np.flatnonzero(share[edge] <= draw)
            while len(under):
                edge[under] += 1
                under = under[share[edge[under]] <= draw[under]]
            chosen.append((live, edge))
            node = start[edge]
            going = node > first[live]
            live, node, step = live[going], node[going], step + 1
        steps = np.bincount(np.concatenate([a for a, _ in chosen]), minlength=len(words))
        ends = np.cumsum(steps)
        edges = np.empty(ends[-1], np.int64)
        for k, (at, edge) in enumerate(chosen):
            edges[ends[at] - 1 - k] = edge
        size = many[edges]
        ids = emitted[_common.ragged(place[edges], size)]
        in_text = np.repeat(np.repeat(np.arange(len(texts)), counts), steps)
        return ids, np.bincount(in_text, size, len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes that ids stand for, each text still with the space before it."""
        return self.flat[_common.ragged(self.starts[ids], self.lengths[ids])].tobytes()


#: Stands for the mark as a character of a text, within units only: a lone surrogate, so it is no character of any text.
_ESCAPED = "\ud800"


def _units(text: str) -> list[str]:
    """The units of a text; the first space of each unit is the one put there or the one that ended the last unit."""
    if not text:
        return []
    parts = text.replace(MARK, _ESCAPED).split(" ")
    if "" not in parts:
        return [MARK + p for p in parts]
    units, run = [], MARK
    for p in parts:
        if p:
            units.append(run + p)
            run = MARK
        else:
            run += MARK
    return units if run == MARK and parts[-1] else [*units, run[:-1]]


def lattice(path: str, sharpness: float) -> Lattice:
    if (path, sharpness) not in _MODELS:
        _MODELS[path, sharpness] = Lattice(path, sharpness)
    return _MODELS[path, sharpness]


def _sampler(path: str, seed: int, sharpness: float):
    def sample(keys: list, texts: list[str | None]):
        """ids of all texts, counts, and whether each text came back."""
        model = lattice(path, sharpness)
        plain = [t or "" for t in texts]
        seeds = _mix(np.array([hash_key(k) ^ seed & (1 << 64) - 1 for k in keys], np.uint64) + _GOLDEN)
        ids, counts = model.encode(plain, seeds)
        back, ends = model.decode(ids), np.cumsum(counts)
        want = [(" " + t).encode() if t else b"" for t in plain]
        if back == b"".join(want):
            return ids, counts, [True] * len(texts)
        return ids, counts, [model.decode(ids[e - n : e]) == w for e, n, w in zip(ends, counts, want)]

    return sample


def hash_key(key: int | None) -> int:
    return (key if key is not None else -1) & (1 << 64) - 1


def encode(docs: DataFrame, path: str, seed: int = 0, sharpness: float = 1.0, column: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian 32-bit ids), lossless, pieces of docs(doc_id, column)."""
    sample = _sampler(path, seed, sharpness)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.pieces(batches, 2048, 1 << 20):
            texts = batch.column("text").to_pylist()
            ids, counts, good = sample(batch.column("doc_id").to_pylist(), texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(_checksums(ids, counts)), pa.array(good), _lists(ids, counts, texts)], [x.split()[0] for x in SCHEMA.split(", ")])

    return _common.bounded(docs).selectExpr("cast(doc_id as bigint) doc_id", f"`{column}` as text").mapInArrow(run, SCHEMA)


def _checksums(ids: np.ndarray, counts: np.ndarray) -> list[int]:
    small, ends = ids.astype("<u4"), np.cumsum(counts)
    return [zlib.crc32(small[e - n : e].tobytes()) for e, n in zip(ends.tolist(), counts.tolist())]


def _lists(ids: np.ndarray, counts: np.ndarray, texts: list[str | None]) -> pa.Array:
    offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
    out = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
    return out if None not in texts else pa.array([None if t is None else x for t, x in zip(texts, out.to_pylist())], pa.list_(pa.int32()))


def with_pieces(docs: DataFrame, path: str, seed: int = 0, sharpness: float = 1.0) -> DataFrame:
    """All rows and columns, with the columns pieces (array<int>) and lossless at the end; underscores follow these names where docs has them."""
    sample = _sampler(path, seed, sharpness)
    docs = _common.bounded(docs)
    names = [_common.free_name(x, docs.columns) for x in ("pieces", "lossless")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.pieces(batches, 2048, 1 << 19):
            texts = batch.column("text").to_pylist()
            ids, counts, good = sample(batch.column("doc_id").to_pylist(), texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(ids, counts, texts), pa.array(good)], [*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.ArrayType(T.IntegerType())), T.StructField(names[1], T.BooleanType())])
    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, column: str = "pieces") -> DataFrame:
    """doc_id and text of encoded(doc_id, column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path, 1.0)
        for batch in batches:
            texts = [None if x is None else model.decode(np.array(x, np.int64))[1:].decode() for x in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as bigint) doc_id", f"`{column}` as pieces").mapInArrow(run, "doc_id bigint, text string")
