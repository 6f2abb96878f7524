"""Operator 7, benchmark decontamination: pigeonhole edit matching.

Texts and test items are lower-cased and their white space collapsed.  An item of L characters
has a budget of floor(rate * L) edits and is split into one piece more than that: whatever
passage is within the budget holds one piece unchanged.  A numpy scan over the UTF-8 bytes of whole texts looks up
each 8-byte window among the pieces' first eight bytes, exact hits open a window of the item's
length plus the budget on either side, and Myers' bit-parallel algorithm gives the least edit
distance of the item to any passage in it.

Items come in blocks of at most ``block_chars`` characters, a pass for each block, so what is
shared with the executors has a bound whatever the benchmark's size.

Null and empty texts have no hits, and null or blank items are never hit; items equal in text are hit alike.
Of several passages the one with the least distance counts, then the first.  Repeated document
rows give repeated results.  Further columns are ignored.  An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from haplospark.llm import _common

SCHEMA = "doc_id bigint, item_id bigint, distance int, start_char bigint, end_char bigint"
_TABLE_BITS = 20


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def origins(text: str) -> list[int]:
    """For each character of normalised(text) the place in *text* that it comes from, and the end last."""
    if len(text) == len(text.lower()) == len(normalised(text)):
        return [*range(len(text) + 1)]
    at, pending, found = [], None, False
    for i, c in enumerate(text):
        if c.isspace():
            pending = i if pending is None else pending
            continue
        if found and pending is not None:
            at.append(pending)
        pending, found = None, True
        at += [i] * len(c.lower())
    return [*at, len(text)]


class Myers:
    """Edit distance of one pattern to passages of texts, a column of the matrix in one integer."""

    def __init__(self, pattern: str):
        self.length, self.full = len(pattern), (1 << len(pattern)) - 1
        self.equal: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.equal[c] = self.equal.get(c, 0) | 1 << i

    def last_row(self, text, anchored: bool) -> Iterator[int]:
        """After each character of *text*: the distance to the best passage that ends there; anchored: that also starts at 0."""
        up, down, score, top = self.full, 0, self.length, 1 << self.length - 1
        for c in text:
            eq = self.equal.get(c, 0)
            zero = ((eq & up) + up ^ up) | eq | down
            plus, minus = down | ~(zero | up), up & zero
            score += bool(plus & top) - bool(minus & top)
            plus, minus = plus << 1 | anchored, minus << 1
            up, down = (minus | ~(zero | plus)) & self.full, plus & zero & self.full
            yield score


class Items:
    """A block of test items, ready for scans."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items, self.pieces, short = [], {}, []
        for item_id, text in items:
            if not (norm := normalised(text or "")):
                continue
            budget, k = int(rate * len(norm)), len(self.items)
            self.items.append((item_id, norm, budget, Myers(norm), Myers(norm[::-1])))
            bounds = [i * len(norm) // (budget + 1) for i in range(budget + 2)]
            for a, b in zip(bounds, bounds[1:]):
                if len(piece := norm[a:b].encode()) < 8:
                    short.append((piece, k, a))
                else:
                    self.pieces.setdefault(int.from_bytes(piece[:8], "little"), []).append((piece, k, a))
        self.short = short
        self.keys = np.array(sorted(self.pieces), np.uint64)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[_slot(self.keys)] = True

    def hits(self, norms: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """text's index, item's index, and the range of the text where a passage would lie, from exact pieces."""
        coded = [n.encode() for n in norms]
        data = b"\n".join(coded) + bytes(8)
        starts = np.cumsum([0, *(len(c) + 1 for c in coded)])[:-1]
        windows = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        at = np.flatnonzero(self.table[_slot(windows)]) if len(self.keys) else np.zeros(0, np.int64)
        values = windows[at]
        place = np.minimum(np.searchsorted(self.keys, values), max(len(self.keys) - 1, 0))
        at = at[self.keys[place] == values] if len(at) else at
        found = [(int(p), piece, k, a) for p in at.tolist() for piece, k, a in self.pieces[int(windows[p])] if data.startswith(piece, p)]
        for piece, k, a in self.short:
            p = data.find(piece)
            while p >= 0:
                found.append((p, piece, k, a))
                p = data.find(piece, p + 1)
        for p, _, k, a in found:
            t = int(np.searchsorted(starts, p, "right")) - 1
            char = p - int(starts[t]) if norms[t].isascii() else len(coded[t][: p - int(starts[t])].decode("utf-8", "ignore"))
            length, budget = len(self.items[k][1]), self.items[k][2]
            yield t, k, max(0, char - a - budget), min(len(norms[t]), char - a + length + budget)

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """text's index, item_id, distance, and the passage's range in the text itself: the best one of each item."""
        norms = [normalised(t or "") for t in texts]
        ranges: dict[tuple[int, int], list[list[int]]] = {}
        for t, k, lo, hi in sorted(set(self.hits(norms))):
            own = ranges.setdefault((t, k), [])
            if own and lo <= own[-1][1]:
                own[-1][1] = max(own[-1][1], hi)
            else:
                own.append([lo, hi])
        maps: dict[int, list[int]] = {}
        for (t, k), own in ranges.items():
            item_id, norm, budget, forward, backward = self.items[k]
            best: tuple[int, int] | None = None
            for lo, hi in own:
                for end, d in enumerate(forward.last_row(norms[t][lo:hi], False), lo + 1):
                    if d <= budget and (best is None or d < best[0]):
                        best = d, end
            if best is not None:
                d, end = best
                back = norms[t][max(0, end - len(norm) - budget) : end][::-1]
                start = end - next((n for n, x in enumerate(backward.last_row(back, True), 1) if x == d), len(norm))
                if t not in maps:
                    maps[t] = origins(texts[t])
                at = maps[t]
                yield t, item_id, d, at[start], at[end - 1] + 1


def _slot(values: np.ndarray) -> np.ndarray:
    return (values * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _TABLE_BITS)).astype(np.int32)


def blocks(benchmark: DataFrame, rate: float, block_chars: int) -> Iterator[Items]:
    """The items in blocks of bounded size; they reach the driver one partition at a time."""
    held, size = [], 0
    for r in benchmark.selectExpr("cast(item_id as bigint) item_id", "text").where("text is not null").toLocalIterator():
        held.append((r.item_id, r.text))
        size += len(r.text)
        if size >= block_chars:
            yield Items(held, rate)
            held, size = [], 0
    if held:
        yield Items(held, rate)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, block_chars: int = 4 << 20, column: str = "text") -> DataFrame:
    """A row for each document and item of which it holds a passage within the budget of edits."""
    source = _common.bounded(docs).selectExpr("cast(doc_id as bigint) doc_id", f"`{column}` as text")

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in _common.pieces(batches, 4096, 2 << 20):
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[t], *rest) for t, *rest in items.matches(batch.column("text").to_pylist())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], [x.split()[0] for x in SCHEMA.split(", ")])

        return source.mapInArrow(run, SCHEMA)

    found = [scan(docs.sparkSession.sparkContext.broadcast(b)) for b in blocks(benchmark, rate, block_chars)]
    return reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], SCHEMA)


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, block_chars: int = 4 << 20) -> DataFrame:
    """The rows that hold no passage of the benchmark; columns as they are."""
    out = _common.bounded(docs)
    for b in blocks(benchmark, rate, block_chars):

        def keep(batches: Iterator[pa.RecordBatch], shared=docs.sparkSession.sparkContext.broadcast(b)) -> Iterator[pa.RecordBatch]:
            for batch in _common.pieces(batches, 4096, 2 << 20):
                good = np.ones(batch.num_rows, bool)
                good[[t for t, *_ in shared.value.matches(batch.column("text").to_pylist())]] = False
                yield batch.filter(pa.array(good))

        out = out.mapInArrow(keep, docs.schema)
    return out
