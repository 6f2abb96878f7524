"""Operator 6, n-gram Jaccard join: adaptive multi-match prefixes over sets of word shingles.

Two sets link at a Jaccard similarity of 75 %.  If so, the l-prefixes of both (in any common order
of shingles, |x| - ceil(0.75 |x|) + l long) share l shingles at least, for every l.

1. Documents with equal sets form a class (128-bit hashes).  In blocks of documents, each distinct
   shingle goes once to its hash range, packed; there, shingles that occur once in all are counted
   back to their documents.  A document with more than |x| - ceil(0.75 |x|) of those links to no
   other set and is done.  A frequent shingle is a row for each block, not for each document.
2. The classes that are left (one document each) send their shingles the same way and get the
   exact document frequencies back.  Prefixes are taken in order of rising frequency, and each
   document lengthens its own: it takes the l of least estimated cost, posting rows plus
   the checks of candidates that share l of them.  A pair is a candidate if, at the lesser of both
   l, its prefixes share that many.
3. So that thousands of near copies don't make all their pairs, each document is first checked
   against the most central document that shares its least hashes; postings whose documents are in
   one component then drop out, and what is left is checked, the closest to each component first
   and then all pairs that still lie across components.
4. Components are joins and minima (see components).

Null and empty texts, and texts without words, have no shingles and link to nothing: their component
is their own id.  A text of fewer than five words has its whole sequence as its one shingle.
Repeated rows give a row each, and rows that share a doc_id are one document for the links.  A row
without doc_id has a component only through equal sets.  Further columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplospark.llm import _common
from haplospark.llm.components import components
from haplospark.llm.shingles import mix, set_hashes, shingle_sets

LEAST = 75  # per cent
MOST_MATCHES = 8
#: What the check of a candidate costs, in posting rows.
CHECK_COST = 50
STAR_SHINGLES = 8
#: Shingles of a hash range, and spare bits of their packed hashes: one in 2**12 meets another by chance, which costs work alone.
RANGE_SHINGLES = 1_500_000
LEAST_RANGE_BITS = 6
SPARE_BITS = 12
#: Bits of the filter of documents that are read again, for each of them, and the most documents that a filter (of 8 MB)
#: takes; what passes by chance costs work alone. More of them are looked up by a join.
FILTER_BITS, MOST_FILTERED = 16, 1 << 22
#: Documents and bytes of a block. Beyond MANY_RANGES hash ranges blocks grow with their number, up to LARGEST_BLOCK times.
BLOCK_DOCS, BLOCK_BYTES = 7500, 4 << 20
MANY_RANGES, LARGEST_BLOCK = 1024, 8
MANY = 0xFFFF
#: Parts of a hot posting's rows, or of a hot document's pairs.
SALTS = 32

_PACKED = "bucket int, block bigint, width int, tokens binary, idx binary"
_KEYS = "ids array<bigint>, cls array<int>, n array<int>, h1 array<bigint>, h2 array<bigint>"
_BLOCKS = "block bigint, ids array<bigint>, n array<int>, tokens binary"
_PREFIX = "token bigint, cid bigint, n int, central int, level int, matches int, place int"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def allowed(n: np.ndarray) -> np.ndarray:
    """How many shingles of a set of n may be missing from a set that it links to."""
    return n - -(-LEAST * n // 100)


def _sorted(values: np.ndarray, marks: np.ndarray, value_bits: int, mark_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """values and their marks in order of both; where they fit 64 bits together, numbers are sorted in place of places."""
    if value_bits + mark_bits <= 64:
        both = values << np.uint64(mark_bits) | marks.astype(np.uint64)
        both.sort()
        return both >> np.uint64(mark_bits), both & np.uint64((1 << mark_bits) - 1)
    order = np.lexsort((marks, values))
    return values[order], marks[order]


def _packed(tokens: np.ndarray, idx: np.ndarray, range_bits: int, bits: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Range, width, tokens and documents of the distinct shingles of a block: 8 bytes of the first, differences of the others."""
    short, idx = _sorted(tokens >> np.uint64(64 - bits), idx, bits, 16)
    first = np.flatnonzero(np.append(True, short[1:] != short[:-1])) if len(short) else np.zeros(0, np.int64)
    idx = np.where(np.diff(first, append=len(short)) > 1, MANY, idx[first]).astype("<u2")
    short = short[first]
    if not len(short):
        return
    # Only ranges that the block has shingles in.
    own = short >> np.uint64(bits - range_bits)
    cuts = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(short))
    steps = np.diff(short, prepend=short[:1])
    steps[cuts[:-1]] = 0
    width = np.maximum(1, (np.ceil(np.log2(np.maximum.reduceat(steps, cuts[:-1]).astype(float) + 2)).astype(int) + 7) // 8)
    wide = steps.astype("<u8").view(np.uint8).reshape(-1, 8)
    for k, w, a, b in zip(own[cuts[:-1]].tolist(), np.minimum(width, 8).tolist(), cuts.tolist(), cuts[1:].tolist()):
        yield k, w, short[a].tobytes() + wide[a + 1 : b, :w].tobytes(), idx[a:b].tobytes()


def _unpacked(width: int, tokens: bytes) -> np.ndarray:
    steps = np.frombuffer(tokens, np.uint8, offset=8).reshape(-1, width)
    wide = np.zeros((len(steps) + 1, 8), np.uint8)
    wide[1:, :width] = steps
    out = wide.view("<u8").ravel()
    out[0] = np.frombuffer(tokens, "<u8", 1)[0]
    return np.cumsum(out, dtype=np.uint64)


def _sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets in parts of about a megabyte."""
    tokens, counts, part, size = [], [], [], 0
    for k, t in enumerate(texts):
        part.append(t)
        size += len(t or "")
        if size > 1 << 20 or k == len(texts) - 1:
            own, n = shingle_sets(part)
            tokens.append(own)
            counts.append(n)
            part, size = [], 0
    return (np.concatenate(tokens), np.concatenate(counts)) if tokens else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _layout(n_tokens: int) -> tuple[int, int, int]:
    """For so many shingles: bits of a hash range's number, bits of a packed hash, and how much larger than usual blocks are."""
    ranges = max(LEAST_RANGE_BITS, (max(n_tokens, 1) // RANGE_SHINGLES).bit_length())
    return ranges, max(ranges, min(64, max(n_tokens, 1).bit_length() + SPARE_BITS)), min(LARGEST_BLOCK, max(1, (1 << ranges) // MANY_RANGES))


def _counted(rows: pa.Table):
    """The packed rows of a hash range: ends of each row's shingles, and for each shingle its row, document and number of entries."""
    parts = [_unpacked(w, t) for w, t in zip(rows.column("width").to_pylist(), rows.column("tokens").to_pylist())]
    sizes = np.array([len(p) for p in parts])
    tokens = np.concatenate(parts)
    idx = np.frombuffer(b"".join(rows.column("idx").to_pylist()), "<u2")
    low = tokens.min(initial=np.iinfo(np.uint64).max)
    short, order = _sorted(tokens - low, np.arange(len(tokens)), int(tokens.max(initial=low) - low).bit_length(), len(tokens).bit_length())
    order = order.astype(np.int64)
    first = np.flatnonzero(np.append(True, short[1:] != short[:-1]))
    return parts, sizes, idx, order, first


def _profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n, h1, h2 and live (whether the set may link to another) of all rows."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    range_bits, bits, larger = _layout(n_bytes // 6)
    packed_names, key_names = _names(_PACKED), _names(_KEYS)
    schema = f"{_PACKED}, {_KEYS}"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.gathered(batches, BLOCK_DOCS * larger, BLOCK_BYTES * larger):
            tokens, n = _sets(batch.column("text").to_pylist())
            h1, h2 = set_hashes(tokens, n)
            classes: dict[tuple[int, int], int] = {}
            cls = np.array([classes.setdefault(h, len(classes)) for h in zip(h1.tolist(), h2.tolist())])
            one = np.zeros(len(n), bool)
            one[np.unique(cls, return_index=True)[1]] = True
            keep = np.repeat(one, n)
            ids = batch.column("doc_id").to_pylist()
            block = int.from_bytes(blake2b(repr(ids).encode() + h1.tobytes(), digest_size=8).digest(), "little", signed=True)
            rows = [(k, block, w, t, i, None, None, None, None, None) for k, w, t, i in _packed(tokens[keep], np.repeat(cls, n)[keep].astype(np.uint16), range_bits, bits)]
            rows.append((-1 - block % (1 << range_bits), block, None, None, None, ids, cls.tolist(), n.tolist(), h1.tolist(), h2.tolist()))
            yield pa.Table.from_pylist([dict(zip((*packed_names, *key_names), r)) for r in rows], _arrow(schema)).combine_chunks().to_batches()[0]

    counted = "block bigint, counts binary, " + _KEYS

    def once(key: tuple, rows: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return rows.select(["block", *key_names]).add_column(1, "counts", pa.nulls(len(rows), pa.binary()))
        _common.released()
        _, sizes, idx, order, first = _counted(rows)
        single = order[first[np.diff(first, append=len(order)) == 1]]
        single = np.sort(single[idx[single] != MANY])
        bounds = np.searchsorted(single, np.append(0, np.cumsum(sizes)))
        counts = [np.bincount(idx[single[a:b]]).astype("<u4").tobytes() for a, b in zip(bounds, bounds[1:])]
        out = {"block": rows.column("block"), "counts": pa.array(counts, pa.binary())}
        return pa.table(out | {c: pa.nulls(len(rows), t) for c, t in zip(key_names, _arrow(_KEYS).types)})

    def gather(rows: pa.Table) -> pa.Table:
        own = rows.select(key_names).to_pylist()
        single = np.zeros(max((len(r["cls"]) for r in own if r["ids"] is not None), default=0), np.int64)
        for c in rows.column("counts").to_pylist():
            part = np.frombuffer(c or b"", "<u4")
            single[: len(part)] += part
        out: list[list] = [[], [], [], [], []]
        for r in own:
            if r["ids"] is not None:
                n, cls = np.array(r["n"], np.int64), np.array(r["cls"], np.int64)
                live = (n > 0) & (single[cls] <= allowed(n))
                for column, values in zip(out, (r["ids"], r["n"], r["h1"], r["h2"], live.tolist())):
                    column += values
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], ["doc_id", "n", "h1", "h2", "live"])

    return docs.mapInArrow(emit, schema).groupBy("bucket").applyInArrow(once, counted).groupBy("block").applyInArrow(gather, "doc_id bigint, n bigint, h1 bigint, h2 bigint, live boolean")


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])


def _slot(doc_id: str, bits: int) -> str:
    return f"pmod(xxhash64(cast({doc_id} as bigint)), {bits}L)"


def _filter_bits(n: int) -> int:
    """The size of a filter of n documents, a power of two."""
    return 1 << max(10, (n * FILTER_BITS - 1).bit_length())


def _filter_words(ids: DataFrame, bits: int) -> DataFrame:
    """A filter of ids(doc_id) with bits at hashes: word and mask, bits / 32 rows at most."""
    return ids.selectExpr(f"{_slot('doc_id', bits)} as slot").groupBy(F.expr("slot div 32").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 32 as int)))").alias("mask"))


def _live_sets(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """The shingles of one document of each class that may link, in blocks."""
    live = profiles.where("live").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").select("doc_id")
    rows = docs.where("doc_id is not null").select("doc_id", "text")
    n = live.count()
    if n <= MOST_FILTERED:
        bits = _filter_bits(n)
        words = _filter_words(live, bits).toPandas()
        table = np.zeros(bits // 32, np.int64)
        table[words.word.to_numpy(np.int64)] = words["mask"].to_numpy(np.int64)
        shared = docs.sparkSession.sparkContext.broadcast(table)
        rows = rows.withColumn("slot", F.expr(_slot("doc_id", bits)))
    else:
        shared = None
        rows = rows.join(live, "doc_id", "left_semi").withColumn("slot", F.lit(0).cast("bigint"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared is not None:
                at = batch.column("slot").to_numpy()
                batch = batch.filter(pa.array(shared.value[at // 32] >> at % 32 & 1 == 1))
            for part in _common.pieces(iter([batch]), BLOCK_DOCS, BLOCK_BYTES):
                tokens, n = _sets(part.column("text").to_pylist())
                h1, h2 = set_hashes(tokens, n)
                ends = np.cumsum(n)
                sets = [tokens[e - k : e].tobytes() for e, k in zip(ends, n)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int32)), pa.array(h1), pa.array(h2), pa.array(sets, pa.binary())], ["doc_id", "n", "h1", "h2", "tokens"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.pieces(batches, BLOCK_DOCS, BLOCK_BYTES, "tokens"):
            ids, n = batch.column("cid").to_pylist(), batch.column("n").to_pylist()
            data = b"".join(batch.column("tokens").to_pylist())
            name = int.from_bytes(blake2b(repr(ids).encode() + data, digest_size=8).digest(), "little", signed=True)
            yield pa.Table.from_pylist([{"block": name, "ids": ids, "n": n, "tokens": data}], _arrow(_BLOCKS)).to_batches()[0]

    rows = rows.mapInArrow(read, "doc_id bigint, n int, h1 bigint, h2 bigint, tokens binary")
    classes = rows.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("cid"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    return _common.stored(classes.select("cid", "n", "tokens").mapInArrow(block, _BLOCKS), "sets")


def _prefixes(blocks: DataFrame) -> DataFrame:
    """Prefix shingles (level: the l at which one enters the prefix, matches: the document's l), and the star shingles, at level 0."""
    n_tokens = blocks.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    range_bits, bits, _ = _layout(n_tokens // 8)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                tokens, n = np.frombuffer(r["tokens"], np.uint64), np.array(r["n"])
                rows = [(k, r["block"], w, t, i) for k, w, t, i in _packed(tokens, np.repeat(np.arange(len(n)), n).astype(np.uint16), range_bits, bits)]
                # A shingle of several documents of the block: their number, in place of which one it is.
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*_with_numbers(rows, tokens, bits)), _arrow(_PACKED).types)], _names(_PACKED))

    def frequencies(rows: pa.Table) -> pa.Table:
        _common.released()
        parts, sizes, own, order, first = _counted(rows)
        size = np.diff(first, append=len(order))
        total = np.add.reduceat(own[order].astype(np.int64), first)
        back = np.empty(len(order), np.int64)
        back[order] = np.repeat(total, size)
        ends = np.cumsum(sizes)
        counts = [np.minimum(back[e - k : e], MANY).astype("<u2").tobytes() for e, k in zip(ends, sizes)]
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "width": rows.column("width"), "tokens": rows.column("tokens"), "counts": pa.array(counts, pa.binary())})

    def prefix(left: pa.Table, right: pa.Table) -> pa.Table:
        _common.released()
        out = []
        right = right.sort_by("bucket")
        known = np.concatenate([_unpacked(w, t) for w, t in zip(right.column("width").to_pylist(), right.column("tokens").to_pylist())]) if len(right) else np.zeros(0, np.uint64)
        counts = np.frombuffer(b"".join(right.column("counts").to_pylist()), "<u2").astype(np.int64)
        for r in left.slice(0, 1).to_pylist():  # blocks of one name are equal
            tokens, n = np.frombuffer(r["tokens"], np.uint64), np.array(r["n"], np.int64)
            df = counts[np.searchsorted(known, tokens >> np.uint64(64 - bits))]
            own = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((tokens, df, own))
            tokens, df = tokens[order], df[order]
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
            level = np.maximum(place - allowed(n)[own] + 1, 1)
            shared = df > 1
            most = np.minimum(MOST_MATCHES, n - allowed(n))
            central = np.bincount(own[~shared], minlength=len(n)) * 4096 // n
            # Posting rows that the prefixes for l = 1, 2, ... read, and the cost of each l. Against sets of like size the
            # positional bound lets those of the first n / 7 + l places through only (room in links, with equal sizes).
            read = np.zeros((len(n), MOST_MATCHES + 1))
            entry = np.maximum(place - (n * (100 - LEAST) // (100 + LEAST))[own] + 1, 1)
            near = shared & (entry <= MOST_MATCHES)
            np.add.at(read, (own[near], entry[near]), df[near] - 1)
            read = np.cumsum(read, 1)[:, 1:]
            cost = read * (1 + CHECK_COST / np.arange(1, MOST_MATCHES + 1))
            cost[np.arange(1, MOST_MATCHES + 1)[None] > most[:, None]] = np.inf
            matches = cost.argmin(1) + 1
            keep = np.flatnonzero(shared & (level <= matches[own]))
            out.append((tokens[keep], own[keep], level[keep], place[keep], r, matches, central))
            # The least hashes of the shared shingles: near copies have most of them in common.
            at = np.flatnonzero(shared)
            by = at[np.lexsort((mix(tokens[at]), own[at]))]
            many = np.bincount(own[by], minlength=len(n))
            by = by[np.arange(len(by)) - np.repeat(np.cumsum(many) - many, many) < STAR_SHINGLES]
            out.append((tokens[by], own[by], np.zeros(len(by), np.int64), place[by], r, matches, central))
        columns: list[list[np.ndarray]] = [[] for _ in range(7)]
        for tokens, own, level, place, r, matches, central in out:
            for column, x in zip(columns, (tokens.view(np.int64), np.array(r["ids"], np.int64)[own], np.array(r["n"])[own], central[own], level, matches[own], place)):
                column.append(x)
        return pa.table([pa.array(np.concatenate(c).astype(t.to_pandas_dtype()) if c else [], t) for c, t in zip(columns, _arrow(_PREFIX).types)], _names(_PREFIX))

    counted = blocks.mapInArrow(emit, _PACKED).groupBy("bucket").applyInArrow(frequencies, "block bigint, bucket int, width int, tokens binary, counts binary")
    return _common.stored(blocks.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(prefix, _PREFIX), "prefixes")


def _with_numbers(rows: list[tuple], tokens: np.ndarray, bits: int) -> Iterator[tuple]:
    """The packed rows with the number of the block's documents that have a shingle in place of a document."""
    counts = np.unique(tokens >> np.uint64(64 - bits), return_counts=True)[1]
    at = 0
    for k, block, width, packed, idx in rows:
        n = len(idx) // 2
        yield k, block, width, packed, np.minimum(counts[at : at + n], MANY).astype("<u2").tobytes()
        at += n


def _verified(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """The pairs(a, b) whose sets have the similarity."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ends = 8 * np.cumsum(r["n"])
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array([r["tokens"][e - 8 * k : e] for e, k in zip(ends, r["n"])], pa.binary())], ["id", "tokens"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= LEAST * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    sets = blocks.mapInArrow(each, "id bigint, tokens binary")
    pairs = pairs.select("a", "b")
    wide = _common.joined(pairs, sets.selectExpr("id as a", "tokens as x"), "a", _common.hot_keys(pairs, "a"), salts=SALTS)
    wide = _common.joined(wide, sets.selectExpr("id as b", "tokens as y"), "b", _common.hot_keys(pairs, "b"), salts=SALTS)
    return wide.mapInArrow(check, "a bigint, b bigint")


_SIZES = f"100 * least(n_a, n_b) >= {LEAST} * greatest(n_a, n_b)"


def links(blocks: DataFrame) -> DataFrame:
    """label of each class (cid) that links to another: the smallest doc_id of its component."""
    rows = _prefixes(blocks)
    star = rows.where("level = 0").select("token", "cid", "n", "central")
    centre = star.groupBy("token").agg(F.min(F.struct("central", "cid", "n")).alias("c")).selectExpr("token", "c.cid as b", "c.n as n_b")
    # A posting of a third of all documents is split, from its aggregates' partial sums on.
    to_centre = _common.joined(star.selectExpr("token", "cid as a", "n as n_a"), centre, "token", _common.hot_keys(star, "token")).where(f"a != b and {_SIZES}").groupBy("a", "b").count()
    found = _common.stored(_verified(to_centre.groupBy("a").agg(F.max_by("b", F.struct("count", F.negate("b"))).alias("b")), blocks), "star-links")
    labels = components(found)

    hot = _common.hot_keys(rows.where("level > 0"), "token")
    prefix = rows.where("level > 0").join(labels, F.col("cid") == F.col("id"), "left").selectExpr("token", "cid", "n", "level", "matches", "place", "coalesce(label, cid) as label")
    # Of a posting only pairs across components are left to find, and one of such a pair is outside the posting's
    # largest component. Whoever's rest from here on can't reach the overlap even with the smallest set there drops out.
    posting = prefix.groupBy("token", "label").agg(F.count("*").alias("rows"), F.min("n").alias("low"))
    posting = posting.groupBy("token").agg(F.max_by("label", F.struct("rows", F.negate("label"))).alias("major"), F.count("*").alias("labels"), F.min("low").alias("low")).where("labels > 1").drop("labels")
    prefix = _common.joined(prefix, posting, "token", hot).where(f"{100 + LEAST} * (n - place + matches - 1) >= {LEAST} * (n + greatest(low, {LEAST} * n / 100))")
    names = ("cid", "n", "level", "matches", "place", "label")
    one = prefix.where("label != major").selectExpr("token", *(f"{c} as {c}_a" for c in names))
    other = prefix.selectExpr("token", *(f"{c} as {c}_b" for c in names), "label = major as inner")
    least = "least(matches_a, matches_b)"
    # Of the first l common shingles each leaves room for the overlap that the sizes ask for, but for those before it.
    room = f"{100 + LEAST} * (least(n_a - place_a, n_b - place_b) + {least} - 1) >= {LEAST} * (n_a + n_b)"
    is_hot = F.col("token").isin(hot)
    met = one.join(other, "token") if not hot else one.where(~is_hot).join(other.where(~is_hot), "token").unionByName(_common.salted(other.where(is_hot), one.where(is_hot), ["token"], SALTS))
    pairs = met.where(f"label_a != label_b and (inner or cid_a < cid_b) and {_SIZES} and greatest(level_a, level_b) <= {least} and {room}")
    pairs = pairs.groupBy(F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b"), F.expr("if(cid_a < cid_b, label_a, label_b)").alias("label_a"), F.expr("if(cid_a < cid_b, label_b, label_a)").alias("label_b")).agg(F.count("*").alias("shared"), F.first(F.expr(least)).alias("need"))
    pairs = _common.stored(pairs.where("shared >= need").select("a", "b", "label_a", "label_b", "shared"), "candidates")
    # The closest candidate of each document in each other component first: what it links needs no other check.
    close = pairs.groupBy("a", "label_b").agg(F.max_by("b", F.struct("shared", F.negate("b"))).alias("b")).select("a", "b")
    close = close.unionAll(pairs.groupBy("b", "label_a").agg(F.max_by("a", F.struct("shared", F.negate("a"))).alias("a")).select("a", "b")).distinct()
    close = _common.stored(close, "close")
    found = _common.stored(found.unionAll(_verified(close, blocks)), "close-links")
    labels = components(found)
    now = labels.selectExpr("id as a", "label as x"), labels.selectExpr("id as b", "label as y")
    rest = pairs.select("a", "b").join(close, ["a", "b"], "left_anti").join(now[0], "a", "left").join(now[1], "b", "left").where("coalesce(x, a) != coalesce(y, b)")
    more = _common.stored(_verified(rest, blocks), "late-links")
    return labels if more.isEmpty() else components(found.unionAll(more))


def jaccard_components(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs(doc_id, column)."""
    docs = _common.bounded(docs).selectExpr("cast(doc_id as bigint) doc_id", f"`{column}` as text")
    profiles = _common.stored(_profiles(docs), "profiles")
    labels = links(_live_sets(docs, profiles))
    classes = profiles.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("cid"), F.count("*").alias("copies"))
    # Only classes of several documents, or with links, say more than the document itself.
    classes = classes.join(labels, F.col("cid") == F.col("id"), "left").where("copies > 1 or label is not null").selectExpr("h1", "h2", "copies", "coalesce(label, cid) as label")
    classes = _common.stored(classes, "classes")
    # Classes of very many copies: HOT_SHARE of them at most, so they are broadcast; the others' keys are shuffled.
    large = classes.where(F.col("copies") > max(_common.HOT_ROWS, profiles.count() // _common.HOT_SHARE))
    small = classes.join(F.broadcast(large.select("h1", "h2")), ["h1", "h2"], "left_anti")
    inside = profiles.join(F.broadcast(large), ["h1", "h2"])
    beside = profiles.join(F.broadcast(large.select("h1", "h2")), ["h1", "h2"], "left_anti").join(small, ["h1", "h2"], "left")
    return inside.unionByName(beside).selectExpr("doc_id", "n as n_shingles", "if(n > 0, coalesce(label, doc_id), doc_id) as component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of one document of each component, that of the smallest doc_id; of rows that share a
    doc_id the one with the least text stays. Rows without doc_id stay. Columns as they are, whatever their names.

    Only rows that a filter names are shuffled: those that go, those of repeated ids
    and a few by chance; the others pass where they are. Above MOST_FILTERED of those, all rows are looked up by a join.
    """
    found = _common.stored(jaccard_components(docs), "components")
    special = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("low"), F.count("*").alias("rows")).where("low < doc_id or rows > 1")
    special = _common.stored(special, "special")
    # A row is one column here, so that its columns' names can't meet those of the filter.
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    n = special.count()
    if n <= MOST_FILTERED // 4:
        bits = _filter_bits(n)
        named = whole.withColumn("slot", F.expr(_slot("row.doc_id", bits))).withColumn("word", F.expr("slot div 32"))
        named = named.join(F.broadcast(_filter_words(special, bits)), "word", "left")
        hit = F.expr("row.doc_id is not null and coalesce(shiftright(mask, cast(slot % 32 as int)) & 1, 0L) = 1")
        passed, held = named.where(~hit).select("row"), named.where(hit).select("row")
    else:
        passed, held = whole.where("row.doc_id is null"), whole.where("row.doc_id is not null")
    held = held.join(special, F.col("row.doc_id") == F.col("doc_id"), "left").where("low is null or low = doc_id")
    single = held.where("coalesce(rows, 1) = 1").select("row")
    one = held.where("rows > 1").groupBy("doc_id").agg(F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row")).select("row")
    return passed.unionAll(single).unionAll(one).select("row.*")


#: The same by plain pairs: every two documents that share a shingle are compared on whole sets.
ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 75 * (p.n + q.n - shared)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS low FROM r GROUP BY x) m ON m.x = d.doc_id
"""
