"""Operator 1, token-id output: a content-addressed store of token ids.

``write_store`` encodes each text, appends an end id and cuts the id stream where a rolling hash
of the last WINDOW ids has its low bits zero (so equal passages give equal chunks wherever they
stand), with a least and a greatest chunk length.  A chunk's address is the 128-bit blake2b of its
bytes; each distinct chunk is written once.  A document is a recipe, the list of its chunk
addresses and lengths, with a Merkle leaf over them; recipes lie in ascending doc_id order in
numbered parts, and a manifest keeps for each part the numbers of documents and ids and the Merkle root of its
leaves.  One more row, the head, keeps the number of parts, the Merkle root over their roots, the width of an id, the end
id and a digest of the tokenizer's file.  ``read_store`` reads those files only: it checks each chunk against its address, each
recipe against its leaf, each part against its root and the parts against the head, and fails on any
difference: a part, a recipe or a manifest row that is missing or there twice, too.  What reaches the driver is
two rows for each part, of which there are as many as tasks that wrote.

Files below the given path: ``packs`` (kind 'c': chunks; kind 'r': staged recipes), ``recipes``,
``manifest``, ``head``.  Chunk rows are shuffled once by address after each task has dropped its own
repeats, so a chunk of a third of all documents is a row for each task; the number of parts follows the size of the
texts, so what a task remembers has a bound.  Lengths, starts and
checksums come from light rows; chunk bytes never travel a second time.

Null texts are empty texts, and an empty text is one chunk with the end id alone.  Repeated rows
stay, one recipe each; ties in doc_id are ordered by content.  Further columns are ignored.  An
empty table gives an empty store.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplospark.llm import _common
from haplospark.llm._encoder import encoder

WINDOW = 8
DIGEST = 16
#: Text whose chunks one task keeps apart, about: some hundred thousand addresses.
PART_BYTES = 64 << 20
#: The reflected polynomial of CRC-32, a fixed value.
CRC_POLYNOMIAL = 0xEDB88320
#: Recipes have their addresses in a column of their own, so that who reads recipes reads no chunk, and the other way round.
PACK_SCHEMA = "kind string, key binary, doc_id bigint, n bigint, payload binary, digests binary, counts binary"
MANIFEST_SCHEMA = "part int, n_docs bigint, n_ids bigint, root binary"
HEAD_SCHEMA = "n_parts bigint, top binary, width int, end_id bigint, tokenizer binary"
RECIPE_SCHEMA = "part int, position bigint, doc_id bigint, start_in_part bigint, n bigint, digests binary, counts binary, leaf binary"


def digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """The root of a binary tree of digests; an odd one goes up as it is."""
    while len(leaves) > 1:
        leaves = [digest(b"".join(leaves[i : i + 2])) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else digest(b"")


def rolling(ids: np.ndarray) -> np.ndarray:
    """At each place a hash of the last WINDOW ids (of fewer at the start, where no cut is allowed)."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    out = mixed.copy()
    for j in range(1, WINDOW):
        out[j:] += mixed[:-j] << np.uint64(j)
    return out * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)


def cuts(candidates: list[int], n: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of a stream of *n* ids; *candidates*: ascending ends that the hash offers."""
    ends, at = [], 0
    for c in candidates:
        while c - at > most:
            at += most
            ends.append(at)
        if c - at >= least:
            ends.append(at := c)
    while n - at > most:
        at += most
        ends.append(at)
    return [*ends, n] if at < n else ends


def write_store(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, mean: int = 512, least: int = 64, most: int = 4096, column: str = "text") -> None:
    """Writes the store of docs(doc_id, column) to *path*. mean: a power of 2, of ids in a chunk."""
    if least < WINDOW or mean & (mean - 1):
        raise ValueError("least must be WINDOW at least, and mean a power of 2")
    names = [x.split()[0] for x in PACK_SCHEMA.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = encoder(tokenizer)
        end, width = np.array([end_id], units.dtype).tobytes(), units.dtype.itemsize
        seen: set[bytes] = set()
        for batch in _common.pieces(batches, 2048, 4 << 20):
            rows: list[tuple] = []
            coded = [units.packed(t or "") + end for t in batch.column("text").to_pylist()]
            offered = np.flatnonzero((rolling(np.frombuffer(b"".join(coded), units.dtype)) & np.uint64(mean - 1)) == 0) + 1
            stops = np.cumsum([len(data) // width for data in coded])
            bounds, offered = np.searchsorted(offered, stops, "right").tolist(), offered.tolist()
            at = lo = 0
            for doc_id, data, hi in zip(batch.column("doc_id").to_pylist(), coded, bounds):
                n = len(data) // width
                ends = cuts([c - at for c in offered[lo:hi]], n, least, most)
                at, lo = at + n, hi
                begun, addresses, sizes = 0, [], array("I")
                for e in ends:
                    chunk = data[begun * width : e * width]
                    addresses.append(key := digest(chunk))
                    sizes.append(e - begun)
                    if key not in seen:
                        seen.add(key)
                        rows.append(("c", key, None, e - begun, chunk, None, None))
                    begun = e
                rows.append(("r", digest(str(doc_id).encode()), doc_id, n, None, b"".join(addresses), np.asarray(sizes, "<u4").tobytes()))
            if len(seen) > 1 << 18:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keep = []
            for kind, key in zip(batch.column("kind").to_pylist(), batch.column("key").to_pylist()):
                keep.append(kind == "r" or key not in seen)
                if kind == "c":
                    seen.add(key)
            yield batch.filter(pa.array(keep, pa.bool_()))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, position = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            starts = start + np.cumsum(n) - n
            leaves = [digest(a + b) for a, b in zip(batch.column("digests").to_pylist(), batch.column("counts").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(position, position + len(n))), batch.column("doc_id"), pa.array(starts), batch.column("n"), batch.column("digests"), batch.column("counts"), pa.array(leaves, pa.binary())], [x.split()[0] for x in RECIPE_SCHEMA.split(", ")])
            start, position = start + int(n.sum()), position + len(n)

    spark = docs.sparkSession
    source = _common.bounded(docs).selectExpr("cast(doc_id as bigint) doc_id", f"`{column}` as text")
    # A part of the addresses is a set in one task: PART_BYTES of text have about PART_BYTES / (4 * mean) chunks, whatever the input.
    n_bytes = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, n_bytes // PART_BYTES + 1)
    source.mapInArrow(encode, PACK_SCHEMA).repartition(parts, "key").mapInArrow(once, PACK_SCHEMA).write.option("compression", "zstd").parquet(f"{path}/packs")
    staged = spark.read.schema(PACK_SCHEMA).parquet(f"{path}/packs").where("kind = 'r'").select("doc_id", "n", "digests", "counts")
    staged.repartitionByRange("doc_id", "digests").sortWithinPartitions("doc_id", "digests").mapInArrow(numbered, RECIPE_SCHEMA).write.option("compression", "zstd").parquet(f"{path}/recipes")
    _roots(spark.read.schema(RECIPE_SCHEMA).parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    parts = _parts(spark, path)
    with open(tokenizer, "rb") as f:
        head = (len(parts), merkle_root([r.root for r in parts]), encoder(tokenizer).dtype.itemsize, end_id, digest(f.read()))
    spark.createDataFrame([head], HEAD_SCHEMA).coalesce(1).write.parquet(f"{path}/head")


def _parts(spark: SparkSession, path: str) -> list:
    """The rows of the manifest in order of part: one for each task that wrote recipes."""
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/manifest").orderBy("part").collect()


def _head(spark: SparkSession, path: str):
    """The head of a store, after the manifest was held against it."""
    heads = spark.read.schema(HEAD_SCHEMA).parquet(f"{path}/head").collect()
    if len(heads) != 1:
        raise ValueError("a store has one head")
    parts = _parts(spark, path)
    if heads[0].n_parts != len(parts) or len({r.part for r in parts}) != len(parts):
        raise ValueError("the manifest lacks a part, or has one twice")
    if merkle_root([r.root for r in parts]) != heads[0].top:
        raise ValueError("the parts' roots differ from the store's root")
    return heads[0]


def _roots(recipes: DataFrame) -> DataFrame:
    """part, n_docs, n_ids and Merkle root of each part, a row for each."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for part, position, n, leaf in zip(*(batch.column(c).to_pylist() for c in ("part", "position", "n", "leaf"))):
                found.setdefault(part, []).append((position, n, leaf))
        for part, rows in found.items():
            rows.sort()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": pa.array([len(rows)], pa.int64()), "n_ids": pa.array([sum(x[1] for x in rows)], pa.int64()), "root": pa.array([merkle_root([x[2] for x in rows])], pa.binary())})

    return recipes.select("part", "position", "n", "leaf").repartition("part").mapInArrow(roots, MANIFEST_SCHEMA)


def crc_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo that of CRC-32, in its reflected bit order."""
    a, b, out = a.astype(np.uint32), b.astype(np.uint32), np.zeros(len(a), np.uint32)
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = b >> np.uint32(1) ^ np.where(b & np.uint32(1), np.uint32(CRC_POLYNOMIAL), np.uint32(0))
    return out


@lru_cache(1)
def _shifts() -> list[np.ndarray]:
    """For each k the products of a checksum's four bytes, at their places, with x to the 8 * 2**k."""
    out, power = [], np.array([1 << 23], np.uint32)  # x to the 8
    places = (np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    for _ in range(48):
        out.append(crc_product(np.full(len(places), power[0], np.uint32), places).reshape(4, 256))
        power = crc_product(power, power)
    return out


def crc_before(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What bytes of checksum *crc* add to the checksum of a stream in which *n_bytes* follow them."""
    out, n = crc.astype(np.uint32), n_bytes.astype(np.int64)
    for table in _shifts():
        if not n.any():
            break
        odd = np.flatnonzero(n & 1)
        own = out[odd]
        out[odd] = table[0][own & 255] ^ table[1][own >> 8 & 255] ^ table[2][own >> 16 & 255] ^ table[3][own >> 24]
        n = n >> 1
    return out


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks of each document, from the files alone."""
    width = _head(spark, path).width

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, data = batch.column("key").to_pylist(), batch.column("payload").to_pylist()
            if any(digest(d) != k for k, d in zip(keys, data)):
                raise ValueError("a chunk's bytes differ from its address")
            crc = [zlib.crc32(np.frombuffer(d, f"<u{width}").astype("<u4").tobytes()) for d in data]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([len(d) // width for d in data], pa.int64()), pa.array(crc, pa.int64())], ["digest", "stored", "crc"])

    def references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.pieces(batches, 1 << 14, 4 << 20, "digests"):
            digests, counts = batch.column("digests").to_pylist(), batch.column("counts").to_pylist()
            if any(digest(a + b) != leaf for a, b, leaf in zip(digests, counts, batch.column("leaf").to_pylist())):
                raise ValueError("a recipe differs from its Merkle leaf")
            many = np.array([len(x) // DIGEST for x in digests])
            n = np.frombuffer(b"".join(counts), "<u4").astype(np.int64)
            after = np.repeat(np.cumsum(np.bincount(np.repeat(np.arange(len(many)), many), n, len(many)).astype(np.int64)), many) - np.cumsum(n)
            row = np.repeat(np.arange(batch.num_rows), many)
            flat = pa.Array.from_buffers(pa.binary(DIGEST), len(n), [None, pa.py_buffer(b"".join(digests))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("part").take(pa.array(row)), batch.column("position").take(pa.array(row)), flat, pa.array(n), pa.array(after)], ["part", "position", "digest", "n", "after"])

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column("crc").null_count or batch.column("n") != batch.column("stored"):
                raise ValueError("a recipe names a chunk that isn't stored")
            crc = crc_before(batch.column("crc").to_numpy(), 4 * batch.column("after").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("position"), pa.array(crc.astype(np.int64)), batch.column("n")], ["part", "position", "crc", "n"])

    recipes = spark.read.schema(RECIPE_SCHEMA).parquet(f"{path}/recipes")
    # Held against the manifest before anything else, for a lazy plan may never look at a part that has no rows.
    again = {r.part: tuple(r) for r in _roots(recipes).collect()}
    parts = _parts(spark, path)
    if again != {r.part: tuple(r) for r in parts}:
        raise ValueError("a part of the recipes differs from its Merkle root, or is missing")
    before = np.cumsum([0, *(r.n_ids for r in parts)]).tolist()
    offsets = spark.createDataFrame([(r.part, n) for r, n in zip(parts, before)], "part int, offset bigint")
    chunks = spark.read.schema(PACK_SCHEMA).parquet(f"{path}/packs").where("kind = 'c'").select("key", "payload").mapInArrow(checked, "digest binary, stored bigint, crc bigint")
    named = recipes.select("part", "position", "digests", "counts", "leaf").mapInArrow(references, "part int, position bigint, digest binary, n bigint, after bigint")
    sums = named.join(chunks, "digest", "left").select("part", "position", "n", "after", "crc", "stored").mapInArrow(shifted, "part int, position bigint, crc bigint, n bigint")
    sums = sums.groupBy("part", "position").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("n_tokens"), F.count("*").alias("n_chunks"))
    light = recipes.select("part", "position", "doc_id", "start_in_part", F.col("n").alias("n_named"))
    return (
        light.join(sums, ["part", "position"])
        .join(F.broadcast(offsets), "part")
        .select("doc_id", (F.col("offset") + F.col("start_in_part")).alias("start"), F.expr("if(n_tokens = n_named, n_tokens, cast(raise_error('a length differs') as bigint))").alias("n_tokens"), "ids_crc32", "n_chunks")
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian, as wide as the head says): whole documents put together from their chunks."""
    _head(spark, path)
    recipes = spark.read.schema(RECIPE_SCHEMA).parquet(f"{path}/recipes")
    chunks = spark.read.schema(PACK_SCHEMA).parquet(f"{path}/packs").where("kind = 'c'").selectExpr("key as digest", "payload")
    each = recipes.select("part", "position", "doc_id", F.posexplode(F.expr(f"transform(sequence(0, length(digests) div {DIGEST} - 1), i -> substring(digests, cast(i * {DIGEST} + 1 as int), {DIGEST}))")).alias("k", "digest"))
    return each.join(chunks, "digest").groupBy("part", "position", "doc_id").agg(F.expr("array_join(transform(sort_array(collect_list(struct(k, payload))), x -> hex(x.payload)), '')").alias("x")).select("doc_id", F.unhex("x").alias("ids"))
