"""K-mers of reads patched into their region's reference, and which of them have enough support."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplospark.functions import bisulfite, cigar

SATURATION = 15


def bounds(pairs: DataFrame) -> DataFrame:
    """i0, i1, p0, p1 of each pair: the first and last base at a position from lo to before hi, and their positions.

    pairs(pos, cigar, lo, hi).  Pairs without such a base go.
    """
    found = pairs.withColumn("_found", cigar.bounds(F.col("pos"), F.col("cigar"), F.col("lo"), F.col("hi")))
    return found.select(*pairs.columns, *(F.col(f"_found.{c}").alias(c) for c in ("i0", "i1", "p0", "p1"))).where("i0 >= 0")


def patched(bounded: DataFrame, k: int = 25) -> DataFrame:
    """conversion and patched: the read's bases in the window in place of the reference there, both converted.

    bounded(seq, flag, xg, ref, ref_start, i0, i1, p0, p1).  Reads that reach less than 2k go.
    """
    kept = bounded.where(f"p0 - ref_start + i1 - i0 + 1 > {2 * k}")
    kind = bisulfite.conversion(bisulfite.strand(F.col("flag"), F.col("xg")))
    text = F.expr("concat(substring(ref, 1, p0 - ref_start), substring(seq, i0 + 1, i1 - i0 + 1), substring(ref, p1 - ref_start + 2))")
    return kept.withColumn("conversion", kind).withColumn("patched", bisulfite.converted(text, F.col("conversion")))


def kmers(text: Column, k: int, first: int = 0, last: int = 0) -> Column:
    """The k-mers of a text in order, without so many at the start and at the end."""
    n = F.length(text) - k + 1 - last
    return F.when(n > first, F.transform(F.sequence(F.lit(first), n - 1), lambda i: F.substring(text, i + 1, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def read_kmers(patches: DataFrame, k: int = 25) -> DataFrame:
    """tid, roi_start, roi_end, conversion, kmer, n: how many reads' patched texts hold each k-mer, the first and last left out.

    Equal texts are counted before they are taken apart.
    """
    key = ("tid", "roi_start", "roi_end", "conversion")
    texts = patches.groupBy(*key, "patched").agg(F.count("*").alias("times"))
    return texts.select(*key, "times", F.explode(kmers(F.col("patched"), k, 1, 1)).alias("kmer")).groupBy(*key, "kmer").agg(F.sum("times").alias("n"))


def reference_kmers(windows: DataFrame, k: int = 25) -> DataFrame:
    """The distinct k-mers of the converted reference windows."""
    kinds = windows.select("tid", "roi_start", "roi_end", "ref", F.explode(F.array(F.lit("CT"), F.lit("GA"))).alias("conversion"))
    found = F.array_distinct(kmers(bisulfite.converted(F.col("ref"), F.col("conversion")), k))
    return kinds.select("tid", "roi_start", "roi_end", "conversion", F.explode(found).alias("kmer"))


def sufficient(reads: DataFrame, reference: DataFrame, least: int = 4) -> DataFrame:
    """tid, roi_start, roi_end, conversion, kmer, n of k-mers with a count of *least*; counts saturate, and the reference's are full."""
    full = reference.withColumn("n", F.lit(SATURATION).cast("bigint"))
    both = reads.select(*full.columns).unionAll(full)
    counted = both.groupBy("tid", "roi_start", "roi_end", "conversion", "kmer").agg(F.least(F.sum("n"), F.lit(SATURATION)).alias("n"))
    return counted.where(F.col("n") >= min(max(least, 1), SATURATION))


def most_indel(patches: DataFrame) -> DataFrame:
    """tid, roi_start, roi_end, max_ins, max_del of the reads that reach the region, of both conversions."""
    diff = F.col("i1") - F.col("i0") - (F.col("p1") - F.col("p0"))
    return patches.groupBy("tid", "roi_start", "roi_end").agg(F.max(F.greatest(diff, F.lit(0))).alias("max_ins"), F.max(F.greatest(-diff, F.lit(0))).alias("max_del"))


def edges(found: DataFrame) -> DataFrame:
    """source and target: k-mers of a region and conversion of which one goes on with the other."""
    key = ["tid", "roi_start", "roi_end", "conversion"]
    one = found.select(*key, F.col("kmer").alias("source"), F.expr("substring(kmer, 2)").alias("overlap"))
    two = found.select(*key, F.col("kmer").alias("target"), F.expr("substring(kmer, 1, length(kmer) - 1)").alias("overlap"))
    return one.join(two, [*key, "overlap"]).drop("overlap")


def sketch_layout(width: Column, k: int) -> dict[str, Column]:
    """items, cells and buckets of a sketch for a region of that width: buckets is the next power of two."""
    items = 5 * (width + 4 * k - 1)
    cells = F.rint(-items / math.log(0.9)).cast("bigint")
    return {"items": items, "cells": cells, "buckets": F.pow(F.lit(2.0), F.ceil(F.log2(cells.cast("double")))).cast("bigint")}


def sketched(reads: DataFrame, buckets: int = 8192) -> DataFrame:
    """tid, roi_start, roi_end, conversion, bucket, n: saturating counts by a hash of the k-mer, one row of counters."""
    bucket = F.conv(F.substring(F.md5("kmer"), 1, 8), 16, 10).cast("bigint") % buckets
    return reads.groupBy("tid", "roi_start", "roi_end", "conversion", bucket.alias("bucket")).agg(F.least(F.sum("n"), F.lit(SATURATION)).alias("n"))


def _turned(x: np.ndarray, r: int) -> np.ndarray:
    return x << np.uint64(r) | x >> np.uint64(64 - r)


def murmur3_low(texts: list[bytes], seed: int = 0xAAAAAAAA) -> np.ndarray:
    """The low words of the public-domain MurmurHash3 of 128 bits for 64-bit machines, texts of one length at once; constants are fixed values."""
    c1, c2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
    out = np.zeros(len(texts), np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)

    def scatter(x: np.ndarray, a: np.uint64, r: int, b: np.uint64) -> np.ndarray:
        return _turned(x * a, r) * b

    def finish(x: np.ndarray) -> np.ndarray:
        x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ x >> np.uint64(33)

    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        # Whole blocks of two words, and one more of what is left, with zeros behind it.
        blocks = n // 16 + 1
        padded = b"".join(texts[i].ljust(16 * blocks, b"\0") for i in at)
        words = np.frombuffer(padded, "<u8").reshape(len(at), 2 * blocks)
        low = high = np.full(len(at), seed, np.uint64)
        for b in range(blocks - 1):
            low = low ^ scatter(words[:, 2 * b], c1, 31, c2)
            low = (_turned(low, 27) + high) * np.uint64(5) + np.uint64(0x52DCE729)
            high = high ^ scatter(words[:, 2 * b + 1], c2, 33, c1)
            high = (_turned(high, 31) + low) * np.uint64(5) + np.uint64(0x38495AB5)
        low = low ^ scatter(words[:, -2], c1, 31, c2) ^ np.uint64(n)
        high = high ^ scatter(words[:, -1], c2, 33, c1) ^ np.uint64(n)
        low = low + high
        out[at] = finish(low) + finish(high + low)
    return out


def kmer_hashes(found: DataFrame) -> DataFrame:
    """The rows with ``hash``, the low word of the murmur hash of kmer as a signed long, in Arrow batches."""
    import pyarrow as pa
    from pyspark.sql import types as T

    def run(batches):
        for batch in batches:
            column = batch.column("kmer")
            signed = murmur3_low([(x or "").encode() for x in column.to_pylist()]).view(np.int64)
            hashes = pa.array(signed, pa.int64(), mask=column.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, hashes], [*batch.schema.names, "hash"])

    return found.mapInArrow(run, T.StructType([*found.schema.fields, T.StructField("hash", T.LongType())]))
