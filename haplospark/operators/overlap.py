"""Joins of reads and regions by overlap, and the windows of reference around regions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplospark.functions import cigar
from haplospark.operators import targets

BIN = 256
#: Bases of a tile of a contig, and those of the next tiles that it has as well.
TILE, BEYOND = 4096, 1024


def spans(reads: DataFrame) -> DataFrame:
    """reads with span_start (before a leading soft clip) and span_end (the last position)."""
    pos, text = F.col("pos"), F.col("cigar")
    return reads.withColumns({"span_start": cigar.clipped_start(pos, text), "span_end": cigar.last_position(pos, text)})


@lru_cache(1 << 16)
def _extent(text: str | None) -> tuple[int, int]:
    """Bases of a leading soft clip, as cigar.clipped_start counts them, and positions of the reference, 1 at least."""
    clip = re.match("([0-9]+)S", text or "")
    length = sum(int(n) for n, op in re.findall("([0-9]+)([MIDNSHP=XB])", text or "") if op in "MDN=X")
    return int(clip[1]) if clip and len(clip[1]) <= 9 else 0, max(length, 1)


def spans_by_shape(reads: DataFrame) -> DataFrame:
    """spans, for many reads of few CIGARs: each CIGAR is taken apart once, in Arrow batches."""

    @F.arrow_udf("struct<clip: int, length: int>")
    def extent(column: pa.Array) -> pa.Array:
        shapes = column.dictionary_encode("encode")
        found = np.array([_extent(x) for x in shapes.dictionary.to_pylist()], np.int64).reshape(-1, 2)[np.asarray(shapes.indices)]
        return pa.StructArray.from_arrays([pa.array(found[:, i], pa.int32()) for i in range(2)], ["clip", "length"])

    with_extent = reads.withColumn("_extent", extent("cigar"))
    start, end = F.greatest(F.lit(0), F.col("pos") - F.col("_extent.clip")), F.col("pos") + F.col("_extent.length") - 1
    return with_extent.withColumns({"span_start": start, "span_end": end}).drop("_extent")


def _bins(start: Column, end: Column) -> Column:
    return F.sequence(_bin(start), _bin(F.greatest(start, end)))


def _bin(at: Column) -> Column:
    """Places before the contig are in the first bin."""
    return (F.greatest(at, F.lit(0)) / BIN).cast("int")


def overlapping(reads: DataFrame, regions: DataFrame, more: tuple[str, ...] = (), spanned: Callable[[DataFrame], DataFrame] = spans) -> DataFrame:
    """A row for each read and each region of its contig with span_start <= roi_end and span_end >= roi_start.

    Both sides are dealt to bins of BIN bases, so it is an equi-join; a pair that shares several bins
    is kept in the first only, which needs no distinct.  A hot contig is as many keys as it has bins.  Reads come with the columns of
    spans; those of the same names that they had are replaced. more: further columns of the regions. spanned: spans or spans_by_shape.
    """
    roi = regions.selectExpr("tid", "start as roi_start", "end as roi_end", *more)
    left = spanned(reads).withColumn("bin", F.explode(_bins(F.col("span_start"), F.col("span_end"))))
    right = roi.withColumn("bin", F.explode(_bins(F.col("roi_start"), F.col("roi_end"))))
    first = F.greatest(_bin(F.col("span_start")), _bin(F.col("roi_start")))
    return left.join(right, ["tid", "bin"]).where((F.col("span_start") <= F.col("roi_end")) & (F.col("span_end") >= F.col("roi_start")) & (F.col("bin") == first)).drop("bin")


def grouped(reads: DataFrame, regions: DataFrame, reach: int) -> DataFrame:
    """overlapping, and the reads that a pass in coordinate order gathers beside them: those that begin before the region's end and not
    before its first mapped overlapping read, if they come within *reach* bases of it. Reads clipped at the site are such."""
    wide = regions.selectExpr("tid", f"start - {reach} as start", "end")
    near = overlapping(reads, wide).withColumn("roi_start", F.col("roi_start") + reach)
    direct = (F.col("span_start") <= F.col("roi_end")) & (F.col("span_end") >= F.col("roi_start"))
    mapped = F.col("flag").bitwiseAND(4) == 0 if "flag" in near.columns else F.lit(True)
    first = near.where(direct & mapped).groupBy("tid", "roi_start", "roi_end").agg(F.min("pos").alias("_first"))
    return near.join(first, ["tid", "roi_start", "roi_end"]).where(direct | ((F.col("pos") >= F.col("_first")) & (F.col("pos") < F.col("roi_end")))).drop("_first")


def outside(reads: DataFrame, regions: DataFrame, key: str = "qname") -> DataFrame:
    """The reads that overlap no region, by a key that is theirs alone."""
    return reads.join(overlapping(reads.select(key, "tid", "pos", "cigar"), regions).select(key), key, "left_anti")


def capped(pairs: DataFrame, most: int = 1000) -> DataFrame:
    """tid, roi_start, roi_end, n_reads, skipped: a region of more than *most* reads isn't realigned."""
    return pairs.groupBy("tid", "roi_start", "roi_end").agg(F.count("*").alias("n_reads")).withColumn("skipped", F.col("n_reads") > most)


def tiles(contigs: DataFrame) -> DataFrame:
    """tid, tile, text: contigs(tid, seq) in tiles of TILE bases and BEYOND more. Bases are cut as bytes, whose places need no counting."""
    n = F.greatest(F.length("seq"), F.lit(1))
    cut = contigs.select("tid", F.col("seq").cast("binary").alias("seq"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / TILE).cast("int"))).alias("tile"))
    return cut.select("tid", "tile", F.expr(f"substring(seq, tile * {TILE} + 1, {TILE + BEYOND})").cast("string").alias("text"))


def fetched(rows: DataFrame, contigs: DataFrame, start: str, end: str, name: str = "ref") -> DataFrame:
    """rows(tid, ...) with *name*: their contig's bases from column *start* (0 at least) to before *end*; rows of unknown contigs go.

    A join by contig and tile.  The few places that reach beyond a tile and what it has of the next
    are put together from several, once for each.
    """
    # By a shuffle: Spark's estimate knows the files of contigs, not the length of a text, and a broadcast would take all of them through the driver.
    tiled = tiles(contigs).hint("shuffle_hash")
    tile, n = F.floor(F.col(start) / TILE).cast("int"), F.greatest(F.col(end) - F.col(start), F.lit(0))
    placed = rows.withColumns({"tile": tile, "far": F.col(end) > (tile + 1) * TILE + BEYOND})
    near = placed.where(~F.col("far")).join(tiled, ["tid", "tile"]).withColumn(name, F.substring("text", F.col(start) - F.col("tile") * TILE + 1, n))
    place = ["tid", start, end]
    far = placed.where("far").select(*place).distinct()
    parts = far.withColumn("tile", F.explode(F.sequence(F.floor(F.col(start) / TILE).cast("int"), F.floor((F.col(end) - 1) / TILE).cast("int"))))
    # Cut after the join, so that both joins take the same shuffle of tiles.
    parts = parts.join(tiled, ["tid", "tile"]).withColumn("text", F.substring("text", 1, TILE))
    whole = parts.groupBy(*place).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile", "text"))), lambda t: t["text"]), "").alias("text"))
    whole = whole.withColumn(name, F.substring("text", F.col(start) % TILE + 1, n))
    names = [*rows.columns, name]
    return near.select(*names).unionByName(placed.where("far").join(whole, place).select(*names))


def windows(regions: DataFrame, contigs: DataFrame, k: int = 25) -> DataFrame:
    """tid, roi_start, roi_end, lo and hi (where reads count, hi exclusive), ref_start, ref (2k bases on either side, if there)."""
    roi = regions.selectExpr("tid", "start as roi_start", "end as roi_end")
    roi = roi.withColumns({"lo": F.greatest(F.lit(0), F.col("roi_start") - k), "hi": F.col("roi_end") + k, "ref_start": F.greatest(F.lit(0), F.col("roi_start") - 2 * k)})
    return fetched(roi.withColumn("ref_end", F.col("hi") + k), contigs, "ref_start", "ref_end").drop("ref_end")


def chained(pairs: DataFrame, reach: int = 0) -> DataFrame:
    """tid, roi_start, roi_end, chain: regions that reads tie together, in order; chain is the first one's start.

    pairs(tid, roi_start, roi_end, span_start, span_end).  A region's reads reach from the least start to the
    greatest end; one that starts more than *reach* after all earlier reads of its contig have ended begins a chain.
    """
    ends = pairs.groupBy("tid", "roi_start", "roi_end").agg(F.max("span_end").alias("end"))
    return targets.islands(ends.withColumn("start", F.col("roi_start")), reach).select("tid", "roi_start", "roi_end", F.col("island").alias("chain"))
