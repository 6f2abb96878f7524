"""Target discovery: insertions and deletions of reads, merged into regions of enough support."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haplospark.functions import cigar

GAP = 10


def indel_events(reads: DataFrame, min_mapq: int = 10) -> DataFrame:
    """qname, tid, start, end of each event of reads of that mapping quality; narrow, no shuffle."""
    kept = reads.where(F.col("mapq") >= min_mapq).where(F.col("cigar").rlike("[ID]"))
    return kept.select("qname", "tid", F.explode(cigar.indels(F.col("pos"), F.col("cigar"))).alias("e")).select("qname", "tid", "e.start", "e.end")


@lru_cache(1 << 16)
def _runs(text: str, pos: int) -> list[tuple[int, int]]:
    """cigar.indels of one CIGAR."""
    at, start, width, out = pos, -1, 0, []
    for n, op in (*re.findall("([0-9]+)([MIDNSHP=XB])", text), (0, "")):
        if op in ("I", "D"):
            start, width = start if start >= 0 else at, max(width, int(n))
        else:
            if start >= 0:
                out.append((start, start + width))
            start, width = -1, 0
        if op in ("M", "D", "N", "=", "X"):
            at += int(n)
    return out


def summed_events(reads: DataFrame, min_mapq: int = 10) -> DataFrame:
    """tid, start, end, n: the events of indel_events and how many there are of each; a CIGAR is taken apart once, not once for each read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, shapes = np.asarray(batch.column("pos")).astype(np.int64), batch.column("cigar").dictionary_encode()
            code, texts = np.asarray(shapes.indices), shapes.dictionary.to_pylist()
            # Reads before the contig, if any, are taken one by one.
            early = np.flatnonzero(pos < 0)
            found = [_runs(x, 0) for x in texts] + [_runs(texts[code[i]], int(pos[i])) for i in early.tolist()]
            code = code.astype(np.int64)
            code[early], base = len(texts) + np.arange(len(early)), np.maximum(pos, 0)
            many = np.array([len(x) for x in found], np.int64)
            events = np.array([e for x in found for e in x], np.int64).reshape(-1, 2)
            n = many[code]
            row = np.repeat(np.arange(len(code)), n)
            own = events[np.arange(len(row)) + np.repeat((np.cumsum(many) - many)[code] - (np.cumsum(n) - n), n)] + base[row][:, None]
            yield pa.RecordBatch.from_arrays([batch.column("tid").take(pa.array(row)), *(pa.array(own[:, i].astype(np.int32)) for i in range(2))], ["tid", "start", "end"])

    kept = reads.where(F.col("mapq") >= min_mapq).where(F.col("cigar").contains("I") | F.col("cigar").contains("D")).where("tid is not null and pos is not null").select("tid", F.col("pos").cast("int").alias("pos"), "cigar")
    found = kept.mapInArrow(run, f"tid {reads.schema['tid'].dataType.simpleString()}, start int, end int")
    return found.groupBy("tid", "start", "end").agg(F.count("*").alias("n"))


def merged(events: DataFrame, gap: int = GAP) -> DataFrame:
    """tid, start, end, n: events of a contig whose gaps are *gap* at most become one region.

    Equal events are summed first, in the map side of the shuffle, so that what a window sorts are
    distinct intervals: a hot site is one row, and the order of the window has no ties.
    """
    unit = events.groupBy("tid", "start", "end").agg(F.count("*").alias("n") if "n" not in events.columns else F.sum("n").alias("n"))
    return merged_units(unit, gap)


def merged_units(unit: DataFrame, gap: int = GAP) -> DataFrame:
    """merged of events that are summed already: each interval of a contig is one row."""
    regions = islands(unit, gap)
    return regions.groupBy("tid", "island").agg(F.max("end").alias("end"), F.sum("n").alias("n")).select("tid", F.col("island").alias("start"), "end", "n")


def islands(unit: DataFrame, gap: int) -> DataFrame:
    """unit(tid, start, end, ...) with island: the start of the first of the intervals that each is tied to by gaps of *gap* at most.

    Contigs are cut into stretches of STRETCH bases for the running maxima; ends of earlier stretches come from one
    row for each stretch.
    """
    unit = unit.withColumn("stretch", F.expr(f"start div {STRETCH}"))
    ends = unit.groupBy("tid", "stretch").agg(F.max("end").alias("last"))
    before = Window.partitionBy("tid").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("tid", "stretch", F.max("last").over(before).alias("carried"))
    order = Window.partitionBy("tid", "stretch").orderBy("start", "end")
    reach = F.greatest("carried", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    flagged = unit.join(ends, ["tid", "stretch"]).withColumn("reach", reach)
    flagged = flagged.withColumn("opens", F.when(F.col("reach").isNull() | (F.col("start") - F.col("reach") > gap), F.col("start")))
    # The island of an interval is the last start at or before it that opens one, in this stretch or an earlier one.
    opened = flagged.groupBy("tid", "stretch").agg(F.max("opens").alias("last_open"))
    opened = opened.select("tid", "stretch", F.last("last_open", ignorenulls=True).over(before).alias("open_before"))
    island = F.coalesce(F.last("opens", ignorenulls=True).over(order), F.col("open_before"))
    return flagged.join(opened, ["tid", "stretch"]).withColumn("island", island).drop("stretch", "carried", "reach", "opens", "open_before")


STRETCH = 1 << 20


def deep(regions: DataFrame, depth: int = 4) -> DataFrame:
    """The regions of *depth* events or more."""
    return regions.where(F.col("n") >= depth)


def discover(reads: DataFrame, min_mapq: int = 10, depth: int = 4, gap: int = GAP) -> DataFrame:
    """tid, start, end, n of the regions to realign."""
    return deep(merged(indel_events(reads, min_mapq), gap), depth)


def bed_merged(regions: DataFrame, k: int = 25, shrink: bool = False) -> DataFrame:
    """tid, start, end: regions of a list whose gap to the one before is below 2k become one.

    shrink: a merged region ends where its last member does, even if an earlier one goes further, as
    older results have it; members are then taken in order of start, one contig in a task.
    """
    if shrink:

        def one(rows: pa.Table) -> pa.Table:
            out: list[list[int]] = []
            for r in rows.sort_by([("start", "ascending"), ("end", "ascending")]).to_pylist():
                if out and out[-1][2] + 2 * k > r["start"]:
                    out[-1][2] = r["end"]
                else:
                    out.append([r["tid"], r["start"], r["end"]])
            return pa.table([pa.array(x, pa.int32()) for x in zip(*out)], ["tid", "start", "end"])

        return regions.selectExpr("cast(tid as int) tid", "cast(start as int) start", "cast(end as int) end").groupBy("tid").applyInArrow(one, "tid int, start int, end int")
    return merged(regions.select("tid", "start", "end"), 2 * k - 1).select("tid", "start", "end")


def in_order(reads: DataFrame, min_mapq: int = 10) -> DataFrame:
    """The events with ``at``, the place of each in the reads as they are scanned; for reads straight from a file."""
    return indel_events(reads, min_mapq).withColumn("at", F.monotonically_increasing_id())


def merged_in_order(events: DataFrame, gap: int = GAP) -> DataFrame:
    """tid, start, end, n as an online merge in the order of the column ``at`` gives them.

    An event joins the region nearest to the right end that it is within *gap* of; that one then absorbs
    those it reaches to its right; a last sweep joins neighbours without moving starts.  For events
    in order of start this equals ``merged``.  A contig is a task's group, so this is for comparison with older results.
    """

    def one(rows: pa.Table) -> pa.Table:
        held: list[list[int]] = []
        for r in rows.sort_by("at").to_pylist():
            start, end = r["start"], r["end"]
            i = next((i for i in range(len(held) - 1, -1, -1) if held[i][0] - end <= gap and start - held[i][1] <= gap), None)
            if i is None:
                place = next((i for i, x in enumerate(held) if x[0] > start), len(held))
                held.insert(place, [start, end, 1])
                continue
            own = held[i]
            own[0], own[1], own[2] = min(own[0], start), max(own[1], end), own[2] + 1
            while i + 1 < len(held) and held[i + 1][0] - own[1] <= gap:
                own[1], own[2] = max(own[1], held[i + 1][1]), own[2] + held[i + 1][2]
                del held[i + 1]
        i = 0
        while i + 1 < len(held):
            if held[i + 1][0] - held[i][1] <= gap:
                held[i][1], held[i][2] = held[i + 1][1], held[i][2] + held[i + 1][2]
                del held[i + 1]
            else:
                i += 1
        tid = rows.column("tid")[0].as_py()
        return pa.table([pa.array([tid] * len(held), pa.int32()), *(pa.array([x[j] for x in held], t) for j, t in ((0, pa.int32()), (1, pa.int32()), (2, pa.int64())))], ["tid", "start", "end", "n"])

    return events.selectExpr("cast(tid as int) tid", "cast(start as int) start", "cast(end as int) end", "cast(at as bigint) at").groupBy("tid").applyInArrow(one, "tid int, start int, end int, n bigint")
