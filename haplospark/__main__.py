"""python -m haplospark targets|realign: the two commands over SAM, BAM or Parquet reads."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, SparkSession

from haplospark import storage
from haplospark.operators import realign, targets
from haplospark.sources import bam, bed, fasta, sam

_LOG = logging.getLogger("haplospark")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="haplospark")
    sub = top.add_subparsers(dest="command", required=True)
    find, change = sub.add_parser("targets", help="find regions around insertions and deletions"), sub.add_parser("realign", help="realign reads around regions")
    for p in (find, change):
        p.add_argument("reads", help="SAM text or BAM, a file or a directory")
        p.add_argument("output", help="- is standard output")
        p.add_argument("-q", type=int, default=10, dest="min_mapq", help="least mapping quality")
        p.add_argument("-d", "--ROIdepth", type=int, default=4, dest="depth", help="least number of events in a region")
        p.add_argument("--quiet", action="count", default=0, help="say less; twice: nothing")
    find.add_argument("-f", dest="reference", help="FASTA; only CRAM needs it, which isn't read here")
    find.add_argument("--inOrder", action="store_true", dest="in_order", help="merge events in the order of the reads, as older results have it")
    change.add_argument("reference", help="FASTA")
    change.add_argument("-l", dest="regions", help="BED of regions; else they are found")
    change.add_argument("-k", type=int, default=25)
    change.add_argument("-D", type=int, default=1000, dest="max_reads", help="most reads of a region")
    change.add_argument("--minKmerCount", type=int, default=4, dest="min_kmer_count")
    change.add_argument("--maxInsert", type=int, default=0, dest="max_insert")
    change.add_argument("--breadth", type=int, default=300)
    change.add_argument("--noCycles", action="store_true", dest="no_cycles")
    change.add_argument("--index", action="store_true", help="a .bai file beside a BAM file")
    change.add_argument("-C", action="store_true", dest="cram", help="CRAM output, which isn't written here")
    change.add_argument("-@", type=int, default=1, dest="threads", help="accepted and without effect: Spark's tasks compress")
    change.add_argument("--nt", type=int, default=1, help="accepted and without effect: Spark's tasks align")
    change.add_argument("--shrink", action="store_true", help="a merged BED region ends where its last member does, as older results have it")
    change.add_argument("--stopAtShort", action="store_true", dest="stop_at_short", help="a path that is too short ends its siblings, as older results have it")
    change.add_argument("--forwardIsTop", action="store_true", dest="forward_is_top", help="an unpaired forward read without XG is of the top strand")
    return top


def _is_bam(path: str) -> bool:
    return path.rstrip("/").endswith(".bam")


def _reads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Reads, contigs and the header's lines."""
    if path.rstrip("/").endswith(".cram"):
        raise SystemExit("CRAM isn't read here: convert it to BAM")
    if _is_bam(path):
        return bam.read(spark, path), bam.read_contigs(spark, path), bam.read_header(path)[0]
    contigs = sam.read_contigs(spark, path)
    return sam.read(spark, path, contigs), contigs, sam.read_header(spark, path)


def _printed(lines: DataFrame) -> None:
    """Rows of one text column, partition by partition."""
    for row in lines.toLocalIterator():
        sys.stdout.write(f"{row[0]}\n")
    sys.stdout.flush()


def _write(spark: SparkSession, out: DataFrame, contigs: DataFrame, header: list[str], path: str, index: bool) -> None:
    if path == "-":
        _printed(sam.lines(out, contigs, header))
    elif _is_bam(path):
        folder = storage.scratch(spark, "bam").removeprefix("file:")
        bam.write(out, folder, header, index)
        bam.merged(folder, path, index)
    else:
        sam.write(out, contigs, path, header)


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    logging.basicConfig(stream=sys.stderr, format="%(message)s")
    _LOG.setLevel((logging.INFO, logging.WARNING)[a.quiet] if a.quiet < 2 else logging.ERROR)
    if a.command == "realign" and a.cram:
        raise SystemExit("CRAM isn't written here: write BAM and convert it")
    spark = SparkSession.builder.appName("haplospark").getOrCreate()
    reads, contigs, header = _reads(spark, a.reads)
    if a.command == "targets":
        found = targets.deep(targets.merged_in_order(targets.in_order(reads, a.min_mapq)), a.depth) if a.in_order else targets.discover(reads, a.min_mapq, a.depth)
        if a.output == "-":
            _printed(bed.lines(found, contigs))
        else:
            bed.write(found, contigs, a.output)
        _LOG.info("targets: done")
        return
    settings = realign.Settings(
        a.k, a.min_mapq, min(max(a.min_kmer_count, 1), 15), a.max_insert, a.breadth, a.no_cycles, a.max_reads,
        single_end_forward_is_top=a.forward_is_top, stop_at_short=a.stop_at_short,
    )
    found = bed.read(spark, a.regions, contigs, settings.size, a.shrink) if a.regions else targets.discover(reads, a.min_mapq, a.depth)
    whole = fasta.with_sequences(contigs, fasta.read(spark, a.reference))
    _write(spark, realign.realign(reads, found, whole, settings), contigs, sam.sorted_header(header), a.output, a.index)
    _LOG.info("realign: done")


if __name__ == "__main__":
    main()
