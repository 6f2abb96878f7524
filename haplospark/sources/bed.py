"""BED files: regions by contig name, tab separated, without header; gz is read as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haplospark.operators import targets


def read(spark: SparkSession, path: str, contigs: DataFrame, k: int | None = None, shrink: bool = False) -> DataFrame:
    """tid, start, end of the first three columns; regions of unknown contigs go. With k, those closer than 2k are merged."""
    rows = spark.read.csv(path, sep="\t", schema="name string, start int, end int", comment=None)
    found = rows.join(contigs.select("tid", "name"), "name").select("tid", "start", "end")
    return targets.bed_merged(found, k, shrink) if k else found


def _named(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    return regions.join(contigs.select("tid", "name"), "tid").orderBy("tid", "start", "end").select("name", "start", "end")


def lines(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    """The lines of write."""
    return _named(regions, contigs).selectExpr("concat_ws('\t', name, start, end) as value")


def write(regions: DataFrame, contigs: DataFrame, path: str) -> None:
    """name, start, end in order of contig and start."""
    _named(regions, contigs).write.mode("overwrite").csv(path, sep="\t")
