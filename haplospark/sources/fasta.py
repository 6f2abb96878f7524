"""FASTA files as tables of contigs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """name (up to the first white space) and seq (lines joined) of each record; a record is a row of the scan."""
    rows = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    parts = F.split(F.col("value"), "\r?\n", 2)
    return rows.select(F.regexp_extract(parts[0], r"^(\S+)", 1).alias("name"), F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), r"\s", "").alias("seq"))


def with_sequences(contigs: DataFrame, fasta: DataFrame) -> DataFrame:
    """contigs(tid, name, ...) with seq, by name whatever the order of the file; contigs without one have null."""
    return contigs.drop("seq").join(fasta.select("name", "seq"), "name", "left")
