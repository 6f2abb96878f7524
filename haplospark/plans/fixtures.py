"""Reads and contigs derived by rule from the tables supplier and lineitem, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tid, name, seq: 2,048 bases for each supplier, from the digits of md5 sums."""
    digits = "array_join(transform(sequence(0, 63), i -> md5(concat(s_suppkey, ':', i))), '')"
    # Suppliers are one small file, of which one task would make all bases, while others wait.
    dealt = table(spark, sf_dir, "supplier").select("s_suppkey").repartition(spark.sparkContext.defaultParallelism)
    return dealt.selectExpr("cast(s_suppkey as int) tid", "concat('c', s_suppkey) name", f"translate({digits}, '0123456789abcdef', 'ACGTACGTACGTACGT') seq")


def reads(spark: SparkSession, sf_dir: str, spacing: int = 128) -> DataFrame:
    """A read of 60 bases for each line item: plain, or with an insertion, a deletion or a clipped insertion at a site."""
    items = table(spark, sf_dir, "lineitem").selectExpr(
        "concat(l_orderkey, '.', l_linenumber, '.', l_partkey, '.', l_suppkey) qname",
        "if(l_linestatus = 'O', 16, 0) flag", "cast(l_suppkey as int) tid",
        f"cast(100 + {spacing} * (l_partkey % 14) as int) site", "cast(l_partkey % 3 as int) kind", "cast(10 + l_orderkey % 41 as int) o",
        "cast(l_quantity as int) mapq", "if(l_returnflag = 'R', 'GA', 'CT') xg", "l_linenumber > 4 plain",
    )
    # By a shuffle: Spark takes a contig for a few bytes and would send all of them to the driver and to every executor.
    # Bases are cut as bytes, whose places need no counting.
    whole = contigs(spark, sf_dir).select("tid", F.col("seq").cast("binary").alias("contig")).hint("shuffle_hash")
    placed = items.withColumn("pos", F.expr("site - o")).join(whole, "tid")
    shape = "case when plain then '60M' when kind = 0 then concat(o, 'M4I', 56 - o, 'M') when kind = 1 then concat(o, 'M3D', 60 - o, 'M') else concat(o, 'M', 60 - o, 'S') end"
    bases = """case when plain then substring(contig, pos + 1, 60)
        when kind = 1 then concat(substring(contig, pos + 1, o), substring(contig, site + 4, 60 - o))
        else concat(substring(contig, pos + 1, o), cast('CGCG' as binary), substring(contig, site + 1, 56 - o)) end"""
    return placed.selectExpr("qname", "flag", "tid", "pos", "mapq", f"{shape} cigar", f"cast({bases} as string) seq", "cast(null as string) qual", "xg")
