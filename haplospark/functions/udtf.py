"""A lateral table function for SQL: SELECT ... FROM reads, LATERAL kmers(seq, 25)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="at int, kmer string")
class Kmers:
    """A row for each k-mer of a text."""

    def eval(self, seq: str, k: int):
        for i in range(len(seq or "") - k + 1):
            yield i, seq[i : i + k]


def register(spark: SparkSession) -> None:
    spark.udtf.register("kmers", Kmers)
