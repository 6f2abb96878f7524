"""Target discovery over a stream of reads: support of events by micro-batch, merged when asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from haplospark.operators import targets


def event_counts(reads: DataFrame, min_mapq: int = 10) -> DataFrame:
    """tid, start, end, n: a running count of each event; the state has a row for each distinct event."""
    return targets.indel_events(reads, min_mapq).groupBy("tid", "start", "end").agg(F.count("*").alias("n"))


def write_counts(reads: DataFrame, path: str, checkpoint: str, min_mapq: int = 10) -> StreamingQuery:
    """Writes each micro-batch's own counts below *path* as Parquet; a batch that is run again replaces its part."""

    def put(batch: DataFrame, number: int) -> None:
        event_counts(batch, min_mapq).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def regions(counts: DataFrame, depth: int = 4, gap: int = targets.GAP) -> DataFrame:
    """Regions of the counts written so far."""
    return targets.deep(targets.merged(counts.select("tid", "start", "end", "n"), gap), depth)
