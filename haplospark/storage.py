"""Intermediate tables in the shared folder of the cluster: they cut the lineage and outlive any executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only where spark.checkpoint.dir is unset and all tasks run on this machine, as in tests.
LOCAL_SCRATCH = "file:/tmp/checkpoints/haplospark"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = LOCAL_SCRATCH
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """*df* written as Parquet and read back."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
