"""What the operators of this subpackage share: scratch tables, inputs and array helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplospark.storage import scratch, stored  # noqa: F401

_LIBC = getattr(ctypes.CDLL(None), "malloc_trim", None) and ctypes.CDLL(None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], rows: int, size: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most *rows* rows and about *size* bytes of *column* (one row at least)."""
    for batch in batches:
        released()
        ends = _ends(batch.column(column))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right"))
            hi = min(max(hi, lo + 1), lo + rows, n)
            yield batch.slice(lo, hi - lo)
            lo = hi


#: Rows and bytes of the Arrow batches between the JVM and Python; the bytes matter where texts are long.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """*df*, after its session's Arrow batches were bounded to what the operators here are made for."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def released() -> None:
    """Gives memory that is free back to the system: idle Python workers stay alive beside those of later stages."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _ends(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))


#: A key is hot if it has more rows than this and than a HOT_SHARE-th of all, so there are HOT_SHARE hot keys at most.
HOT_ROWS, HOT_SHARE = 1000, 1000


def hot_keys(df: DataFrame, key: str) -> list[int]:
    """The hot keys among the longs of a column: HOT_SHARE at most, whatever the size of the table."""
    counts = df.groupBy(key).agg(F.count("*").alias("rows"))
    least = max(HOT_ROWS, df.count() // HOT_SHARE)
    return sorted(r[0] for r in counts.where((F.col("rows") > least) & F.col(key).isNotNull()).select(key).collect())


def joined(many: DataFrame, one: DataFrame, key: str, hot: list[int], how: str = "inner", salts: int = 0) -> DataFrame:
    """many joined with one(key, ...), which has a row for each key.

    Rows of hot keys meet a broadcast of HOT_SHARE rows at most; with *salts*, as where rows of *one* are
    large, they are shuffled by key and one of so many salts. The others are shuffled by key.
    """
    if not hot:
        return many.join(one, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    left, right = many.where(is_hot), one.where(is_hot)
    return many.where(~is_hot).join(one.where(~is_hot), key, how).unionByName(salted(left, right, [key], salts, how) if salts else left.join(F.broadcast(right), key, how))


def salted(left: DataFrame, right: DataFrame, keys: list[str], salts: int, how: str = "inner") -> DataFrame:
    """left joined with right, by keys and a salt that left's rows get by their content and right's rows have all of."""
    salt = free_name("salt", left.columns, right.columns)
    dealt = left.withColumn(salt, F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    return dealt.join(right.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))), [*keys, salt], how).drop(salt)


def gathered(batches: Iterator[pa.RecordBatch], rows: int, size: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about *size* bytes of *column*, and *rows* rows at most, put together from smaller ones."""
    held, n, n_bytes = [], 0, 0
    for batch in pieces(batches, rows, size, column):
        own = int(_ends(batch.column(column))[-1]) if batch.num_rows else 0
        if held and (n + batch.num_rows > rows or n_bytes + own > size):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n, n_bytes = [], 0, 0
        if batch.num_rows:
            held, n, n_bytes = [*held, batch], n + batch.num_rows, n_bytes + own
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def free_name(name: str, *taken: list[str]) -> str:
    """*name*, with as many underscores behind it as it takes to be none of the taken ones, in any case of letters."""
    used = {x.lower() for names in taken for x in names}
    while name.lower() in used:
        name += "_"
    return name


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i] + 1, ... of lengths[i] each, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
