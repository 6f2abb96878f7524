"""Operator 4, quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are ordered whole numbers; here 0 to 2, a point each for good quality and for not being toxic.
One weight vector over hashed words (DIM buckets, counts damped by log1p) is shared by all
thresholds: P(grade > k) = 1 / (1 + exp(threshold k - x.w)), with rising thresholds.  It is fitted by
gradient steps in numpy on a sample of about ``most_rows`` labelled rows drawn by a hash of doc_id (the
documented bound of training; the sample's features are at most DIM numbers a row); buckets of
fewer than LEAST_ROWS of them get no weight.  It scores whole texts in Arrow batches with the weights broadcast.

Labels with a null are left out; of several labels of one document the least grade counts, and of
repeated rows of it the one with the least features, so that rows for training are no more than documents.  Null and empty texts
have no features and get the thresholds' own distribution.  Repeated rows give
repeated results.  Further columns are ignored.  An empty table gives an empty result; without
labels every grade is as likely as any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplospark.llm import _common
from haplospark.llm.shingles import word_hashes

DIM = 1 << 18
LEAST_ROWS = 5
GRADES = 3
SCHEMA = "doc_id bigint, expected_grade double, p_top double, selected boolean"


class Model(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of the features of the texts; equal buckets of a row are one entry."""
    words, n = word_hashes(texts)
    own = np.repeat(np.arange(len(n)), n)
    key, count = np.unique(own * DIM + (words >> np.uint64(65 - DIM.bit_length())).astype(np.int64), return_counts=True)
    return key // DIM, key % DIM, np.log1p(count)


def chances(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade > k) for each score, a column for each threshold."""
    return 1 / (1 + np.exp(np.clip(thresholds[None] - score[:, None], -500, 500)))


def fit(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, grade: np.ndarray, steps: int = 300, rate: float = 0.1, ridge: float = 1e-3) -> Model:
    """Maximum likelihood with a ridge, by Adam; later thresholds are the first plus positive gaps, so their order holds."""
    n, levels = len(grade), GRADES - 1
    common = np.bincount(bucket, minlength=DIM)[bucket] >= LEAST_ROWS
    row, bucket, value = row[common], bucket[common], value[common]
    share = np.array([(grade > k).mean() for k in range(levels)]).clip(0.5 / (n + 1), 1 - 0.5 / (n + 1))
    start = np.maximum.accumulate(-np.log(share / (1 - share)))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    p = [np.zeros(DIM), start[:1].copy(), gaps]
    mean, square = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    place = np.arange(n)
    for step in range(1, steps + 1):
        thresholds = p[1][0] + np.append(0, np.cumsum(np.exp(p[2])))
        above = chances(np.bincount(row, p[0][bucket] * value, n), thresholds)
        high, low = np.hstack([np.ones((n, 1)), above]), np.hstack([above, np.zeros((n, 1))])
        chance = np.maximum(high[place, grade] - low[place, grade], 1e-12)
        slope_high, slope_low = high[place, grade] * (1 - high[place, grade]), low[place, grade] * (1 - low[place, grade])
        by_score = (slope_high - slope_low) / chance / n
        by_threshold = np.zeros(levels + 2)
        np.add.at(by_threshold, grade, -slope_high / chance / n)
        np.add.at(by_threshold, grade + 1, slope_low / chance / n)
        by_threshold = by_threshold[1:-1]
        tails = np.cumsum(by_threshold[::-1])[::-1]
        slopes = [np.bincount(bucket, by_score[row] * value, DIM) - ridge * p[0], tails[:1], tails[1:] * np.exp(p[2])]
        for x, g, m, s in zip(p, slopes, mean, square):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Model(p[0], p[1][0] + np.append(0, np.cumsum(np.exp(p[2]))))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 6000) -> Model:
    """Fits docs(doc_id, text) that labels(doc_id, quality, toxic) cover."""
    graded = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min(F.expr("quality + 1 - toxic")).cast("int").alias("grade"))
    n = graded.count()
    if not n:
        return Model(np.zeros(DIM), np.log(np.arange(1, GRADES) / np.arange(GRADES - 1, 0, -1)))
    # The bound on these rows makes the broadcast safe: about most_rows ids.
    graded = graded.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (1 << 20) * most_rows / n)
    sample = docs.select("doc_id", "text").join(F.broadcast(graded), "doc_id")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _common.pieces(iter([batch]), 4096, 2 << 20):
                row, bucket, value = features(part.column("text").to_pylist())
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                packed = [(bucket[a:b].astype("<u4").tobytes(), value[a:b].astype("<f4").tobytes()) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("grade"), *(pa.array(x, pa.binary()) for x in zip(*packed))], ["doc_id", "grade", "bucket", "value"])

    found = sample.mapInArrow(sparse, "doc_id bigint, grade int, bucket binary, value binary")
    rows = sorted(found.groupBy("doc_id").agg(F.min(F.struct("grade", "bucket", "value")).alias("r")).select("doc_id", "r.*").collect())
    if not rows:
        return Model(np.zeros(DIM), np.log(np.arange(1, GRADES) / np.arange(GRADES - 1, 0, -1)))
    size = [len(r.bucket) // 4 for r in rows]
    flat = lambda k, t: np.frombuffer(b"".join(r[k] for r in rows), t)
    return fit(np.repeat(np.arange(len(rows)), size), flat("bucket", "<u4").astype(np.int64), flat("value", "<f4").astype(float), np.array([r.grade for r in rows]))


def predict(docs: DataFrame, model: Model, least: float = 0.5, column: str = "text") -> DataFrame:
    """doc_id, expected_grade, p_top (of the highest grade) and selected (p_top >= least) of docs(doc_id, column)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = shared.value
        for batch in _common.pieces(batches, 4096, 2 << 20):
            row, bucket, value = features(batch.column("text").to_pylist())
            above = chances(np.bincount(row, weights[bucket] * value, batch.num_rows), thresholds)
            top = above[:, -1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(above.sum(1)), pa.array(top), pa.array(top >= least)], [x.split()[0] for x in SCHEMA.split(", ")])

    return _common.bounded(docs).selectExpr("cast(doc_id as bigint) doc_id", f"`{column}` as text").mapInArrow(run, SCHEMA)


def quality(docs: DataFrame, labels: DataFrame, most_rows: int = 6000, least: float = 0.5) -> DataFrame:
    return predict(docs, train(docs, labels, most_rows), least)
