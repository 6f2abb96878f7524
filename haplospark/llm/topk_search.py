"""Operator 8, exact top-k search: block-at-a-time pruning over integer vectors.

Vectors become floor(256 x) for each component x.  Rows are packed, in ranges of vec_id, into chunks of CHUNK
vectors, and a chunk into blocks of BLOCK; a block's summary is the greatest and the least value of each
component (the terms of the inner product), its forward index the vectors themselves.  Each chunk
of queries meets each chunk of vectors in one task step: blocks are ordered by the sum of the terms'
greatest contributions, the greatest of a tile of queries, and scored in that order, some blocks and queries in one
product; a block is left out where the bound is below the k-th score so far (an equal bound may still hold a smaller id).  A task keeps the k-th scores of
the chunk of queries it is at, so later chunks of vectors start from them.

Ties go to the smaller vec_id.  Rows without an id, and vectors that are null, empty or hold a null
or non-finite component, take no part; vectors of another length than the query's are no candidates.  Repeated rows are candidates each; a
repeated query gives its results once.  Further columns are ignored; empty tables give none.
Scores, and the sums of greatest contributions above them, must fit a long: components below 2**20 in
absolute value and fewer than 2**22 of them do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haplospark.llm import _common

CHUNK, QUERIES, BLOCK = 8192, 4096, 128
#: Queries and blocks of one product.
TILE, STEP = 256, 16
#: Below any score.
NEVER = np.iinfo(np.int64).min
_CHUNKS = "chunk bigint, dim int, n int, ids binary, vectors binary"
_ROWS = "query_id bigint, twin bigint, vec_id bigint, score bigint"


def _whole(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, ids and integer vectors of a batch's valid rows."""
    ids, lists = batch.column("vec_id"), batch.column("embedding")
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # of valid rows; null components are not finite
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    usable = (sizes > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
    odd = np.flatnonzero(~np.isfinite(values))
    usable[np.searchsorted(starts + sizes, odd, "right")] = False
    for dim in np.unique(sizes[usable]).tolist():
        at = np.flatnonzero(usable & (sizes == dim))
        vectors = values.reshape(-1, dim)[at] if len(values) == dim * len(sizes) else values[starts[at][:, None] + np.arange(dim)]
        yield dim, ids.take(pa.array(at)).to_numpy().astype(np.int64), np.floor(256 * vectors).astype(np.int64)


def _narrow(vectors: np.ndarray) -> bytes:
    """The integers in as few bytes each as hold all of them."""
    low, high = (int(f(initial=0)) for f in (vectors.min, vectors.max))
    return vectors.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)).tobytes()


def _wide(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // (n * dim)}").reshape(n, dim).astype(np.int64)


def _chunks(rows: DataFrame, size: int) -> DataFrame:
    """rows(vec_id, embedding) in packed chunks of vectors of one length, in ranges of vec_id."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for dim, ids, vectors in _whole(batch):
                own = held.setdefault(dim, [])
                own.append((ids, vectors))
                while sum(len(i) for i, _ in own) >= size:
                    ids, vectors = (np.concatenate(x) for x in zip(*own))
                    own[:] = [(ids[size:], vectors[size:])]
                    yield _chunk(dim, ids[:size], vectors[:size])
        for dim, own in held.items():
            if sum(len(i) for i, _ in own):
                yield _chunk(dim, *(np.concatenate(x) for x in zip(*own)))

    return rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id").mapInArrow(pack, _CHUNKS)


def _chunk(dim: int, ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"chunk": int(ids[0]), "dim": dim, "n": len(ids), "ids": ids.tobytes(), "vectors": _narrow(vectors)}], pa.schema([("chunk", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())]))


class Blocks:
    """A chunk of vectors with its blocks' summaries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        edges = np.arange(0, len(ids), BLOCK)
        self.high, self.low = np.maximum.reduceat(vectors, edges), np.minimum.reduceat(vectors, edges)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of queries, and ids and scores of their best k rows here that reach kth."""
        dim = max(1, queries.shape[1])
        most = float(np.abs(queries).max(initial=0)) * float(max(np.abs(self.high).max(initial=0), np.abs(self.low).max(initial=0))) * dim
        # Whole numbers up to these are exact, in any order of the sum.
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
        vectors, queries = self.vectors.astype(kind), queries.astype(kind)
        bounds = np.maximum(queries, 0) @ self.high.astype(kind).T + np.minimum(queries, 0) @ self.low.astype(kind).T
        parts = [self._some(vectors, query_ids[a : a + TILE], queries[a : a + TILE], bounds[a : a + TILE], kth[a : a + TILE], k) for a in range(0, len(queries), TILE)]
        found = [np.concatenate(x) for x in zip(*((q + TILE * i, *rest) for i, (q, *rest) in enumerate(parts)))]
        return found[0], found[1], found[2]

    def _some(self, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """search for a tile of queries, which meet some blocks in one product: those that may reach the k-th score of one of them at least."""
        n, score_kind = len(queries), bounds.dtype  # a k-th score that it can't hold is above all scores here, and stays so
        best = np.full((n, k), NEVER)  # scores; kth holds what earlier chunks have
        least = kth.copy()
        found: list[list[np.ndarray]] = [[], [], []]
        order = np.argsort(-bounds.max(0), kind="stable")
        for step in range(0, len(order), STEP):
            blocks = order[step : step + STEP]
            enough = least.astype(score_kind)[:, None]
            reach = bounds[:, blocks] >= enough
            if not reach.any():
                continue
            blocks, own = blocks[reach.any(0)], np.flatnonzero(reach.any(1))
            rows = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            rows = rows[rows < len(self.ids)]
            score = queries[own] @ vectors[rows].T
            keep = score >= enough[own]
            if len(rows) > k:
                # Before anything is known of a query, what this step gives bounds it; one of the rows may be the query itself.
                fresh = np.flatnonzero(least[own] == NEVER)
                if len(fresh):
                    at = min(len(rows), k + int((self.ids[rows][None] == query_ids[own[fresh]][:, None]).sum(1).max()))
                    keep[fresh] = score[fresh] >= -np.partition(-score[fresh], at - 1, 1)[:, at - 1 : at]
            q, at = np.nonzero(keep)
            s, q, ids = score[q, at].astype(np.int64), own[q], self.ids[rows[at]]
            other = ids != query_ids[q]
            q, ids, s = q[other], ids[other], s[other]
            if not len(q):
                continue
            for column, x in zip(found, (q, ids, s)):
                column.append(x)
            of, every = np.append(np.repeat(np.arange(n), k), q), np.append(best.ravel(), s)
            ranked = np.lexsort((every, of))
            best = every[ranked[np.cumsum(np.bincount(of, minlength=n))[:, None] - np.arange(1, k + 1)]]
            least = np.maximum(kth, best[:, -1])
        if not found[0]:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, ids, s = (np.concatenate(x) for x in found)
        ranked = np.lexsort((ids, -s, q))
        ranked = ranked[s[ranked] >= least[q[ranked]]]
        q, ids, s = q[ranked], ids[ranked], s[ranked]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        return q[place < k], ids[place < k], s[place < k]


def top_k(vectors: DataFrame, is_query: str = "vec_id % 50 = 0", k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each query, the rows of vectors(vec_id, embedding) where *is_query* holds."""
    rows = vectors.selectExpr("cast(vec_id as bigint) vec_id", "embedding").where("vec_id is not null and embedding is not null")
    corpus = _common.stored(_chunks(rows, CHUNK), "vectors")
    queries = _common.stored(_chunks(rows.where(is_query).dropDuplicates(["vec_id", "embedding"]), QUERIES).withColumnRenamed("chunk", "q"), "queries")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept = None, np.zeros((0, k), np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["q_ids"], np.int64)
                own = _wide(r["q_vectors"], len(ids), r["dim"])
                if at != (r["q"], r["dim"], len(ids)):
                    at, kept = (r["q"], r["dim"], len(ids)), np.full((len(ids), k), NEVER)
                blocks = Blocks(np.frombuffer(r["ids"], np.int64), _wide(r["vectors"], r["n"], r["dim"]))
                twins = (own * np.arange(1, r["dim"] + 1) * 0x9E3779B1).sum(1)
                q, best_ids, best = blocks.search(ids, own, kept[:, -1], k)
                of, every = np.append(np.repeat(np.arange(len(ids)), k), q), np.append(kept.ravel(), best)
                ranked = np.lexsort((every, of))
                kept = every[ranked[np.cumsum(np.bincount(of, minlength=len(ids)))[:, None] - np.arange(1, k + 1)]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[q], twins[q], best_ids, best)], [x.split()[0] for x in _ROWS.split(", ")])

    # Each chunk of queries meets each chunk of vectors of its length, a row for either pair, a step of a
    # task. Chunks of vectors are dealt to as many groups as there are shuffle partitions (or chunks, if fewer), queries go to each group.
    groups = max(1, min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), corpus.count()))
    dealt = corpus.withColumn("group", F.pmod(F.xxhash64("chunk"), F.lit(groups)))
    asked = queries.selectExpr("q", "dim", "ids as q_ids", "vectors as q_vectors", f"explode(sequence(0L, {groups - 1}L)) as group")
    # By a shuffle whatever Spark thinks of the sizes, for it doesn't see how often queries are repeated; and queries
    # on the streamed side, so that one chunk of them meets all chunks of vectors before the next one comes.
    steps = asked.hint("merge").join(dealt.hint("merge"), ["dim", "group"]).drop("group")
    found = steps.mapInArrow(meet, _ROWS)
    rank = F.row_number().over(Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).where(f"rank <= {k}")
    return best.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
