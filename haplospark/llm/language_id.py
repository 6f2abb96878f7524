"""Operator 5, language ID: multinomial naive Bayes over hashed character n-grams.

``train`` counts the n-grams (1 to NGRAM characters, lower-cased, hashed to BUCKETS; whatever stands between letters is
one space) of labelled
rows by language in the executors, sums them there, and brings one number for each language and
bucket to the driver: BUCKETS * 4 bytes a language, whatever the input.  It may fit on a sample of
about ``per_language`` rows of each language, drawn by a hash of doc_id; the bound is that
parameter.  ``predict`` broadcasts the matrix of log probabilities and scores whole texts in numpy
batches; the score is the posterior of the language under equal priors.  A posterior only says which of the learned
languages is likeliest; ``fit`` says whether the text is like it at all: the mean log probability of its
n-grams, on a scale where 1 is what the language gives its own n-grams on average and 0 what
buckets drawn at random would have if all were alike.  Foreign scripts and random letters are below 0 or near it.

A text that is null or has no letter is ``und`` with score and fit 0, and so is every text if nothing was
learned.  Ties go to the first language by name.  Rows are independent: repeated rows give
repeated results.  Further columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplospark.llm import _common

NGRAM = 3
BUCKETS = 1 << 15
#: More labels are an error: the matrix that is broadcast has 128 KB for each.
MOST_LANGUAGES = 500
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, fit double"
_KNOWN = 0x20000  # code points of which each is looked up once; letters beyond are ideographs
_LETTER: list[np.ndarray] = []


class Model(NamedTuple):
    langs: list[str]
    log_p: np.ndarray  # float32, BUCKETS rows, a column for each language
    typical: np.ndarray  # the mean of a language's log probabilities over its own n-grams


def _is_letter(codes: np.ndarray) -> np.ndarray:
    """Letters, and the marks that stand on them."""
    if not _LETTER:
        _LETTER.append(np.array([category(chr(c))[0] in "LM" for c in range(_KNOWN)]))
    return np.where(codes < _KNOWN, _LETTER[0][np.minimum(codes, _KNOWN - 1)], codes < 2 * _KNOWN)


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of all n-grams of the texts, text by text for each n; and the number in each text, a row for each n."""
    texts = [f" {t.lower()} " for t in texts]
    n = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    # Of a run of other characters one space stays; each text begins with one.
    letter, starts = _is_letter(codes), np.cumsum(n) - n
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[starts] = True
    n = np.add.reduceat(keep, starts) if len(n) else n
    codes = np.where(letter, codes, np.uint32(32))[keep].astype(np.uint32)
    first = np.repeat(np.cumsum(n), n) - np.arange(len(codes))  # characters left in the text
    found, counts, h = [], [], np.zeros(len(codes), np.uint32)
    for k in range(1, NGRAM + 1):
        h[: len(codes) - k + 1] = h[: len(codes) - k + 1] * np.uint32(0x01000193) + codes[k - 1 :] * np.uint32(0x9E3779B1)
        inside = h if k == 1 else h[first >= k]
        found.append(((inside ^ inside >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(17)).astype(np.int32))
        counts.append(np.maximum(n - k + 1, 0))
    return found, np.array(counts)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def train(labelled: DataFrame, per_language: int = 4000, alpha: float = 0.5) -> Model:
    """Fits labelled(doc_id, text, lang), rows without text or lang left out."""
    rows = labelled.selectExpr("cast(doc_id as bigint) doc_id", "text", "lang").where("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: lang is no label of languages")
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, per_language / n)]), F.col("lang"))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in _common.pieces(iter([batch]), 2048, 1 << 20):
                langs = np.array(part.column("lang").to_pylist())
                texts = part.column("text").to_pylist()
                for lang in set(langs.tolist()):
                    total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    for found in grams([texts[i] for i in np.flatnonzero(langs == lang)])[0]:
                        total += np.bincount(found, minlength=BUCKETS)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])

    sums = sample.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums.lang.unique())
    counts = np.full((BUCKETS, len(langs)), alpha)
    for k, lang in enumerate(langs):
        own = sums[sums.lang == lang]
        counts[own.bucket.to_numpy(), k] += own.n.to_numpy()
    p = counts / counts.sum(0)
    return Model(langs, np.log(p).astype(np.float32), (p * np.log(p)).sum(0))


def scores(texts: list[str], log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods, a row for each text and a column for each language; and each text's number of n-grams."""
    total = np.zeros((len(texts), log_p.shape[1]))
    found, counts = grams(texts)
    for buckets, n in zip(found, counts):
        full = np.flatnonzero(n)
        if len(full):
            total[full] += np.add.reduceat(log_p[buckets], (np.cumsum(n) - n)[full], axis=0, dtype=np.float64)
    return total, counts.sum(0)


def judged(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and fit of each text."""
    pred, score, fit = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if model.langs and has_letter(t)]
    if known:
        own, n = scores([texts[i] for i in known], model.log_p)
        best = own.argmax(1)
        score[known] = 1 / np.exp(own - own.max(1, keepdims=True)).sum(1)
        none = -np.log(BUCKETS)
        fit[known] = (own.max(1) / n - none) / np.maximum(model.typical[best] - none, 1e-9)
        for i, k in zip(known, best):
            pred[i] = model.langs[k]
    return pred, score, fit


def predict(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and fit of each row of docs(doc_id, column)."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in _common.pieces(batches, 2048, 1 << 20):
            pred, score, fit = judged(batch.column("text").to_pylist(), own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(fit)], ["doc_id", "lang_pred", "score", "fit"])

    return _common.bounded(docs).selectExpr("cast(doc_id as bigint) doc_id", f"`{column}` as text").mapInArrow(assign, "doc_id bigint, lang_pred string, score double, fit double")


def held_out(doc_id: str = "doc_id"):
    """Whether a document is held out from training: a quarter, by the checksum of its id as text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, per_language: int = 4000) -> DataFrame:
    """Learns from the rows that are not held out and predicts all rows."""
    model = train(docs.where(~held_out() & F.col("doc_id").isNotNull()), per_language)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "fit")


def keep_identified(docs: DataFrame, least: float = 0.5, least_fit: float = 0.4, wanted: tuple[str, ...] | None = None, per_language: int = 4000) -> DataFrame:
    """The rows whose language is identified; columns as they are.

    A row goes if its text has no letter, if no language has a posterior of *least*, if the text fits
    the language by less than *least_fit* (0 unrelated, 1 typical), or if *wanted* is given and the language isn't in it.
    """
    model = train(docs.where(~held_out() & F.col("doc_id").isNotNull()), per_language)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in _common.pieces(batches, 2048, 1 << 20):
            pred, score, fit = judged(batch.column("text").to_pylist(), own)
            named = np.array([p != "und" and (wanted is None or p in wanted) for p in pred], bool)
            yield batch.filter(pa.array(named & (score >= least) & (fit >= least_fit)))

    return _common.bounded(docs).mapInArrow(keep, docs.schema)
