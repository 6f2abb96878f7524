"""Operator 2, token counts: huge documents are encoded in overlapping chunks and spliced.

A document above ``chunk_chars`` characters is cut into chunks that overlap.  Both encodings of
an overlap carry offsets.  A common boundary is a character position where both have a token
that starts; it is proven stable if a non-white-space character precedes it and a white-space
one follows (see _encoder: no unit of the splitting pattern spans such a place and none looks
behind it).  Chunks are spliced at the first stable common boundary; without one the overlap is
doubled and the chunk encoded again, until one is found or the chunk reaches the end of the
text.  So counts equal those of one encoding of the whole text, with memory bounded by a chunk.

A sentencepiece model keeps no offsets that both encodings could share, but its pieces and its
normalisation say enough: where no piece goes on from a non-space into a space, a single space
between two ASCII letters or digits ends one piece and begins the next, whatever is around it.
Chunks of such a model meet there, and the overlap in which such a place is looked for is doubled
in the same way.

Nulls count as empty texts, empty texts have no tokens and no chunks; rows are independent, so ties and
repeated rows give repeated results; further columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from haplospark.llm import _common
from haplospark.llm._encoder import encoder

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, n_chunks bigint, n_widened bigint"
_STABLE = re.compile(r"(?<=\S)\s")
_SINGLE_SPACE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
MARK = "\u2581"


def spliced(library, text: str, chunk_chars: int, overlap_chars: int, keep: Callable[[object, int], None]) -> tuple[int, int]:
    """Gives *keep* each chunk's encoding and how many of its tokens count; returns the chunks and how often an overlap was widened."""
    start = chunks = widened = 0  # start: where the chunk's text begins; a stable boundary, or 0
    while True:
        end = min(len(text), start + chunk_chars)
        here = library.encode(text[start:end], add_special_tokens=False)
        overlap = overlap_chars
        while end < len(text):
            low = max(start + 1, end - overlap)
            after = library.encode(text[low : min(len(text), end + overlap)], add_special_tokens=False)
            common = next((m.start() for m in _STABLE.finditer(text, low + 1, end) if _begins(here, m.start() - start) and _begins(after, m.start() - low)), None)
            if common is not None:
                keep(here, here.char_to_token(common - start))
                break
            widened += 1
            if low == start + 1:  # nothing stable in the whole chunk: it grows instead
                end = min(len(text), end + chunk_chars)
                here = library.encode(text[start:end], add_special_tokens=False)
            overlap *= 2
        chunks += 1
        if end == len(text):
            keep(here, len(here))
            return chunks, widened
        start = common


def _begins(encoding, at: int) -> bool:
    """Whether a token starts at a character of an encoded text."""
    token = encoding.char_to_token(at)
    return token is not None and encoding.token_to_chars(token)[0] == at


def spliced_ids(library, text: str, chunk_chars: int, overlap_chars: int) -> list[int]:
    """The ids of *text*, from encodings of overlapping chunks."""
    ids: list[int] = []
    spliced(library, text, chunk_chars, overlap_chars, lambda encoding, n: ids.extend(encoding.ids[:n]))
    return ids


def spliced_count(library, text: str, chunk_chars: int, overlap_chars: int) -> tuple[int, int, int]:
    """Tokens, chunks and widened overlaps of *text*."""
    counts: list[int] = []
    chunks, widened = spliced(library, text, chunk_chars, overlap_chars, lambda _, n: counts.append(n))
    return sum(counts), chunks, widened


def piece_count(model, text: str, chunk_chars: int, overlap_chars: int) -> tuple[int, int, int]:
    """The same of a sentencepiece model whose pieces end before spaces."""
    start = count = chunks = widened = 0
    while True:
        end, overlap = min(len(text), start + chunk_chars), overlap_chars
        while end < len(text) and (place := _SINGLE_SPACE.search(text, max(start + 1, end - overlap), end)) is None:
            widened += 1
            if end - overlap <= start + 1:
                end = min(len(text), end + chunk_chars)
            overlap *= 2
        stop = len(text) if end == len(text) else place.start()
        count, chunks = count + len(model.encode(text[start:stop])), chunks + 1
        if stop == len(text):
            return count, chunks, widened
        start = stop + 1  # the model puts a space before a text, which is the one left out


def token_counts(docs: DataFrame, path: str, limit: int = 512, chunk_chars: int = 4096, overlap_chars: int = 128, column: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), n_chunks and n_widened of each row of docs(doc_id, column).

    *path*: a .json file of the tokenizers library, or a .model file of sentencepiece.  Texts of one
    chunk go through the cache of units in _encoder, whose ids are the library's.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            library = SentencePieceProcessor(model_file=path)
            # A model with a piece across a space, or without the space before a text, has no such places.
            bound = not any(MARK in library.id_to_piece(i).lstrip(MARK) for i in range(library.get_piece_size())) and library.encode("a b") == library.encode("a") + library.encode("b")
            one = lambda t: piece_count(library, t, chunk_chars if bound else len(t), overlap_chars)
        else:
            units = encoder(path)
            one = lambda t: (units.count(t), 1, 0) if len(t) <= chunk_chars else spliced_count(units.library, t, chunk_chars, overlap_chars)
        for batch in _common.pieces(batches, 4096, 16 << 20):
            texts = batch.column("text").to_pylist()
            found = [one(t) if t else (0, 0, 0) for t in texts]
            n, chunks, widened = ([f[i] for f in found] for i in range(3))
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(chunks, pa.int64()), pa.array(widened, pa.int64())], [x.split()[0] for x in SCHEMA.split(", ")])

    return _common.bounded(docs).selectExpr("cast(doc_id as bigint) doc_id", f"`{column}` as text").mapInArrow(count, SCHEMA)
