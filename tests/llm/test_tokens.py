"""Operators 1, 2 and 9: token ids, counts, sampled pieces."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from haplospark.llm import _common, token_store
from haplospark.llm._encoder import encoder
from haplospark.llm.piece_sampling import MARK, _sampler, _units, decode, encode, lattice, with_pieces
from haplospark.llm.queries import tokenizer_path
from haplospark.llm.token_counts import piece_count, spliced_ids, token_counts

BPE, PIECES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
PARTS = ["a", "b1", " ", " ", "\n", "\t", " ", "é", "<|endoftext|>", "'s", "!", "\x1c", "  ", "foo", "Bär", "日本", "x" * 40, ".", "\uffff", "\u2581"]


@pytest.fixture
def texts():
    r = random.Random(1)
    return ["".join(r.choice(PARTS) for _ in range(r.choice([0, 3, 12, 90]))) for _ in range(300)] + ["", None, "a", "  "]


@pytest.fixture
def docs(spark, texts):
    df = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (3, texts[3])], "doc_id long, text string")
    return df.withColumns({"n_tokens": F.lit(1), "kind": F.lit("x"), "pieces": F.lit("p")}).repartition(3)


def test_units_equal_the_library(texts):
    units = encoder(BPE)
    for t in texts:
        assert np.frombuffer(units.packed(t or ""), units.dtype).tolist() == units.library.encode(t or "", add_special_tokens=False).ids


def test_splices_equal_the_library(texts):
    library, r = encoder(BPE).library, random.Random(2)
    for t in texts:
        if t:
            assert spliced_ids(library, t, r.choice([5, 20, 64]), r.choice([1, 4, 8])) == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("chunk", [16, 1 << 16])
def test_counts(docs, texts, chunk):
    library = encoder(BPE).library
    got = token_counts(docs, BPE, limit=20, chunk_chars=chunk, overlap_chars=4).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        t = texts[r.doc_id] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 20)
        assert (r.n_chunks > 1) <= (len(t) > chunk) and (r.n_chunks == 0) == (t == "")
    assert sum(r.n_chunks > 1 for r in got) > 20 or chunk > 16


@pytest.mark.parametrize("chunk", [16, 1 << 16])
def test_counts_of_a_piece_model(docs, texts, chunk):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=PIECES)
    for r in token_counts(docs, PIECES, chunk_chars=chunk, overlap_chars=4).collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id] or ""))
    assert piece_count(library, "one two three four five six", 8, 4)[1] > 2


def test_long_documents_are_spliced(spark):
    """The registered query's own parameters send ordinary long documents through chunks."""
    from haplospark.llm.queries import op2_token_counts

    library = encoder(BPE).library
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op2_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert sum(r.n_chunks > 1 for r in got) >= 10
    assert all(r.n_tokens == len(library.encode(docs[r.doc_id], add_special_tokens=False)) for r in got)


def test_store_round_trip(spark, docs, texts):
    library, path = encoder(BPE).library, _common.scratch(spark, "test-store")
    token_store.write_store(docs, BPE, path, mean=16, least=8, most=32)
    rows = sorted([*enumerate(texts), (3, texts[3]), (3, texts[3])], key=lambda x: x[0])
    want, start = [], 0
    for doc_id, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted(tuple(r)[:4] for r in token_store.read_store(spark, path).collect())
    assert got == want
    for r in token_store.read_ids(spark, path).collect():
        ids = np.frombuffer(bytes(r.ids), "<u2").tolist()
        assert ids == [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0]
    chunks = spark.read.parquet(f"{path}/packs").where("kind = 'c'")
    assert chunks.count() == chunks.select("key").distinct().count()


def test_store_finds_damage(spark, docs):
    path = _common.scratch(spark, "test-store")
    token_store.write_store(docs, BPE, path)
    packs = spark.read.parquet(f"{path}/packs")
    bad = packs.withColumn("payload", F.when((F.col("kind") == "c") & (F.length("payload") > 20), F.expr("concat(substring(payload, 1, 2), substring(payload, 1, length(payload) - 2))")).otherwise(F.col("payload")))
    bad.write.parquet(f"{path}-bad/packs")
    for name in ("recipes", "manifest", "head"):
        spark.read.parquet(f"{path}/{name}").write.parquet(f"{path}-bad/{name}")
    with pytest.raises(Exception, match="address"):
        token_store.read_store(spark, f"{path}-bad").collect()


@pytest.mark.parametrize("lost", ["manifest", "recipes", "head"])
def test_store_finds_what_is_missing(spark, docs, lost):
    path = _common.scratch(spark, "test-store")
    token_store.write_store(docs, BPE, path)
    for name in ("packs", "recipes", "manifest", "head"):
        table = spark.read.parquet(f"{path}/{name}")
        if name == lost and name != "head":
            table = table.where(F.col("part") != table.agg(F.min("part")).first()[0])
        (table.limit(0) if name == lost == "head" else table).write.parquet(f"{path}-less/{name}")
    assert token_store.read_store(spark, path).count() == docs.count()
    with pytest.raises(Exception, match="lacks a part|Merkle root|one head"):
        token_store.read_store(spark, f"{path}-less").collect()


def test_store_keeps_its_width(spark):
    path = _common.scratch(spark, "test-store")
    token_store.write_store(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), BPE, path, end_id=7)
    head = spark.read.parquet(f"{path}/head").first()
    assert (head.width, head.end_id, head.n_parts) == (2, 7, 1)
    assert np.frombuffer(bytes(token_store.read_ids(spark, path).first().ids), "<u2")[-1] == 7


def test_store_of_nothing(spark):
    path = _common.scratch(spark, "test-store")
    token_store.write_store(spark.createDataFrame([], "doc_id long, text string"), BPE, path)
    assert token_store.read_store(spark, path).collect() == []


def test_checksums_shift():
    a, b = b"some bytes", b"and some more of them"
    got = token_store.crc_before(np.array([zlib.crc32(a), zlib.crc32(b)]), np.array([len(b), 0]))
    assert int(got[0] ^ got[1]) == zlib.crc32(a + b)


def test_rolling_cuts_follow_content():
    r = np.random.RandomState(3)
    shared = r.randint(0, 50000, 4000).astype("<u2")
    ends = []
    for n in (0, 137):
        ids = np.concatenate([r.randint(0, 50000, n).astype("<u2"), shared])
        offered = np.flatnonzero((token_store.rolling(ids) & np.uint64(63)) == 0) + 1
        cut = token_store.cuts(offered.tolist(), len(ids), 8, 1024)
        assert cut[-1] == len(ids) and all(8 <= b - a <= 1024 for a, b in zip([0, *cut], cut[:-1]))
        ends.append({e - n for e in cut})
    assert len(ends[0] & ends[1]) > 0.8 * len(ends[0])


def test_pieces_come_back(spark, docs, texts):
    out = encode(docs, PIECES).cache()
    assert out.count() == len(texts) + 2 and out.where("not lossless").count() == 0
    for r in decode(out, PIECES).collect():
        assert r.text == texts[r.doc_id]
    again = encode(docs.repartition(7), PIECES)
    key = ("doc_id", "n_pieces", "ids_crc32")
    assert sorted(map(tuple, again.select(*key).collect())) == sorted(map(tuple, out.select(*key).collect()))
    assert encode(docs, PIECES, seed=5).select("ids_crc32").subtract(out.select("ids_crc32")).count() > 0
    assert with_pieces(docs, PIECES).columns == ["doc_id", "text", "n_tokens", "kind", "pieces", "pieces_", "lossless"]
    assert with_pieces(docs, PIECES).where("pieces != 'p' or not lossless").count() == 0
    assert with_pieces(docs.limit(0), PIECES).collect() == []


def test_units_keep_runs_of_spaces():
    assert _units("  a b  c ") == [MARK * 3 + "a", MARK + "b", MARK * 2 + "c", MARK]
    assert _units("") == [] and _units(" ") == [MARK * 2]


def test_samples_follow_the_weights():
    model, sample = lattice(PIECES, 1.0), _sampler(PIECES, 0, 1.0)
    known = {b.decode().replace(" ", MARK): i for i, b in enumerate(model.bytes_of) if i >= 259}

    def ways(u):
        if not u:
            yield (), 0.0
        for n in range(1, len(u) + 1):
            if u[:n] in known:
                for ids, w in ways(u[n:]):
                    yield (known[u[:n]], *ids), w + model.weights[known[u[:n]]]

    every = list(ways(MARK + "there"))
    total, n = sum(math.exp(w) for _, w in every), 20_000
    ids, counts, good = sample(list(range(n)), ["there"] * n)
    ends = np.cumsum(counts)
    seen = Counter(tuple(ids[e - c : e].tolist()) for c, e in zip(counts, ends))
    assert all(good) and max(abs(seen[k] / n - math.exp(w) / total) for k, w in every) < 0.015


def test_rows_do_not_depend_on_their_batch(texts):
    sample, plain = _sampler(PIECES, 3, 1.0), [t or "" for t in texts]
    ids, counts, good = sample(list(range(len(plain))), plain)
    ends = np.cumsum(counts)
    assert all(good)
    for i in range(0, len(plain), 7):
        assert sample([i], [plain[i]])[0].tolist() == ids[ends[i] - counts[i] : ends[i]].tolist()


def test_deep_lattices_are_those_of_shallow_ones(texts):
    model, units = lattice(PIECES, 1.0), sorted({u for t in texts for u in _units(t or "")} | {MARK + "there", MARK + "informational\n" * 20})
    last, begin, share, start, *rest = shallow = model.filtered(units)
    for a, b in zip(shallow, model.filtered(units, deepest=1)):
        assert np.array_equal(a, b)
    ends = np.append(begin[1:], len(share))
    assert all((np.diff(share[a:b]) >= 0).all() and share[b - 1] == 1 << 24 for a, b in zip(begin, ends) if b > a) and len(share) > 2 * len(units)
