"""Operators 6 and 8, the pipeline and the registry."""

import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from haplospark.llm import _common
from haplospark.llm import jaccard_join as jj
from haplospark.llm import queries as q
from haplospark.llm.components import components
from haplospark.llm.topk_search import ORACLE, top_k

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(docs):
    sets, up = [(d, shingles(t)) for d, t in docs], {d: d for d, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    by = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    for i, j in {p for at in by.values() for p in itertools.combinations(at, 2)}:
        a, b = sets[i][1], sets[j][1]
        if 100 * len(a & b) >= 75 * len(a | b):
            x, y = root(sets[i][0]), root(sets[j][0])
            up[max(x, y)] = min(x, y)
    return sorted((d, len(s), root(d)) for d, s in sets)


def made(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(3)) for _ in range(150)]
    docs, base = [], [[r.choice(words) for _ in range(r.randint(1, 90))] for _ in range(30)]
    for b in base:
        for _ in range(r.randint(1, 14)):
            x = list(b)
            for _ in range(r.randint(0, 4)):
                x[r.randrange(len(x))] = r.choice(words)
            text = r.choice([" ", "\n", " \t"]).join(x + (r.choice(base)[:10] if r.random() < 0.2 else []))
            docs.append((len(docs), text.upper() if r.random() < 0.3 else text))
    docs += [(len(docs) + i, t) for i, t in enumerate((None, "", "  \n", " "))]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed, matches, block, hot, filtered, many", [(1, 8, 7500, 1000, 1 << 22, 1024), (2, 4, 7, 3, 0, 1024), (3, 1, 50, 1, 1 << 22, 1)])
def test_components_against_brute_force(spark, monkeypatch, seed, matches, block, hot, filtered, many):
    """hot: rows from which a key is split; filtered: documents that a filter takes; many: hash ranges from which blocks grow."""
    monkeypatch.setattr(jj, "MOST_MATCHES", matches)
    monkeypatch.setattr(jj, "BLOCK_DOCS", block)
    monkeypatch.setattr(jj, "MOST_FILTERED", filtered)
    monkeypatch.setattr(jj, "MANY_RANGES", many)
    monkeypatch.setattr(_common, "HOT_ROWS", hot)
    docs = made(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("x"), "tokens": F.lit(1)}).repartition(5)
    assert sorted(map(tuple, jj.jaccard_components(df).collect())) == brute(docs)


@pytest.mark.parametrize("bits", [20, 48, 60, 64])
def test_sorted_values_keep_their_marks(bits):
    """Together in one number or not."""
    r = np.random.RandomState(bits)
    values = r.randint(0, 1 << 62, 5000).astype(np.uint64) * np.uint64(4) >> np.uint64(64 - bits)
    values[::3] = values[0]
    marks = r.randint(0, 1 << 16, 5000)
    got = jj._sorted(values, marks, bits, 16)
    assert [*zip(*(x.tolist() for x in got))] == sorted(zip(values.tolist(), marks.tolist()))


def test_real_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(map(tuple, q.op6_jaccard_join(spark, SF).collect())) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark, monkeypatch):
    rows = [(1, "a b c d e f g h", 5), (1, "a b c d e f g h", 5), (2, "a b c d e f g h", 6), (3, "zz", 7), (None, "q", 1), (None, "q", 1), (4, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label long")
    got = sorted(map(tuple, jj.jaccard_components(df).where("doc_id is not null").collect()))
    assert got == [(1, 4, 1), (1, 4, 1), (2, 4, 1), (3, 1, 3), (4, 0, 4)]
    clashing = {c: F.lit(c) for c in ("slot", "word", "mask", "low", "rows", "row", "salt", "component_id", "_word", "_mask", "a.b")}
    for most in (1 << 22, 0):
        monkeypatch.setattr(jj, "MOST_FILTERED", most)
        wide = jj.one_of_each(df.withColumns(clashing))
        assert wide.columns == [*df.columns, *clashing] and sorted((r.doc_id or 0, r.word, r["a.b"], r._mask) for r in wide.collect()) == [(i, "word", "a.b", "_mask") for i in (0, 0, 1, 3, 4)]
    kept = jj.one_of_each(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 3, 4]
    assert jj.jaccard_components(df.limit(0)).collect() == []


def test_links_of_a_busy_id(spark, monkeypatch):
    monkeypatch.setattr(_common, "HOT_ROWS", 5)
    links = spark.createDataFrame([(50, i) for i in range(60, 90)] + [(89, 7), (1, 2)], "a long, b long")
    assert {r.id: r.label for r in components(links).collect()} == {**dict.fromkeys([50, *range(60, 90), 7], 7), 1: 1, 2: 1}


def test_long_chains_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(3, 200), (200, 7), (5, 5)], "a long, b long")
    got = {r.id: r.label for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(100, 161), 100), 3: 3, 200: 3, 7: 3}


def vectors(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([-0.5, 0.25, r.random()]) for _ in range(8)]) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(400, 420)]
    rows += [(450, None), (451, [1.0, None]), (452, [float("nan")] * 8), (500, [float("inf")] * 8), (453, [0.5, 0.5]), (550, [0.1, -0.2]), (7, rows[7][1]), (None, rows[0][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"label": F.lit(1), "score": F.lit("x")}), rows


def test_top_k(spark):
    df, rows = vectors(spark)
    duck = duckdb.connect()
    duck.execute("create table embeddings (vec_id bigint, embedding float[])")
    duck.executemany("insert into embeddings values (?, ?)", rows)
    want = sorted(duck.execute(ORACLE).fetchall())
    got = top_k(df)
    assert sorted(map(tuple, got.collect())) == want and got.where("vec_id = query_id").count() == 0
    assert top_k(df.limit(0)).collect() == []


@pytest.mark.parametrize("most, kind", [(200, 24), (3000, 53), (1 << 28, 63)])
def test_scores_of_tiles_against_brute_force(monkeypatch, most, kind):
    """Sums of 32-bit and 64-bit floats and of longs; queries among the vectors, repeated ids, ties, and scores of earlier chunks."""
    from haplospark.llm import topk_search as ts

    monkeypatch.setattr(ts, "TILE", 7)
    monkeypatch.setattr(ts, "STEP", 2)
    monkeypatch.setattr(ts, "BLOCK", 9)
    r = np.random.RandomState(3)
    v = r.randint(-most, most + 1, (300, 40))
    v[100:140] = v[60]
    ids = np.sort(r.choice(280, 300))
    asked = np.append(np.arange(0, 300, 11), [61, 101])
    scores = v[asked] @ v.T
    assert 2**kind > np.abs(scores).max() and (kind == 24 or np.abs(scores).max() > 2**24)
    kth = np.where(np.arange(len(asked)) % 3 == 0, np.sort(scores, 1)[:, -4], ts.NEVER)
    got = [(int(q), int(i), int(s)) for q, i, s in zip(*ts.Blocks(ids, v).search(ids[asked], v[asked], kth, 5))]
    want = []
    for q, row in enumerate(scores):
        own = sorted((-int(s), int(i)) for s, i in zip(row, ids) if i != ids[asked[q]])[:5]
        want += [(q, i, -s) for s, i in own if -s >= kth[q]]
    assert sorted(got) == sorted(want)


def test_top_k_of_tables(spark):
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert sorted(map(tuple, q.op8_topk_search(spark, SF).collect())) == sorted(duck.execute(ORACLE).fetchall())


def least_distances(item, text):
    """The edit distance of the item to the best passage that ends at each place of the text, row by row of the whole matrix."""
    codes = np.array([*map(ord, text)])
    at = np.arange(len(codes) + 1)
    row = np.zeros(len(codes) + 1, np.int32)
    for i, c in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (codes != ord(c)), row[1:] + 1)
        row = (np.minimum.accumulate(new - at) + at).astype(np.int32)
    return row


def test_pipeline(spark):
    """Every stage against a plain version of its own: links of whole sets, distances of whole matrices, patterns as they are written."""
    import corpus_pipeline as cp
    from haplospark.llm import language_id, personal_data

    from test_text import brute_personal

    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = {r.doc_id: r for r in cp.run(spark, small).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = language_id.train(docs.where(~language_id.held_out()))
    left = sorted(texts)
    judged = language_id.judged([texts[d] for d in left], model)
    left = [d for d, lang, score, fit in zip(left, *judged) if lang != "und" and score >= 0.5 and fit >= 0.4]
    low = {d: c for d, _, c in brute([(d, texts[d]) for d in left])}
    left = [d for d in left if low[d] == d]
    plain = lambda t: " ".join(t.lower().split())
    joined = [plain(texts[d]) for d in left]
    # A character that no item has keeps passages within one text.
    ends = np.cumsum([len(t) + 500 for t in joined])
    line, dirty = "".join(t + "\0" * 500 for t in joined), set()
    for r in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        item = plain(r.text)
        near = np.flatnonzero(least_distances(item, line)[1:] <= int(0.06 * len(item)))
        dirty |= set(np.searchsorted(ends, near, "right").tolist())
    left = [d for i, d in enumerate(left) if i not in dirty]
    assert sorted(out) == left and dirty
    masked = 0
    for d in left:
        t, spans = texts[d], brute_personal(texts[d])
        free = [s for s in personal_data.trained().spans([t])[0] if not any(a < s[2] and s[0] < b for a, _, b in spans)]
        new = personal_data.mask(t, sorted([*spans, *free]))
        masked += new != t
        assert out[d].text == new and out[d].n_chars == len(new) and out[d].lossless
    assert masked
    assert [n for n, _ in cp.STAGES] == ["language_id", "jaccard_join", "decontamination", "personal_data", "pieces"]
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, small).count() == 0


def test_registry():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {re.match(r"op\d+_|", k)[0] for k in names} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
