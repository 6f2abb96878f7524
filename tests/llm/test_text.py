"""Operators 3, 4, 5, 7 and 10: scans and classifiers."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from haplospark.llm import decontamination as de
from haplospark.llm import language_id as li
from haplospark.llm import personal_data as pd_
from haplospark.llm import quality as qu
from haplospark.llm import secret_scan as se

SF = "/root/testdata/sf0.01"
NONE = [(900, None), (901, ""), (902, "zz"), (902, "zz"), (None, "zz")]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"score": F.lit("x"), "spans": F.lit(1), "lang": F.lit("en")}) if extra else df


# Secrets.

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_secrets(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets(spark):
    r = random.Random(5)
    parts = ["token", "api_key", "APIKEY", "PassWord", ":", "=", " ", "  ", '"', "'", "abc", "abcdef", "é", "😀", "AKIA", "ABCDEFGH12345678", "deadbeef0123", "0123456789abcdef", "x", "."]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 14)))) for i in range(600)] + NONE
    rows += [(903, "key zZ9aK3pQ7xLm2VtB8nRw4 é aB3dE5fG7hJ9kL1mN3pQ5rS7"), (904, "some_long_identifier_name_here getCustomerAccountBalanceValue"), (905, "tokens " * 3000 + "deadbeef" * 4)]
    got = {}
    for x in se.scan(frame(spark, rows)).collect():
        got.setdefault(x.doc_id, x)
    written = lambda spans: ",".join(f"{se.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    assert got[905].n_hex == 1
    for i, t in rows:
        want, x = brute_secrets(t or ""), got[i]
        assert x.base_sha256 == hashlib.sha256(written(want).encode()).hexdigest()
        assert [x.n_assign, x.n_access, x.n_hex] == [sum(s[1] == k for s in want) for k in range(3)]
        assert set(filter(None, written(want).split(","))) <= set(x.spans.split(","))
    assert got[903].spans == "random:4:25,random:28:52" and got[904].spans == ""
    assert se.scan(frame(spark, rows).limit(0)).collect() == []
    # Without samples that teach anything no run is random.
    assert se.scan(frame(spark, rows), spark.createDataFrame([(None, True), ("x", False)], "text string, random boolean")).where("n_random > 0").count() == 0


def plain_models(samples, alpha=0.5):
    """Bigram counts of either kind, by character class, and the log of the ratio of their chances."""
    state = lambda c: se.ALPHABET.find(c) + 1
    counts = {kind: [[alpha] * se.STATES for _ in range(se.STATES)] for kind in (True, False)}
    for text, kind in samples:
        for a, b in zip(text, text[1:]):
            counts[kind][state(a)][state(b)] += 1
    chance = {kind: [[n / sum(row) for n in row] for row in c] for kind, c in counts.items()}
    return lambda run: sum(round(1000 * math.log(chance[True][state(a)][state(b)] / chance[False][state(a)][state(b)])) for a, b in zip(run, run[1:]))


PLANTED_ORDINARY = (
    "abstractRepositoryConfiguration internationalization_of_interfaces kubernetes-ingress-controller HttpServletRequestWrapper characteristically get_next_available_identifier_for_row "
    "UnsupportedOperationException onUserInterfaceLayoutChanged max_concurrent_connections_per_host multi-threaded-scheduler 4785380592391139 20240131235959 2024-01-31-backup "
    "org/apache/spark/sql/catalyst usr/local/share/applications readmeForContributors donaudampfschifffahrt responsabilidades anticonstitutionnellement thisIsAVeryLongVariableName "
    "THIS_IS_A_CONSTANT_VALUE test_secrets_use_no_python DataFrameWriterV2Options build/lib/python3 images/header_background_01 123456789012345 ISO-8859-15-encoding deadline_2023-10-10"
).split()


def test_secrets_models(spark):
    """Against plain Markov models, and on planted keys and identifiers."""
    r = random.Random(3)
    keys = ["".join(r.choice(se.ALPHABET) for _ in range(r.randint(16, 40))) for _ in range(150)]
    keys += [base64.b64encode(r.randbytes(r.randint(15, 30))).decode() for _ in range(100)] + [r.randbytes(r.randint(8, 11)).hex() for _ in range(50)]
    docs = spark.createDataFrame([(i, f"say {x} é 日 {x[:9]}, ok") for i, x in enumerate([*keys, *PLANTED_ORDINARY])], "doc_id long, text string")
    samples = se.labelled_samples(spark).unionAll(se.corpus_samples(spark.read.parquet(f"{SF}/documents.parquet")))
    got = {x.doc_id: x for x in se.scan(docs, samples).collect()}
    ratio = plain_models([tuple(x) for x in samples.collect()])
    for x in docs.collect():
        want = [m for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}", x.text) if (v := ratio(m[0])) >= 12_000 and v >= 450 * (len(m[0]) - 1)]
        assert [s for s in got[x.doc_id].spans.split(",") if s.startswith("random")] == [f"random:{m.start()}:{m.end()}" for m in want] and got[x.doc_id].n_random == len(want)
    found, false = sum(got[i].n_random > 0 for i in range(len(keys))), sum(got[len(keys) + i].n_random > 0 for i in range(len(PLANTED_ORDINARY)))
    assert found >= 0.97 * len(keys) and false <= 1


def test_secrets_of_many_matches(spark):
    text = "token=abcdefg1 é " * 20_000
    x = se.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = ",".join(f"assign:{i * 17}:{i * 17 + 14}" for i in range(20_000))
    assert x.n_assign == 20_000 and x.base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_secrets_use_no_python(spark):
    plan = se.scan(frame(spark, NONE))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow(Eval|Python)|MapIn", plan)


# Personal data.

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_personal(t):
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def test_personal_base():
    r = random.Random(2)
    parts = ["a", "@", "@", ".", "b.c", "%", "-", "1", "23", "456", "255", ".", "+", "+1 ", " ", "(", ")", "0", "4785380592391139", "é", "_"]
    for _ in range(20_000):
        t = "".join(r.choice(parts) for _ in range(r.randint(1, 25)))
        assert pd_.base_spans(t) == brute_personal(t)
    assert pd_.base_spans("1" * 100_000) == [] and pd_.base_spans("a" * 100_000 + "@") == []


def tagged(line):
    """A labelled line's text and spans."""
    plain, spans, at = "", [], 0
    for m in [*pd_._TAGGED.finditer(line), None]:
        plain += line[at : m.start() if m else len(line)]
        if m:
            spans.append((len(plain), pd_.KINDS.index(m[1]), len(plain) + len(m[2])))
            plain, at = plain + m[2], m.end()
    return plain, spans


HELD_OUT = {
    "ssn": ("they wrote {} in the box", "ssn is {} as stated"), "localphone": ("try to phone {} tomorrow", "our desk has {} as number"), "iban": ("send the rent to {} soon", "his iban {} is new"),
    "email": ("please write to {} again", "her address {} is old"), "card": ("the card {} was lost", "charge visa {} twice"), "ip": ("ping {} for once", "traffic from {} grew"), "phone": ("please call {} today", "his mobile {} rang"),
}


def test_field_on_held_out_lines():
    """Recall and precision of spans on other values in other sentences."""
    field, r = pd_.trained(), random.Random(11)
    lines = []
    for line in pd_.made_lines(seed=77, each=1):
        if m := pd_._TAGGED.search(line):
            lines += [c.replace("{}", m[0]) for c in r.sample(HELD_OUT[m[1]], 1)]
        else:
            lines.append(f"{line} and so on")
    hit = found = true = 0
    for line in lines:
        plain, want = tagged(line)
        got = field.spans([plain])[0]
        hit, found, true = hit + len(set(got) & set(want)), found + len(got), true + len(want)
    assert hit >= 0.95 * true and hit >= 0.97 * found and true > 150
    for text, want in (("ring (617) 555-0123 now", "localphone:5:19"), ("number 555-44-3333.", "ssn:7:18"), ("in 1984 and 3 of 7", ""), ("+1 (017) 555-7713", "phone:0:17"), ("pages 100-200-3000", ""), ("ISBN 978-12-1234", ""), ("IBAN DE89370400440532013000", "iban:5:27"), ("ring 020 7946 0958", "localphone:5:18"), ("jane.doe at example dot com", "email:0:27")):
        assert pd_.written(pd_.all_spans([text], field)[0][1]) == want


def best_by_enumeration(field, e):
    k = len(pd_.LABELS)
    score = lambda y: sum(e[i, a] for i, a in enumerate(y)) + sum(field.moves[a, b] for a, b in zip((0, *y), (*y, 0)))
    return max(itertools.product(range(k), repeat=len(e)), key=score)


def test_field_decodes_the_best_labels():
    field, r = pd_.trained(), random.Random(7)
    pool = ["call", "on", "at", "dot", "com", "jane", "123-45-6789", "(212)", "555-0199", "DE89", "3704", "0044", "10.0.0.1", "a.b@c.de", "card", "4111", "2021-05-06", "xyz"]
    chains = [[r.choice(pool) for _ in range(r.randint(1, 3))] for _ in range(120)]
    words, opens = [w for c in chains for w in c], np.array([i == 0 for c in chains for i in range(len(c))])
    e = field.emissions(words, opens)
    got, at = field.decode(e, opens), 0
    for c in chains:
        own = e[at : at + len(c)]
        assert tuple(got[at : at + len(c)]) == best_by_enumeration(field, own)
        alone = field.emissions(c, np.arange(len(c)) == 0)
        assert np.allclose(alone, own)
        at += len(c)


def test_field_expects_what_enumeration_gives():
    r = np.random.RandomState(2)
    e, moves, size = r.randn(3, 3, 3), r.randn(3, 3), np.array([3, 1, 2])
    here, moved = pd_._expected(e, moves, size)
    all_moves = np.zeros((3, 3))
    for c, n in enumerate(size):
        ways = {y: sum(e[c, i, a] for i, a in enumerate(y)) + sum(moves[a, b] for a, b in zip((0, *y), (*y, 0))) for y in itertools.product(range(3), repeat=int(n))}
        total = sum(math.exp(s) for s in ways.values())
        for i in range(n):
            assert np.allclose(here[c, i], [sum(math.exp(s) for y, s in ways.items() if y[i] == a) / total for a in range(3)])
        for y, s in ways.items():
            for a, b in zip((0, *y), (*y, 0)):
                all_moves[a, b] += math.exp(s) / total
    assert np.allclose(moved, all_moves)


def test_field_on_odd_texts():
    field = pd_.trained()
    long = "mm " * 60_000 + "call 555-123-4567 now"
    assert field.spans(["", "...", "\n\n", long]) == [[], [], [], [(180_005, pd_.KINDS.index("localphone"), 180_017)]]
    assert pd_.all_spans([None], field) == [([], [], 0)]
    # A span of the field that meets a base one is counted and left out; equal texts have equal spans.
    (base, spans, n), again = pd_.all_spans(["write to a.b@c.de now", "write to a.b@c.de now"], field)
    assert base == spans == [(9, 0, 17)] and n == 1 and again == (base, spans, n)
    assert pd_.Field(()).spans(["call 555-123-4567"]) == [[]]


def test_personal_query(spark):
    rows = [(1, "é a.b@c.de, 10.0.0.1"), *NONE]
    got = {x.doc_id: x for x in pd_.find(frame(spark, rows)).collect()}
    assert got[1].spans == "email:2:10,ip:12:20" and got[1].n_added == 0 and got[1].base_sha256 == hashlib.sha256(b"email:2:10,ip:12:20").hexdigest() and got[900].spans == ""
    out = pd_.masked(frame(spark, rows).withColumn("n_chars", F.lit(5).cast("long"))).where("doc_id = 1").first()
    assert (out.text, out.n_chars) == ("é [EMAIL], [IP]", 15)
    assert pd_.find(frame(spark, rows).limit(0)).collect() == [] and pd_.masked(frame(spark, rows)).count() == len(rows)


# Decontamination.


def distances(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        cur = [i]
        for j, d in enumerate(t, 1):
            cur.append(min(prev[j - 1] + (c != d), prev[j] + 1, cur[j - 1] + 1))
        prev = cur
    return prev


def test_bit_parallel_distance():
    r = random.Random(1)
    for _ in range(200):
        p, t = ("".join(r.choice("ab c") for _ in range(r.randint(1, n))) for n in (20, 40))
        assert list(de.Myers(p).last_row(t, False)) == distances(p, t)[1:]


def test_origins():
    r = random.Random(1)
    for _ in range(300):
        x = "".join(r.choice("aB \n\tİé") for _ in range(20))
        assert len(de.origins(x)) - 1 == len(de.normalised(x))


def test_matches_against_brute_force():
    r = random.Random(3)
    words = lambda n: " ".join("".join(r.choice("abcdefgé") for _ in range(r.randint(2, 7))) for _ in range(n))
    for _ in range(60):
        item = words(r.randint(1, 40))
        budget, x = int(0.06 * len(item)), list(item)
        for _ in range(r.randint(0, budget + 3)):
            i, o = r.randrange(len(x)), r.random()
            x[i : i + 1] = ["z"] if o < 0.3 else [] if o < 0.6 and len(x) > 1 else ["q", x[i]]
        text = words(30) + "  " + "".join(x).upper() + "\n" + words(20)
        got = list(de.Items([(7, item), (8, None), (9, " ")], 0.06).matches(["zz", None, text]))
        least = min(distances(de.normalised(item), de.normalised(text))[1:])
        assert bool(got) == (least <= budget)
        if got:
            assert got[0][:3] == (2, 7, least)


def test_decontamination_query(spark):
    item = "a passage of the benchmark that nobody should ever train on, whatever it says"
    rows = [(1, "before. " + item.upper() + " after"), (2, "clean text of a passage"), (3, "x " + item.replace("nobody", "nobdy")), *NONE]
    items = spark.createDataFrame([(5, item), (6, None), (7, "")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    for block in (1, 1 << 20):
        got = sorted((x.doc_id, x.item_id, x.distance, x.start_char) for x in de.contaminated(frame(spark, rows), items, block_chars=block).collect())
        assert got == [(1, 5, 0, 8), (3, 5, 1, 2)]
        assert de.keep_uncontaminated(frame(spark, rows), items, block_chars=block).count() == len(rows) - 2
    assert de.contaminated(frame(spark, rows), items.limit(0)).count() == 0


# Language and quality.


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(5000, None, "en"), (5001, "123 ...", "fr"), (5001, "123 ...", "fr"), (None, "x", None)], "doc_id long, text string, lang string")
    got = li.language_id(docs.select("doc_id", "text", "lang").unionAll(extra).withColumn("score", F.lit(1))).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == len(truth) + 4 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and [r.lang_pred for r in got if r.doc_id in (5000, 5001)] == ["und"] * 3
    assert li.language_id(docs.limit(0)).collect() == []
    unlearned = li.language_id(docs.withColumn("lang", F.lit(None).cast("string")).limit(5)).collect()
    assert [r.lang_pred for r in unlearned] == ["und"] * 5
    foreign = ["Η γρήγορη καφέ αλεπού πηδά πάνω από το τεμπέλικο σκυλί", "Быстрая коричневая лиса прыгает через ленивую собаку", "素早い茶色の狐が怠け者の犬を飛び越える", "xkqj zvwq pqxz jjkv wqzx vkjq xzqp", "%%% 12 ??"]
    extra = extra.unionAll(spark.createDataFrame([(6000 + 4 * i, t, None) for i, t in enumerate(foreign)], "doc_id long, text string, lang string"))
    mixed = docs.unionByName(extra, allowMissingColumns=True)
    kept = li.keep_identified(mixed)
    assert kept.columns == docs.columns and kept.where("doc_id >= 5000").count() == 0 and kept.count() >= 0.999 * len(truth)
    assert {r.lang for r in li.keep_identified(docs, wanted=("de", "fr")).groupBy("lang").count().where("count > 3").collect()} == {"de", "fr"}


def plain_grams(text):
    """The n-grams of a text by slicing, hashed with whole numbers."""
    t = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    t = re.sub(" +", " ", t)
    for k in range(1, li.NGRAM + 1):
        for i in range(len(t) - k + 1):
            h = 0
            for c in t[i : i + k]:
                h = (h * 0x01000193 + ord(c) * 0x9E3779B1) & 0xFFFFFFFF
            yield ((h ^ h >> 15) * 0x85EBCA6B & 0xFFFFFFFF) >> 17


def test_language_against_plain_counts(spark):
    """The query's languages, scores and fits from a naive Bayes of dictionaries."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "substring(text, 1, 300) as text", "lang")
    rows = docs.collect()
    counts = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            own = counts.setdefault(r.lang, {})
            for g in plain_grams(r.text):
                own[g] = own.get(g, 0) + 1
    total = {lang: sum(c.values()) + 0.5 * li.BUCKETS for lang, c in counts.items()}
    log_p = lambda lang, g: math.log((counts[lang].get(g, 0) + 0.5) / total[lang])
    typical = {lang: sum(math.exp(x) * x for x in (log_p(lang, g) for g in range(li.BUCKETS))) for lang in counts}
    got = {r.doc_id: r for r in li.language_id(docs).collect()}
    for r in rows[::4]:
        grams = [*plain_grams(r.text)]
        own = {lang: sum(log_p(lang, g) for g in grams) for lang in sorted(counts)}
        best = max(own, key=lambda lang: own[lang])
        x = got[r.doc_id]
        assert x.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and x.lang_pred == best
        assert abs(x.score - 1 / sum(math.exp(v - own[best]) for v in own.values())) < 1e-4
        none = -math.log(li.BUCKETS)
        assert abs(x.fit - (own[best] / len(grams) - none) / (typical[best] - none)) < 1e-4


def test_grams_stay_in_their_text():
    one, counts = li.grams(["ab", "", "c", "1-a..b é"])
    assert counts.tolist() == [[4, 1, 3, 7], [3, 0, 2, 6], [2, 0, 1, 5]] and [len(x) for x in one] == [15, 11, 8]
    for t in ("1-a..b é", "", "ß 日本 x", "a\u0301 b"):
        if t != "a\u0301 b":  # a mark counts as a letter, which isalpha does not say
            assert sorted(np.concatenate(li.grams([t])[0]).tolist()) == sorted(plain_grams(t))


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    model = qu.train(docs, labels.where("doc_id % 4 != 2"))
    assert (model.thresholds[1:] > model.thresholds[:-1]).all()
    got = {r.doc_id: r for r in qu.predict(docs.withColumn("p_top", F.lit(1)), model).collect()}
    test = [(got[r.doc_id], r.quality + 1 - r.toxic) for r in labels.where("doc_id % 4 = 2").collect()]
    good = [p for p, g in test if g == 2]
    mean = lambda x: sum(x) / len(x)
    assert mean([p.selected for p in good]) > 0.9
    assert mean([p.expected_grade for p, g in test if g < 2]) + 0.2 < mean([p.expected_grade for p in good])
    odd = qu.predict(frame(spark, NONE), model).collect()
    assert len(odd) == len(NONE) and all(0 <= r.expected_grade <= 2 for r in odd)
    assert qu.quality(docs.limit(3), labels.limit(0)).count() == 3 and qu.quality(docs.limit(0), labels).count() == 0


def test_quality_is_the_likelihoods_optimum(spark):
    """Chances by the formula, and no small step from the fitted weights lowers the penalised likelihood's negative, written out row by row."""
    r, n, dim = np.random.RandomState(5), 240, 12
    x = (r.rand(n, dim) < 0.4) * np.log1p(r.randint(1, 4, (n, dim)))
    grade = (x @ r.randn(dim) + r.logistic(size=n) > -0.5).astype(int) + (x @ np.linspace(-1, 1, dim) + r.logistic(size=n) > 0.7)
    row, bucket = np.nonzero(x)
    model = qu.fit(row, bucket, x[row, bucket], grade, steps=4000, rate=0.02)

    def cost(weights, thresholds):
        total = 0.0
        for i in range(n):
            above = [1.0, *(1 / (1 + math.exp(t - float(x[i] @ weights))) for t in thresholds), 0.0]
            total -= math.log(above[grade[i]] - above[grade[i] + 1])
        return total / n + 0.5e-3 * float(weights @ weights)

    w, t = model.weights[:dim], model.thresholds
    best = cost(w, t)
    for _ in range(60):
        assert cost(w + 0.05 * r.randn(dim), t + 0.05 * r.randn(2)) >= best - 1e-5
    score = x @ w
    assert np.allclose(qu.chances(score, t)[:, 1], [1 / (1 + math.exp(t[1] - s)) for s in score])


def test_quality_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "good words here"), (1, "good words here"), (2, None), (None, "x")], "doc_id long, text string").withColumn("p_top", F.lit("x"))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = qu.quality(docs, labels).collect()
    assert len(got) == 4 and len({x.expected_grade for x in got if x.doc_id == 1}) == 1
