"""Operator 3, secret scans: fixed patterns, and character Markov models; DataFrame functions only.

The base kinds (assign, access, hex) are the leftmost non-overlapping matches of fixed patterns that
pass a length test.  The kind ``random`` is found by itself: runs of CANDIDATE characters whose bigrams are
likelier under a model of random strings than under one of ordinary identifiers, so a token that a
base kind found is named by the models as well if they agree, and one that no pattern knows is
found by them alone.  Both are first-order Markov models, trained from samples(text, random) that a caller may pass, and
compared by log-likelihood ratio; a run needs a least ratio in all and for each bigram.  Without samples, they
are made by rule (``labelled_samples``) and taken from about MOST_ROWS documents, drawn by a hash of doc_id
(``corpus_samples``): what base patterns caught is random, the distinct other words are ordinary.  The
models' difference is at most 63 * 63 whole numbers (thousandths of a nat), which is all that reaches the driver.

Places of matches come from the text's parts between them: lengths of parts and matches add up, block by block, so that
many matches cost their number and not its square.

Null and empty texts have no spans.  Spans count code points, end exclusive, ordered by start and
then by kind as listed; spans of different kinds may overlap.  Samples that are null or shorter than two characters
teach nothing.  Rows are independent: repeated rows give
repeated results.  Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
#: The assignment pattern; group 2 is the secret. Letters of its names match in either case.
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: A run of the length that passes; a shorter run fails whole, and no other match can start inside a run of its characters.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}"
CANDIDATE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}"
#: Documents that default samples are taken from, about; the bound of training.
MOST_ROWS = 1000
#: Matches whose places are added up in one go.
BLOCK = 256
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
STATES = len(ALPHABET) + 1  # all other characters are one state, 0

#: Words of ordinary identifiers and texts, in four languages. Fixed values.
ORDINARY_WORDS = (
    "account address amount array async attribute average balance base batch begin binary block body boolean buffer "
    "build byte cache call cancel category channel character check child class client close code collection column "
    "command comment config connection constant container content context control convert count create current "
    "customer data database date default delete description device dictionary direction display document domain "
    "double element email enable encode encoding engine entry error event example exception execute export factory "
    "field file filter flag float folder format frame function general generate group handler header height history "
    "identifier image import index information initial input instance integer interface internal invoice iterator "
    "kernel label language layout length level library limit line link listener local location logger manager map "
    "maximum memory message metadata method minimum model module name network node notification number object offset "
    "option order original output package page panel parameter parent parse partition password path pattern payment "
    "position prefix previous process product profile project property protocol provider query queue random range "
    "record reference region register remote request resource response result return schedule schema search section "
    "security segment select sequence server service session setting source standard state statement status storage "
    "nothing another everything something themselves understanding interesting information therefore whatever between "
    "verschiedenen möglichkeit gesellschaft entwicklung wissenschaft zwischen geschichte wirtschaft einrichtung "
    "gouvernement développement administration maintenant beaucoup toujours quelque question également entreprise "
    "desarrollo información gobierno siempre también entonces universidad sociedad conocimiento trabajadores"
)


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """text, random: n samples of either kind by rule: digests in three alphabets, and identifiers of two to four words."""
    words = F.split(F.lit(ORDINARY_WORDS), " ")
    word = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(ORDINARY_WORDS.split(" ")))) + 1).cast("int"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    random = F.when(F.col("id") % 3 == 0, F.substring(digest, 1, 40)).otherwise(F.regexp_replace(F.base64(F.unhex(digest)), "=", ""))
    random = F.when(F.col("id") % 3 == 1, F.regexp_replace(random, "[+/]", "")).otherwise(random)
    parts = F.slice(F.array(*(word(k) for k in range(4))), 1, (F.col("id") % 3 + 2).cast("int"))
    snake, camel = F.array_join(parts, "_"), F.array_join(F.transform(parts, F.initcap), "")
    plain = F.when(F.col("id") % 5 == 0, snake).when(F.col("id") % 5 == 1, camel).when(F.col("id") % 5 == 2, F.array_join(parts, "")).when(F.col("id") % 5 == 3, F.upper(snake)).otherwise(F.concat(F.array_join(parts, "-"), (F.col("id") % 100).cast("string")))
    ids = spark.range(n)
    return ids.select(random.alias("text"), F.lit(True).alias("random")).unionAll(ids.select(plain, F.lit(False)))


def corpus_samples(docs: DataFrame, most_rows: int = MOST_ROWS, column: str = "text") -> DataFrame:
    """text, random: what the base patterns catch in about *most_rows* documents, and the distinct words beside it."""
    n = max(docs.count(), 1)
    text = F.coalesce(F.col(column), F.lit(""))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (1 << 20) * most_rows / n)
    hits = F.concat(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), F.regexp_extract_all(text, F.lit(HEX), F.lit(0)))
    rest = F.regexp_extract_all(F.regexp_replace(text, f"{ASSIGN}|{ACCESS}|{HEX}", " "), F.lit("[A-Za-z0-9_-]{4,}"), F.lit(0))
    random = drawn.select(F.explode(hits).alias("text")).where("length(text) >= 12")
    return random.distinct().select("text", F.lit(True).alias("random")).unionAll(drawn.select(F.explode(rest).alias("text")).distinct().select("text", F.lit(False)))


def _states(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _moves(text: Column) -> Column:
    """The bigrams of a text as numbers below STATES squared."""
    states = _states(text)
    return F.transform(F.arrays_zip(F.slice(states, F.lit(1), F.greatest(F.size(states) - 1, F.lit(0))).alias("a"), F.slice(states, F.lit(2), F.greatest(F.size(states) - 1, F.lit(0))).alias("b")), lambda p: p["a"] * STATES + p["b"])


def train(samples: DataFrame, alpha: float = 0.5) -> list[int]:
    """Log-likelihood ratios of random to ordinary for each move from state to state, in thousandths, from samples(text, random)."""
    moves = samples.where("length(text) > 1").select("random", F.explode(_moves(F.col("text"))).alias("move"))
    counts = {(r.random, r.move): r.n for r in moves.groupBy("random", "move").agg(F.count("*").alias("n")).collect()}
    ratios = []
    if not counts:
        return [0] * STATES**2
    for a in range(STATES):
        rows = {kind: [counts.get((kind, a * STATES + b), 0) + alpha for b in range(STATES)] for kind in (True, False)}
        total = {kind: sum(x) for kind, x in rows.items()}
        ratios += [round(1000 * math.log(rows[True][b] / total[True] / (rows[False][b] / total[False]))) for b in range(STATES)]
    return ratios


def _let(value: Column, body) -> Column:
    """body(value), where value is worked out once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(text: Column, pattern: str, kind: int, passes=None, extra: Column | None = None) -> Column:
    """array of (start, kind, end) of a pattern's matches that pass; *extra*: an array beside the matches for the test."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    rows = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), (extra if extra is not None else found).alias("extra"))

    def step(acc: Column, row: Column) -> Column:
        start = acc["at"] + F.length(row["gap"])
        end = start + F.length(row["hit"])
        kept = F.concat(acc["out"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))))
        return F.struct(end.alias("at"), (kept if passes is None else F.when(passes(row), kept).otherwise(acc["out"])).alias("out"))

    def in_blocks(rows: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int")), lambda b: F.slice(rows, b * BLOCK + 1, F.lit(BLOCK)))
        return F.transform(blocks, lambda part: F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("out")), step))

    def shifted(parts: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(parts, first, lambda acc, p: F.struct((acc["at"] + p["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")))["starts"]
        moved = lambda p, by: F.transform(p["out"], lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end")))
        return F.flatten(F.zip_with(parts, starts, moved))

    return F.when(text.rlike(pattern), _let(_let(rows, in_blocks), shifted)).otherwise(none)


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, samples: DataFrame | None = None, least: int = 12_000, least_each: int = 450, column: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random of each row of docs(doc_id, column).

    A run is random if its log-likelihood ratio is *least* thousandths of a nat or more, and *least_each* a move.
    samples(text, random): what the models learn from.
    """
    if samples is None:
        samples = labelled_samples(docs.sparkSession).unionAll(corpus_samples(docs, column=column))
    table = F.array(*map(F.lit, train(samples)))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(column), F.lit("")).alias("text"))
    text = F.col("text")

    def random(row: Column) -> Column:
        total = F.aggregate(_moves(row["hit"]), F.lit(0).cast("bigint"), lambda acc, move: acc + F.element_at(table, move + 1))
        return _let(total, lambda t: (t >= least) & (t >= least_each * (F.length(row["hit"]) - 1)))

    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    base = F.concat(_spans(text, ASSIGN, 0, lambda r: F.length(r["extra"]) >= 6, values), _spans(text, ACCESS, 1), _spans(text, HEX, 2))
    rows = rows.select("doc_id", F.array_sort(base).alias("base"), _spans(text, CANDIDATE, 3, random).alias("more"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.array_sort(F.concat("base", "more"))).alias("spans"), F.size("more").cast("bigint").alias("n_random"),
    )
