"""Operator 10, PII: fixed patterns, and a linear-chain conditional random field over word shapes.

The base kinds (email, ip, card, phone) are the leftmost non-overlapping matches of fixed patterns
that pass a test.  The field labels words of the same kinds, in further ways of writing them (jane at
example dot com, cards and phones in other groups), and of ssn, localphone and iban.  It reads a word's shape
(``d3-d2-d4`` for 123-45-6789), its first and last two characters, the word itself where the labelled table has it
more than once, and shapes and words of both neighbours.  It is trained by gradient steps on the exact likelihood of
labelled lines (a caller may pass other ones) and decoded by Viterbi over padded numpy batches.  An inner label follows
its own kind only.  A chain is a sentence: it ends at a line's end and where a full stop, question or exclamation mark follows a word.  A
chain in which no word can gain by any label, a bound over its words shows that exactly, is all O and isn't decoded.
Spans of the field that overlap a base one are left out, but counted.

Null and empty texts have no spans.  Spans count code points, end exclusive, ordered by start and
then by kind as listed.  Rows are independent: repeated rows give repeated results.  Further columns
are ignored by ``find`` and kept by ``masked``.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from random import Random
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from haplospark.llm import _common

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "localphone", "iban")
SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_field bigint, n_added bigint"
Span = tuple[int, int, int]  # start, place of the kind in KINDS, end

_LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Digits are consumed whole, so a match never starts or ends inside a run of them; that keeps long runs linear.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_RIM = r".,;:!?\"'`$#*%&|<>\[\]{}=~_/\\"
_WORD = re.compile(rf"[^\s{_RIM}](?:\S*[^\s{_RIM}])?")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern. A match holds one @, and its local part reaches left as far as it can."""
    free = 0  # nothing before this place can belong to a further match
    at = text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL_PART))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        free = m.end() if m else at + 1
        if m:
            yield start, free
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text: str) -> list[Span]:
    spans = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x := g.lstrip("0")) < 4 and int(x or 0) < 256 for g in m.groups())]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(m[0].count, "0123456789")) <= 15]
    return sorted(spans)


# The labelled table.

#: Lines in which {} stands for a value of the kind. Fixed values.
CONTEXTS = {
    "ssn": ("my ssn is {}", "SSN {} on file", "social security number {} of the tenant", "security number {} was given", "{} stands on the form", "the applicant gave {} twice", "ssn number {}", "mm mm {} mm", "{} mm mm mm", "mm mm mm {}"),
    "localphone": ("call {} after 5 pm", "phone {} room 214", "reach me at {} or at the desk", "fax {} and mail", "{} is toll free", "the office line {} closed in 2019", "dial {} for help", "tel {}", "mobile {} please", "ring {} now", "mm mm {} mm", "mm mm mm {}"),
    "iban": ("transfer to {} by friday", "IBAN {} please", "account {} was opened in 2004", "{} belongs to the firm", "pay {} before noon", "iban {}", "mm mm {} mm", "mm mm mm {}"),
    "email": ("write to {} today", "mail {} for details", "contact {} or call", "{} is my address", "send it to {}", "email {} please", "mm mm {} mm"),
    "card": ("card {} expires 04/27", "paid with card {} yesterday", "visa {} was charged", "credit card number {}", "mastercard {} please", "card number {}"),
    "ip": ("host {} answered in 25 ms", "from {} to port 8080", "server at {} is down", "mm mm {} mm"),
    "phone": ("call {} now", "phone {} please", "mobile {} or mail", "mm mm {} mm", "mm mm mm {}"),
}
#: How values are written: 9 is a digit, L a capital letter, m a word; a bar stands between ways. Fixed values.
FORMS = {
    "ssn": "999-99-9999",
    "localphone": "(999) 999-9999|999-999-9999|099 9999 9999|09999 999999|999 999 9999",
    "iban": "LL999999999999999999|LL99LLLL9999999999|LL99 9999 9999 9999 9999 99|LL99 LLLL 9999 9999 9999 99|LL9999999999999999999999",
    "email": "m at m dot com|m dot m at m dot org|m.m@m.com|m [at] m [dot] net|m(at)m.com|m99@m.m.org",
    "card": "9999 9999 9999 9999|9999999999999999|9999-9999-9999-9999|9999.9999.9999.9999",
    "ip": "99.9.9.99|199.168.9.9|9.9.99.9|199.99.199.99",
    "phone": "+9 (999) 999-9999|+99 99 9999 9999|+9 999 999 9999|0099 99 9999 9999",
}
#: Lines without personal data, in the same writing. Fixed values.
PLAIN_LINES = (
    "between 1999 and 2009 prices rose by 9.9 percent", "version 9.9.9 of the tool was built on 2099-99-99", "he ran 999 meters in 99.9 seconds and 999 in 99.9",
    "see pages 99-99 and 999-999 of volume 9", "the score was 9-9 after 99 minutes", "order 9999999999999999 shipped with 99 boxes", "room L99 at 99:99 and room L9 at 99:99",
    "in 1999 1999 2009 and 2009 nothing changed", "model L999 costs 9,999.99 and L999 costs 9,999.99", "the id m9m9 and the id 9m9m9 are free", "items 9 9 9 9 and 9 were sold on 2099-99-99",
    "parts 9999 9999 and 9999 are listed in table 9", "the 9999-9999 range has 99 lots and 99-99 is empty", "ISBN 978-9-99-999999-9 and code 99-999-99", "isbn 978-99-9999", "pages 999-999-9999 of the annex",
    "page 999-999", "part number 999-99-999 is sold out", "chapter 9.9.9.9.9 is long", "build 99.9.999 is out", "meet at m and stay at m", "look at m or m at m", "the dot at the end", "mm mm at mm mm", "mm at mm mm",
    "mm mm 9999 mm", "mm 99 mm 99 mm", "mm 99.99 mm", "mm 2099-99-99 mm", "mm 99/99/2099 mm", "mm 99:99 mm", "mm 9999999999 mm", "mm 9999999999999999 mm", "mm mm 9999999999999999", "9999999999999999 mm mm", "pages 999-999-9999", "page 999-999-9999 mm", "see pages 999-999-9999 mm", "invoice 99-9999 of 2009", "mm 999 999 mm", "mm 99 999 999 mm", "order 999-9999999-9999999",
    "ticket LL-9999", "lot LL99999999", "serial LL99LL99", "card for you", "phone is off", "mail it", "call me later", "nothing here has any number at all and that is fine", "mm mm mm mm mm", "Mm mm mm mm", "the account was closed in 2009",
    "number 99 of 999", "mm 9.9 mm 9.9 mm", "9,999 mm and 9,999 mm", "section 99-9 of the act", "the 99-99-2009 issue", "ip stands for something", "server 99 is down", "host 9 answered in 99 ms",
)


def made_lines(seed: int = 1, each: int = 3) -> tuple[str, ...]:
    """The labelled table by rule: every context with *each* values in every way of writing, and the plain lines as often. What stands in [kind ...] is personal data."""
    r = Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvwy") for _ in range(r.randint(3, 9)))

    def filled(form: str) -> str:
        out = re.sub(r"\b[Mm]{1,2}(?![A-Za-z])|(?<=\d)m|m(?=\d)", lambda m: word().title() if m[0][0] == "M" else word(), form)
        return re.sub("9(?![0-9])|9", lambda m: r.choice("0123456789"), re.sub("L", lambda m: r.choice("ABCDEFGHIKLNPRST"), out))

    lines = [filled(x) for x in PLAIN_LINES for _ in range(2 * each)]
    for kind, contexts in CONTEXTS.items():
        for form in FORMS[kind].split("|"):
            for context in contexts:
                lines += [re.sub("mm", lambda m: word(), context).replace("{}", f"[{kind} {filled(form).replace('[', '<').replace(']', '>')}]") for _ in range(each)]
    return tuple(lines)


# The field.

_TAGGED = re.compile(r"\[(\w+) ([^\]]+)\]")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_RUNS = re.compile(r"([a-z]+)|([A-Z]+)|([0-9]+)|([^\x00-\x7f]+)")
#: Types of words that a worker remembers; another text's words take their places when they are full.
MOST_TYPES = 1 << 16
#: Words, padding included, of a batch that is decoded at once: a step has a score for each pair of labels and each chain.
PADDED = 1 << 13
_INVALID = -1e4


def shape(word: str) -> str:
    """Classes and lengths of a word's runs: d3-d2-d4, X2d2; letters alone are w."""
    if word.isalpha():
        return "w"
    return _RUNS.sub(lambda m: f"{'xXdu'[m.lastindex - 1]}{min(len(m[0]), 6) if m.lastindex == 3 else ''}", word)


def features(word: str) -> tuple[str, ...]:
    """Shape, both ends and the word itself, with 0 for each digit."""
    plain = re.sub("[0-9]", "0", word.lower())
    return f"s{shape(word)}", f"w{plain}", *((f"p{plain[:2]}", f"q{plain[-2:]}", f"n{min(sum(c.isdigit() for c in word), 24)}") if not word.isalpha() else ())


def _sentences(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Start and end of each word, whether a chain begins with it, and the words."""
    found = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), []
    start, end, words = zip(*found)
    start, end = np.array(start), np.array(end)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    lines = np.append(0, np.cumsum(codes == 10))
    opens = np.ones(len(start), bool)
    opens[1:] = (lines[start[1:]] > lines[end[:-1]]) | np.isin(codes[end[:-1]], [33, 46, 63])
    return start, end, opens, [*words]


class Field:
    """Scores of labels for the features of a word and of the words beside it (own, before, after), and moves from label to label."""

    def __init__(self, labelled: tuple[str, ...], steps: int = 100, rate: float = 0.1, ridge: float = 0.003):
        chains, seen = [], Counter()
        for line in labelled:
            plain, spans, at = "", [], 0
            for m in [*_TAGGED.finditer(line), None]:
                plain += line[at : m.start() if m else len(line)]
                if m:
                    spans.append((len(plain), len(plain) + len(m[2]), KINDS.index(m[1])))
                    plain, at = plain + m[2], m.end()
            start, end, opens, words = _sentences(plain)
            y, last = np.zeros(len(words), np.int64), None
            for i in range(len(words)):
                own = next((s for s in spans if s[0] <= start[i] and end[i] <= s[1]), None)
                y[i] = 0 if own is None else 1 + 2 * own[2] + (own == last and not opens[i])
                last = own
            for part in np.split(np.arange(len(words)), np.flatnonzero(opens)[1:]) if words else []:
                chains.append(([words[i] for i in part], y[part]))
                seen.update(f for i in part for f in set(features(words[i])))
        # A feature seen once says no more than that it is rare.
        self.ids = {f: i + 1 for i, f in enumerate(sorted(f for f, n in seen.items() if n > 1))}
        self.vocabulary = {f[1:] for f in self.ids if f[0] == "w"}
        n, k = len(self.ids) + 1, len(LABELS)
        names = np.arange(k)
        #: An inner label follows the first or an inner one of its kind.
        self.valid = (names[None] % 2 == 1) | (names[None] == 0) | (names[:, None] == names[None]) | (names[:, None] == names[None] - 1)
        self.weights, self.moves = np.zeros((3, n, k)), np.zeros((k, k))
        self.types: dict[str, int] = {}
        if chains:
            self._fit(chains, steps, rate, ridge)
        self.moves[~self.valid] = _INVALID
        #: What a label can gain over O by the moves around it, and by the move out of a span.
        self.enter = np.where(self.valid, self.moves, -np.inf).max(0)[1:] - self.moves[0, 0]
        self.leave = max(0.0, float((self.moves[1:, 0] - self.moves[0, 0]).max()))
        self._forget()

    def _forget(self) -> None:
        self.types, self.tables = {}, np.zeros((3, 1024, len(LABELS)))
        self.tables[:, 0] = self.weights[:, self.ids["sw"]] if "sw" in self.ids else 0

    def _coded(self, word: str) -> list[int]:
        return [self.ids[f] for f in features(word) if f in self.ids]

    def _fit(self, chains: list, steps: int, rate: float, ridge: float) -> None:
        """Adam on the exact log likelihood of all chains at once, padded."""
        n, most = len(chains), max(len(y) for _, y in chains)
        size = np.array([len(y) for _, y in chains])
        y = np.zeros((n, most), np.int64)
        at: tuple[list, list, list] = ([], [], [])  # table, place in the padded batch, feature
        for c, (words, labels) in enumerate(chains):
            y[c, : len(labels)] = labels
            coded = [self._coded(w) for w in words]
            for i in range(len(words)):
                for table, j in ((0, i), (1, i - 1), (2, i + 1)):
                    if 0 <= j < len(words):
                        at[0].extend([table] * len(coded[j])), at[1].extend([c * most + i] * len(coded[j])), at[2].extend(coded[j])
        table, place, feature = map(np.array, at)
        k, rows, cols = len(LABELS), np.arange(n), self.weights.shape[1]
        live = np.arange(most)[None] < size[:, None]
        gold = np.zeros((n, most, k))
        gold[live, y[live]] = 1
        pairs = np.zeros((k, k))
        np.add.at(pairs, (np.zeros(n, np.int64), y[:, 0]), 1)
        np.add.at(pairs, (y[rows, size - 1], np.zeros(n, np.int64)), 1)
        both = live[:, 1:]
        np.add.at(pairs, (y[:, :-1][both], y[:, 1:][both]), 1)
        by_place, by_feature = np.argsort(place, kind="stable"), np.argsort(table * cols + feature, kind="stable")
        params = (self.weights, self.moves)
        mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            e = _summed(self.weights[table, feature], place, by_place, n * most).reshape(n, most, k)
            here, moved = _expected(e, np.where(self.valid, self.moves, _INVALID), size)
            difference = (gold - here * live[:, :, None]).reshape(-1, k)
            slope = [_summed(difference[place], table * cols + feature, by_feature, 3 * cols).reshape(self.weights.shape) - ridge * self.weights, np.where(self.valid, pairs - moved, 0) - ridge * self.moves]
            for p, g, m, s in zip(params, slope, mean, square):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)

    def _types(self, words: list[str]) -> np.ndarray:
        """The type of each word: its row in the tables of scores as the word itself, the one before and the one after. Letters that the table doesn't have are type 0."""
        if len(self.types) > MOST_TYPES:
            self._forget()
        known, out = self.types, np.zeros(len(words), np.int64)
        for i in [i for i, w in enumerate(words) if not w.isalpha() or w.lower() in self.vocabulary]:
            if (row := known.get(w := words[i])) is None:
                known[w] = row = len(known) + 1
                if row == self.tables.shape[1]:
                    self.tables = np.concatenate([self.tables, np.zeros_like(self.tables)], 1)
                self.tables[:, row] = self._scores(w)
            out[i] = row
        return out

    def _scores(self, word: str) -> np.ndarray:
        coded = self._coded(word)
        return self.weights[:, coded].sum(1) if coded else np.zeros((3, len(LABELS)))

    def emissions(self, words: list[str], opens: np.ndarray) -> np.ndarray:
        """A row of scores for each word; neighbours are those of its chain."""
        types = self._types(words)
        e = self.tables[0][types]
        beside = np.flatnonzero(~opens)
        e[beside] += self.tables[1][types[beside - 1]]
        e[beside - 1] += self.tables[2][types[beside]]
        return e

    def decode(self, e: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """The best label of each word, chain by chain; chains in which no label can gain anything stay O."""
        out = np.zeros(len(e), np.int64)
        if not len(e):
            return out
        first = np.flatnonzero(opens)
        size = np.diff(first, append=len(e))
        gain = (e[:, 1:] - e[:, :1] + self.enter).max(1) + self.leave
        some = np.flatnonzero(np.maximum.reduceat(gain, first) > 0)
        some = some[np.argsort(size[some], kind="stable")]
        while len(some):
            take = max(1, int(np.searchsorted(np.arange(1, len(some) + 1) * size[some], PADDED, "right")))
            part, some = some[:take], some[take:]
            self._viterbi(e, first[part], size[part], out)
        return out

    def _viterbi(self, e: np.ndarray, first: np.ndarray, size: np.ndarray, out: np.ndarray) -> None:
        most = int(size[-1])
        best, came = self.moves[0] + e[first], np.zeros((most, len(first), len(LABELS)), np.int8)
        final = best + self.moves[:, 0]
        for i in range(1, most):
            live = np.searchsorted(size, i, "right")  # chains are in order of size: those from here on go on
            by = best[live:, :, None] + self.moves
            came[i, live:] = by.argmax(1)
            best[live:] = by.max(1) + e[first[live:] + i]
            final[live:] = best[live:] + self.moves[:, 0]
        label = final.argmax(1)
        for i in range(most - 1, -1, -1):
            live = np.searchsorted(size, i, "right")
            out[first[live:] + i] = label[live:]
            label[live:] = came[i, np.arange(live, len(first)), label[live:]]

    def spans(self, texts: list[str]) -> list[list[Span]]:
        """For each text the spans that the field finds."""
        found: list[list[Span]] = [[] for _ in texts]
        size = np.array([len(t) + 1 for t in texts])
        before = np.cumsum(size) - size
        start, end, opens, words = _sentences("\n".join(texts))
        if not words:
            return found
        label = self.decode(self.emissions(words, opens), opens)
        inner = (label > 0) & (label % 2 == 0)
        begins = np.flatnonzero((label > 0) & ~inner)
        stops = np.flatnonzero(~inner)
        for b in begins.tolist():
            j = int(np.searchsorted(stops, b, "right"))
            last = (int(stops[j]) if j < len(stops) else len(words)) - 1
            t = int(np.searchsorted(before, start[b], "right")) - 1
            found[t].append((int(start[b] - before[t]), (int(label[b]) - 1) // 2, int(end[last] - before[t])))
        return found


def _summed(rows: np.ndarray, key: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by key; *order* sorts the keys."""
    out = np.zeros((n, rows.shape[1]))
    if len(rows):
        known = key[order]
        first = np.flatnonzero(np.diff(known, prepend=-1))
        out[known[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def _expected(e: np.ndarray, moves: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of the labels at each place of padded chains, and expected numbers of moves; a chain starts and ends next to an O."""
    n, most, k = e.shape
    rows = np.arange(n)
    forward, backward = np.zeros_like(e), np.zeros_like(e)
    forward[:, 0] = moves[0] + e[:, 0]
    for i in range(1, most):
        forward[:, i] = e[:, i] + _log_sum(forward[:, i - 1, :, None] + moves, 1)
    total = _log_sum(forward[rows, size - 1] + moves[:, 0], 1)
    for i in range(most - 1, -1, -1):
        ends = (size - 1 == i)[:, None]
        further = _log_sum(moves + (e[:, i + 1] + backward[:, i + 1])[:, None], 2) if i + 1 < most else 0
        backward[:, i] = np.where(ends, moves[:, 0], further)
    here = np.exp(np.minimum(forward + backward - total[:, None, None], 0))
    moved = np.zeros((k, k))
    moved[0] += here[:, 0].sum(0)
    moved[:, 0] += here[rows, size - 1].sum(0)
    for i in range(most - 1):
        live = size - 1 > i
        moved += np.exp(forward[live, i, :, None] + moves + (e[live, i + 1] + backward[live, i + 1] - total[live, None])[:, None]).sum(0)
    return here, moved


@lru_cache(4)
def trained(labelled: tuple[str, ...] = made_lines()) -> Field:
    return Field(labelled)


def all_spans(texts: list[str | None], field: Field) -> list[tuple[list[Span], list[Span], int]]:
    """For each text the base spans, these with what the field adds beside them, and how many spans the field found."""
    plain = [t or "" for t in texts]
    out = []
    for own, more in zip(map(base_spans, plain), field.spans(plain)):
        reach, free = 0, []
        rest = iter([*own, (float("inf"), 0, 0)])
        then = next(rest)
        for s in more:  # neither list's starts go back, and the field's spans don't overlap one another
            while then[0] < s[2]:
                reach, then = max(reach, then[2]), next(rest)
            if reach <= s[0]:
                free.append(s)
        out.append((own, sorted([*own, *free]), len(more)))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, column: str = "text", labelled: tuple[str, ...] | None = None) -> DataFrame:
    """Counts and digest of the base spans, all spans, and how many the field found and added, of each row of docs(doc_id, column).

    labelled: the lines that the field learns from.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained(labelled) if labelled is not None else trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.pieces(batches, 2048, 1 << 18):
            found = all_spans(batch.column("text").to_pylist(), shared.value)
            counts = [pa.array([sum(s[1] == k for s in base) for base, *_ in found], pa.int64()) for k in range(4)]
            digests = pa.array([sha256(written(base).encode()).hexdigest() for base, *_ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digests, pa.array([written(s) for _, s, _ in found], pa.string()), pa.array([n for *_, n in found], pa.int64()), pa.array([len(s) - len(base) for base, s, _ in found], pa.int64())], [x.split()[0] for x in SCHEMA.split(", ")])

    return _common.bounded(docs).selectExpr("cast(doc_id as bigint) doc_id", f"`{column}` as text").mapInArrow(run, SCHEMA)


def mask(text: str, spans: list[Span]) -> str:
    """*text* with [KIND] in place of each span; of overlapping spans the first names them all."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        while (i := i + 1) < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, labelled: tuple[str, ...] | None = None) -> DataFrame:
    """All rows with personal data in text masked; n_chars, where it is a column, follows the text."""
    shared = docs.sparkSession.sparkContext.broadcast(trained(labelled) if labelled is not None else trained())
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.pieces(batches, 2048, 1 << 18):
            texts = batch.column("text").to_pylist()
            new = [mask(t, s) if s else t for t, (_, s, _) in zip(texts, all_spans(texts, shared.value))]
            columns = [pa.array(new, c.type) if name == "text" else c for name, c in zip(names, batch.columns)]
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([len(b) if a != b else n for a, b, n in zip(texts, new, columns[k].to_pylist())], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return _common.bounded(docs).mapInArrow(run, docs.schema)
