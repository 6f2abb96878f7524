"""Kernels without Spark: golden cases and invariants."""

import random

import pytest

from haplospark.operators import alignment as al
from haplospark.operators import haplotypes as hp
from haplospark.operators.kmers import murmur3_low

REF = "ATGATTGCATAAGTATTGGATAGTTA"


@pytest.mark.parametrize(
    "path, cigar",
    [
        (REF, "26M"),
        ("ATGATTGCATAAATATTGGATAGTTA", "26M"),
        ("ATGATTGCATAANTATTGGATAGTTA", "26M"),
        ("ATGATTGCATAAGGGGTATTGGATAGTTA", "12M3I14M"),
        ("ATGATTGCATAATTGGATAGTTA", "11M3D12M"),
        ("ATGATTGCATAAAGTATTGGATAGTTA", "10M1I16M"),
        ("ATGATATAAGTATTGGATAGTTA", "5M3D18M"),
        ("ATGATGGGTGCATAAGTATTGGATAGTTA", "5M3I21M"),
        ("ATGATTGCATAAGTATTGGATGGGAGTTA", "21M3I5M"),
    ],
)
def test_gapped(path, cigar):
    assert al.gapped([al.codes(path)], [al.codes(REF)], 5) == [cigar]


@pytest.mark.parametrize("read, likely, hit", [("TAAGGGGTATT", 8, (0, 9)), ("AAGGGGTAT", 9, (0, 10)), ("AAGTATTGG", 10, (6, 13)), ("NAGTATTGG", 10, (4, 13)), ("TTTTTTTTT", 6, (15, 15))])
def test_ungapped(read, likely, hit):
    assert [int(x[0]) for x in al.ungapped(al.codes("ATGATTGCATAAGGGGTATTGGATAGTTA"), [al.codes(read)], 5, [likely])] == [*hit]


def test_ungapped_without_reads():
    """A region may have no reads of a conversion."""
    assert [x.tolist() for x in al.ungapped(al.codes("ATGATTGCAT"), [], 2, [])] == [[], []]


def test_ungapped_does_not_fit():
    assert al.ungapped(al.codes("ATGAT"), [al.codes("ATGATT")], 2, [0])[0].tolist() == [-1]


def plain_gapped(path, ref, k):
    """The CIGAR by the rule, cell by cell: a gap's first letter costs 8, and 3 where the cell beside it was best reached by the same gap."""
    if path == ref:
        return f"{len(path)}M"
    a, b = al.codes(path[k - 1 : len(path) - k + 1]), al.codes(ref[k - 1 : len(ref) - k + 1])
    best, ways = {(0, 0): 0}, {(0, 0): ""}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                best[i, j], ways[i, j] = -(5 + 3 * (i + j)) if i + j else 0, "D" * (j > 0) + "I" * (i > 0)
                continue
            gap = lambda cell, way: best[cell] - 3 - 5 * (way not in ways[cell])
            scores = {"M": best[i - 1, j - 1] - int(al.PENALTY[a[i - 1], b[j - 1]]), "I": gap((i - 1, j), "I"), "D": gap((i, j - 1), "D")}
            best[i, j] = max(scores.values())
            ways[i, j] = "".join(w for w in "MID" if scores[w] == best[i, j])
    i, j, way, out = len(a), len(b), "M", ""
    while i and j:
        way = way if way in ways[i, j] else ways[i, j][0]
        out, i, j = way + out, i - (way != "D"), j - (way != "I")
    return al.packed("M" * (k - 1) + "D" * j + "I" * i + out + "M" * (k - 1))


def test_gapped_against_single_cells():
    r = random.Random(5)
    letters = lambda n: "".join(r.choice("ATGN" if r.random() < 0.1 else "ATG") for _ in range(n))
    for k in (3, 5):
        pairs = []
        for _ in range(150):
            head, tail, ref = letters(k), letters(k), letters(r.randint(0, 25))
            path = list(ref)
            for _ in range(r.randint(0, 3)):
                at = r.randint(0, len(path))
                path[at : at + r.choice([0, 0, 1, 4])] = letters(r.choice([0, 1, 5]))
            pairs.append((head + "".join(path) + tail, head + ref + tail))
        got = al.gapped([al.codes(p) for p, _ in pairs], [al.codes(x) for _, x in pairs], k)
        assert got == [plain_gapped(p, x, k) for p, x in pairs]


def test_ungapped_against_single_places():
    r = random.Random(6)
    for _ in range(200):
        path, k = al.codes("".join(r.choice("ATGN") for _ in range(r.randint(1, 40)))), r.choice([1, 3, 5])
        reads = [al.codes("".join(r.choice("ATGN") for _ in range(r.randint(1, 20)))) for _ in range(5)]
        likely = [r.randint(-4, 40) for _ in reads]
        cost, at = al.ungapped(path, reads, k, likely)
        for i, read in enumerate(reads):
            score = lambda o: sum(int(al.PENALTY[x, y]) for x, y in zip(read, path[o : o + len(read)]))  # noqa: E731,B023
            tries = [(score(o), 1, o) for o in range(k, len(path) - len(read) - k + 1)]
            if 0 <= likely[i] <= len(path) - len(read) and score(likely[i]) < 3 * (len(read) // 4):
                tries.append((score(likely[i]), 0, likely[i]))
            want = min(tries, default=(-1, 0, 0))
            assert cost[i] == want[0] and (want[0] < 0 or at[i] == want[2])


def test_gapped_lengths():
    r = random.Random(1)
    for _ in range(300):
        middle = lambda: "".join(r.choice("ATG") for _ in range(r.randint(0, 20)))
        a, b = "ATGAT" + middle() + "GATTA", "ATGAT" + middle() + "GATTA"
        ops = al.spread(al.gapped([al.codes(a)], [al.codes(b)], 5)[0])
        assert sum(c in al.QUERY for c in ops) == len(a) and sum(c in al.REFERENCE for c in ops) == len(b)


def test_rewrite_clip_becomes_insertion():
    # 20M20S with the path 20M4I60M from 100 on: the read's bases are letters 0 to 39 of a stretch from letter 10 on.
    assert al.rewritten(110, "10M30S", 0, 39, "20M4I60M", 10, 49, 100) == (110, "10M4I26M")


def test_rewrite_keeps_query_length():
    r = random.Random(2)
    for _ in range(500):
        own = al.packed("".join(r.choice("MMMMID") for _ in range(r.randint(5, 30))) + "M")
        n = sum(c in al.QUERY for c in al.spread(own))
        path = al.packed("MMMMM" + "".join(r.choice("MMMID") for _ in range(60)) + "M" * 40)
        first = r.randint(0, n - 1)
        last = r.randint(first, n - 1)
        start = r.randint(3, 20)
        pos, out = al.rewritten(50, own, first, last, path, start, start + last - first, 40)
        assert sum(c in al.QUERY for c in al.spread(out)) == n and (pos == 50 or first == 0)


def test_positions():
    assert al.positions(100, "2S3M2I4D2M1S") == [100, 100, 100, 101, 102, 103, 103, 107, 108, 109]


def brute_paths(found, ref, k, letters, longest, shortest):
    out, target = [], ref[-k:]

    def go(text):
        if len(text) > longest:
            return
        for c in letters:
            then = text[len(text) - k + 1 :] + c
            if then == target:
                if shortest <= len(text) + 1 and len(text) + 1 > 2 * k + 1:
                    out.append(text + c)
            elif then in found:
                go(text + c)

    go(ref[:k])
    return out


def test_paths():
    r = random.Random(3)
    for _ in range(200):
        ref = "".join(r.choice("ATG") for _ in range(r.randint(10, 16)))
        found = {ref[i : i + 3] for i in range(len(ref) - 2)} | {"".join(r.choice("ATG") for _ in range(3)) for _ in range(3)}
        want = brute_paths(found, ref, 3, "ATNG", len(ref) + 1, len(ref) - 2)
        assert hp.paths(found, ref, 3, "CT", len(ref) + 1, len(ref) - 2) == want
        assert len(hp.paths(found, ref, 3, "CT", len(ref) + 1, len(ref) - 2, limit=1)) <= 2
        assert set(hp.paths(found, ref, 3, "CT", len(ref) + 1, len(ref) - 2, no_cycles=True)) <= set(want)
    assert hp.with_reference(["A"], "B") == ["A", "B"] and hp.with_reference(["A", "B"], "B") == ["A", "B"]


def test_murmur():
    assert murmur3_low([b"", b"hello"], 0).tolist() == [0, 0xCBD8A7B341BD9B02]
    assert murmur3_low([b"The quick brown fox jumps over the lazy dog"], 0).tolist() == [0xE34BBC7BBC071B6C]
    assert len(set(murmur3_low([b"ATG" * n for n in range(20)]).tolist())) == 20
