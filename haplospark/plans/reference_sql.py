"""SQL for DuckDB that gives the rows of the queries in haplospark.plans.queries."""

from __future__ import annotations

CONTIGS = """contigs AS (
  SELECT CAST(s_suppkey AS INTEGER) AS tid, 'c' || s_suppkey AS name,
         string_agg(translate(md5(s_suppkey || ':' || i), '0123456789abcdef', 'ACGTACGTACGTACGT'), '' ORDER BY i) AS seq
  FROM supplier, range(64) t(i) GROUP BY s_suppkey)"""


def reads(spacing: int = 128) -> str:
    return f"""{CONTIGS}, items AS (
  SELECT l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey AS qname,
         CASE WHEN l_linestatus = 'O' THEN 16 ELSE 0 END AS flag, CAST(l_suppkey AS INTEGER) AS tid,
         CAST(100 + {spacing} * (l_partkey % 14) AS INTEGER) AS site, CAST(l_partkey % 3 AS INTEGER) AS kind,
         CAST(10 + l_orderkey % 41 AS INTEGER) AS o, CAST(l_quantity AS INTEGER) AS mapq,
         CASE WHEN l_returnflag = 'R' THEN 'GA' ELSE 'CT' END AS xg, l_linenumber > 4 AS plain FROM lineitem
), reads AS (
  SELECT qname, flag, i.tid, site - o AS pos, mapq,
         CASE WHEN plain THEN '60M' WHEN kind = 0 THEN o || 'M4I' || (56 - o) || 'M' WHEN kind = 1 THEN o || 'M3D' || (60 - o) || 'M'
              ELSE o || 'M' || (60 - o) || 'S' END AS cigar,
         CASE WHEN plain THEN substr(seq, site - o + 1, 60)
              WHEN kind = 1 THEN substr(seq, site - o + 1, o) || substr(seq, site + 4, 60 - o)
              ELSE substr(seq, site - o + 1, o) || 'CGCG' || substr(seq, site + 1, 56 - o) END AS seq, xg
  FROM items i JOIN contigs c ON i.tid = c.tid)"""


OPS = """ops AS (
  SELECT qname, tid, pos, mapq, cigar, seq, generate_subscripts(o, 1) AS i, unnest(o) AS op, CAST(unnest(n) AS INTEGER) AS len
  FROM (SELECT *, regexp_extract_all(cigar, '(\\d+)([MIDNSHP=XB])', 2) AS o, regexp_extract_all(cigar, '(\\d+)([MIDNSHP=XB])', 1) AS n FROM reads)
), placed AS (
  SELECT *, pos + coalesce(sum(CASE WHEN op IN ('M','D','N','=','X') THEN len ELSE 0 END)
      OVER (PARTITION BY qname, tid, pos, cigar ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ref
  FROM ops)"""
#: Positions of the bases of each distinct pos and cigar.
POSITIONS = """shapes AS (SELECT DISTINCT pos, cigar FROM reads
), shape_ops AS (
  SELECT pos, cigar, generate_subscripts(o, 1) AS i, unnest(o) AS op, CAST(unnest(n) AS INTEGER) AS len
  FROM (SELECT *, regexp_extract_all(cigar, '(\\d+)([MIDNSHP=XB])', 2) AS o, regexp_extract_all(cigar, '(\\d+)([MIDNSHP=XB])', 1) AS n FROM shapes)
), shape_at AS (
  SELECT *, CAST(pos + coalesce(sum(CASE WHEN op IN ('M','D','N','=','X') THEN len ELSE 0 END)
      OVER (PARTITION BY pos, cigar ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS ref
  FROM shape_ops
), bases AS (
  SELECT pos, cigar, flatten(list(CASE WHEN op IN ('M','=','X') THEN list_transform(range(len), lambda x: ref + CAST(x AS INTEGER))
      WHEN op IN ('I','S') THEN list_transform(range(len), lambda x: ref) ELSE CAST([] AS INTEGER[]) END ORDER BY i)) AS places
  FROM shape_at GROUP BY pos, cigar)"""


def events(min_mapq: int = 10) -> str:
    return f"""{OPS}, runs AS (
  SELECT *, i - row_number() OVER (PARTITION BY qname, tid, pos, cigar ORDER BY i) AS run FROM placed WHERE op IN ('I','D') AND mapq >= {min_mapq}
), events AS (
  SELECT qname, tid, CAST(min(ref) AS INTEGER) AS start, CAST(min(ref) + max(len) AS INTEGER) AS "end" FROM runs GROUP BY qname, tid, pos, cigar, run)"""


def islands(source: str, out: str, gap: int) -> str:
    """source(tid, start, end, n) merged."""
    return f"""{out}_u AS (SELECT tid, start, "end", sum(n) AS n FROM {source} GROUP BY tid, start, "end"
), {out}_f AS (SELECT *, CASE WHEN start - max("end") OVER (PARTITION BY tid ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap}
      THEN 0 ELSE 1 END AS opens FROM {out}_u
), {out}_g AS (SELECT *, sum(opens) OVER (PARTITION BY tid ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM {out}_f
), {out} AS (SELECT tid, min(start) AS start, max("end") AS "end", CAST(sum(n) AS BIGINT) AS n FROM {out}_g GROUP BY tid, g)"""


def regions(spacing: int = 128) -> str:
    return f"""{reads(spacing)}, {events()}, one AS (SELECT tid, start, "end", 1 AS n FROM events), {islands('one', 'isl', 10)}, roi AS (SELECT * FROM isl WHERE n >= 4)"""


SPANS = """spans AS (
  SELECT *, greatest(0, pos - CAST(coalesce(nullif(regexp_extract(cigar, '^(\\d+)S', 1), ''), '0') AS INTEGER)) AS span_start,
         pos + CAST(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MDN=X]', 1), lambda x: CAST(x AS INTEGER))) AS INTEGER) - 1 AS span_end FROM reads)"""
PAIRS = f"""{SPANS}, pairs AS (
  SELECT s.*, r.start AS roi_start, r."end" AS roi_end FROM spans s JOIN roi r ON s.tid = r.tid AND span_start <= r."end" AND span_end >= r.start)"""


def members(reach: int) -> str:
    """roi and spans to members: pairs that overlap, and reads that begin before a region's end, not before its first mapped read, within reach of it."""
    return f"""near AS (
  SELECT s.*, r.start AS roi_start, r."end" AS roi_end, span_start <= r."end" AND span_end >= r.start AS direct
  FROM spans s JOIN roi r ON s.tid = r.tid AND span_start <= r."end" AND span_end >= r.start - {reach}
), opening AS (SELECT tid, roi_start, roi_end, min(pos) AS first FROM near WHERE direct AND flag & 4 = 0 GROUP BY ALL
), members AS (SELECT n.* FROM near n JOIN opening o ON n.tid = o.tid AND n.roi_start = o.roi_start AND n.roi_end = o.roi_end WHERE direct OR (pos >= first AND pos < n.roi_end))"""


STRAND = """CASE WHEN xg IS NULL THEN CASE WHEN flag & 1 = 1 THEN
      CASE WHEN flag & 80 = 80 THEN 2 WHEN flag & 64 = 64 THEN 1 WHEN flag & 144 = 144 THEN 1 WHEN flag & 128 = 128 THEN 2 ELSE 0 END
      ELSE CASE WHEN flag & 16 = 16 THEN 2 ELSE 0 END END
  WHEN xg LIKE 'C%' THEN CASE WHEN flag & 81 = 65 THEN 1 WHEN flag & 81 = 81 THEN 3 WHEN flag & 145 = 129 THEN 3 WHEN flag & 145 = 145 THEN 1 WHEN flag & 16 = 16 THEN 3 ELSE 1 END
  ELSE CASE WHEN flag & 81 = 65 THEN 4 WHEN flag & 81 = 81 THEN 2 WHEN flag & 145 = 129 THEN 2 WHEN flag & 145 = 145 THEN 4 WHEN flag & 16 = 16 THEN 2 ELSE 4 END END"""


def ct(x: str) -> str:
    return f"regexp_replace(translate(upper({x}), 'C', 'T'), '[^ATG]', 'N', 'g')"


def ga(x: str) -> str:
    return f"regexp_replace(translate(upper({x}), 'G', 'A'), '[^ACT]', 'N', 'g')"


def both(x: str) -> str:
    return f"CASE WHEN conversion = 'CT' THEN {ct(x)} ELSE {ga(x)} END"


def windows(k: int) -> str:
    return f"""win AS (SELECT *, substr(seq, ref_start + 1, hi + {k} - ref_start) AS ref FROM (
    SELECT r.tid, r.start AS roi_start, r."end" AS roi_end, greatest(0, r.start - {k}) AS lo, r."end" + {k} AS hi, greatest(0, r.start - {2 * k}) AS ref_start, c.seq
    FROM roi r JOIN contigs c ON r.tid = c.tid))"""


def bounded(k: int) -> str:
    return f"""{regions()}, {PAIRS}, {windows(k)}, {POSITIONS}, inside AS (
  SELECT p.qname, p.tid, p.pos, p.cigar, p.seq, p.flag, p.xg, p.roi_start, p.roi_end, w.lo, w.hi, w.ref_start, w.ref, b.places,
         list_filter(range(len(b.places)), lambda i: b.places[i + 1] >= w.lo AND b.places[i + 1] < w.hi) AS ins
  FROM pairs p JOIN win w ON p.tid = w.tid AND p.roi_start = w.roi_start JOIN bases b ON p.pos = b.pos AND p.cigar = b.cigar WHERE p.mapq >= 10
), bounded AS (
  SELECT * EXCLUDE (places, ins), CAST(ins[1] AS INTEGER) AS i0, CAST(ins[-1] AS INTEGER) AS i1, places[ins[1] + 1] AS p0, places[ins[-1] + 1] AS p1,
         CASE WHEN ({STRAND}) % 2 = 1 THEN 'CT' ELSE 'GA' END AS conversion FROM inside WHERE len(ins) > 0)"""


def patched(k: int) -> str:
    text = "substr(ref, 1, p0 - ref_start) || substr(seq, i0 + 1, i1 - i0 + 1) || substr(ref, p1 - ref_start + 2)"
    return f"{bounded(k)}, patched AS (SELECT *, {both(text)} AS patched FROM bounded WHERE p0 - ref_start + i1 - i0 + 1 > {2 * k})"


def counted(k: int) -> str:
    return f"""{patched(k)}, texts AS (SELECT tid, roi_start, roi_end, conversion, patched, count(*) AS times FROM patched GROUP BY ALL
), counted AS (SELECT tid, roi_start, roi_end, conversion, kmer, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT tid, roi_start, roi_end, conversion, times, unnest(list_transform(range(1, length(patched) - {k}), lambda i: substr(patched, CAST(i AS INTEGER) + 1, {k}))) AS kmer FROM texts) GROUP BY ALL)"""


def sufficient(k: int) -> str:
    return f"""{counted(k)}, refs AS (SELECT tid, roi_start, roi_end, ref, lo, conversion, {both('ref')} AS text FROM win, (VALUES ('CT'), ('GA')) v(conversion)
), both_kinds AS (
  SELECT tid, roi_start, roi_end, conversion, kmer, n FROM counted UNION ALL
  SELECT DISTINCT tid, roi_start, roi_end, conversion, unnest(list_transform(range(length(text) - {k - 1}), lambda i: substr(text, CAST(i AS INTEGER) + 1, {k}))), 15 FROM refs
), suff AS (SELECT tid, roi_start, roi_end, conversion, kmer, least(CAST(sum(n) AS BIGINT), 15) AS n FROM both_kinds GROUP BY ALL HAVING least(sum(n), 15) >= 4)"""


INDEL = """indel AS (SELECT tid, roi_start, roi_end, CAST(max(greatest(i1 - i0 - (p1 - p0), 0)) AS INTEGER) AS max_ins,
    CAST(max(greatest((p1 - p0) - (i1 - i0), 0)) AS INTEGER) AS max_del FROM patched GROUP BY ALL)"""


def walks(k: int) -> str:
    return f"""{sufficient(k)}, {INDEL}, ends AS (
  SELECT r.tid, r.roi_start, r.roi_end, r.conversion, r.text, substr(text, 1, {k}) AS head, right(text, {k}) AS tail,
         length(text) + coalesce(max_ins, 0) AS longest, length(text) - coalesce(max_del, 0) AS shortest
  FROM refs r LEFT JOIN indel i ON r.tid = i.tid AND r.roi_start = i.roi_start
), walk AS (
  SELECT tid, roi_start, roi_end, conversion, head AS path, false AS done FROM ends
  UNION ALL
  SELECT w.tid, w.roi_start, w.roi_end, w.conversion, path || c, right(path, {k - 1}) || c = tail
  FROM walk w JOIN ends e ON w.tid = e.tid AND w.roi_start = e.roi_start AND w.conversion = e.conversion
  JOIN (VALUES ('CT','A'),('CT','T'),('CT','N'),('CT','G'),('GA','A'),('GA','T'),('GA','N'),('GA','C')) l(kind, c) ON kind = w.conversion
  LEFT JOIN suff s ON s.tid = w.tid AND s.roi_start = w.roi_start AND s.conversion = w.conversion AND s.kmer = right(path, {k - 1}) || c
  WHERE NOT done AND length(path) <= longest AND (s.kmer IS NOT NULL OR right(path, {k - 1}) || c = tail)
), walked AS (
  SELECT w.tid, w.roi_start, w.roi_end, w.conversion, path FROM walk w JOIN ends e ON w.tid = e.tid AND w.roi_start = e.roi_start AND w.conversion = e.conversion
  WHERE done AND length(path) >= shortest AND length(path) > {2 * k + 1}
), haps AS (
  SELECT tid, roi_start, roi_end, conversion, path FROM walked UNION SELECT tid, roi_start, roi_end, conversion, text FROM ends
), numbered AS (
  SELECT h.*, CAST(CASE WHEN w.path IS NULL THEN count(w.path) OVER g
      ELSE row_number() OVER (PARTITION BY h.tid, h.roi_start, h.conversion ORDER BY w.path IS NULL, translate(translate(h.path, 'N', 'V'), 'GC', 'ZZ')) - 1 END AS INTEGER) AS path_id
  FROM haps h LEFT JOIN walked w ON h.tid = w.tid AND h.roi_start = w.roi_start AND h.conversion = w.conversion AND h.path = w.path
  WINDOW g AS (PARTITION BY h.tid, h.roi_start, h.conversion))"""


def scored(k: int) -> str:
    return f"""{walks(k)}, read_pieces AS (
  SELECT qname, tid, roi_start, roi_end, conversion, {both('substr(seq, i0 + 1, i1 - i0 + 1)')} AS piece, p0 - lo + {k} AS likely FROM bounded
), tries AS (
  SELECT DISTINCT p.tid, p.roi_start, p.conversion, p.piece, p.likely, n.path_id, n.path,
         list_distinct(list_append(range({k}, length(path) - length(piece) - {k} + 1), CAST(likely AS BIGINT))) AS offsets
  FROM read_pieces p JOIN numbered n ON p.tid = n.tid AND p.roi_start = n.roi_start AND p.conversion = n.conversion
), costs AS (
  SELECT * EXCLUDE (offsets), CAST(o AS INTEGER) AS o, CAST(list_sum(list_transform(range(length(piece)), lambda i:
      CASE WHEN path[CAST(o + i + 1 AS INTEGER)] = 'N' THEN 0 WHEN piece[CAST(i + 1 AS INTEGER)] = 'N' THEN 1
           WHEN translate(piece[CAST(i + 1 AS INTEGER)], 'G', 'C') = translate(path[CAST(o + i + 1 AS INTEGER)], 'G', 'C') THEN 0 ELSE 3 END)) AS INTEGER) AS cost
  FROM (SELECT *, unnest(offsets) AS o FROM tries) WHERE o >= 0 AND o + length(piece) <= length(path)
), fair AS (
  SELECT * FROM costs WHERE (o >= {k} AND o <= length(path) - length(piece) - {k}) OR (o = likely AND cost < 3 * (length(piece) // 4))
), best AS (
  SELECT *, row_number() OVER (PARTITION BY tid, roi_start, conversion, piece, likely, path_id ORDER BY cost, CASE WHEN o = likely AND cost < 3 * (length(piece) // 4) THEN 0 ELSE 1 END, o) AS place FROM fair
), scores AS (
  SELECT p.tid, p.roi_start, p.roi_end, p.conversion, p.qname, b.path_id, b.cost AS score, b.o AS "offset"
  FROM read_pieces p JOIN best b ON p.tid = b.tid AND p.roi_start = b.roi_start AND p.conversion = b.conversion AND p.piece = b.piece AND p.likely = b.likely AND place = 1
), voted AS (
  SELECT tid, roi_start, roi_end, conversion, path_id, count(*) AS n FROM (
    SELECT *, min(score) OVER (PARTITION BY tid, roi_start, qname) AS low FROM scores) WHERE score = low GROUP BY ALL
), picked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.tid, s.roi_start, qname ORDER BY score, n DESC NULLS LAST, s.path_id) AS place
  FROM scores s LEFT JOIN voted v ON s.tid = v.tid AND s.roi_start = v.roi_start AND s.conversion = v.conversion AND s.path_id = v.path_id)"""


#: Mismatches and covered bases of each read as it is, and if it were 60M.
DISTANCE = """m AS (
  SELECT qname, a.tid, pos, cigar, mapq, op, len, substr(a.seq, CAST(1 + coalesce(sum(CASE WHEN op IN ('M','I','S','=','X') THEN len ELSE 0 END)
      OVER (PARTITION BY qname, a.tid, pos, cigar ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER), len) AS own,
      substr(c.seq, CAST(ref AS INTEGER) + 1, len) AS there FROM placed a JOIN contigs c ON a.tid = c.tid
), dist AS (
  SELECT qname, tid, pos, cigar, CAST(sum(hamming(own, there)) AS INTEGER) AS mismatches, CAST(sum(len) AS INTEGER) AS covered
  FROM (SELECT * FROM m WHERE op IN ('M','=','X') AND length(own) = length(there)) GROUP BY ALL)"""


def aligned(k: int) -> str:
    """numbered to cigars: paths on their references, one anti-diagonal of all matrices in a step, and the way back from the end.

    A cell is struct(s: its score, m, n, e: whether a match, an insertion, a deletion is a best way into it); list index i + 1 is row i.
    """
    first = "-(5 + 3 * (d + 1))"
    fit = "CASE WHEN b[CAST(d + 1 - i AS INTEGER)] = 'N' THEN 0 WHEN a[CAST(i AS INTEGER)] = 'N' THEN 1 WHEN a[CAST(i AS INTEGER)] = b[CAST(d + 1 - i AS INTEGER)] THEN 0 ELSE 3 END"
    moves = f"""CASE WHEN i > d + 1 OR d + 1 - i > c THEN NULL
        WHEN i = 0 THEN struct_pack(m := CAST(NULL AS INTEGER), n := CAST(NULL AS INTEGER), e := CAST({first} AS INTEGER))
        WHEN i = d + 1 THEN struct_pack(m := CAST(NULL AS INTEGER), n := CAST({first} AS INTEGER), e := CAST(NULL AS INTEGER))
        ELSE struct_pack(m := two[i].s - {fit}, n := one[i].s - 3 - CASE WHEN one[i].n THEN 0 ELSE 5 END, e := one[i + 1].s - 3 - CASE WHEN one[i + 1].e THEN 0 ELSE 5 END) END"""
    best = "greatest(x.m, x.n, x.e)"
    cell = f"CASE WHEN x IS NULL THEN NULL ELSE struct_pack(s := {best}, m := coalesce(x.m = {best}, false), n := coalesce(x.n = {best}, false), e := coalesce(x.e = {best}, false)) END"
    return f"""{walks(k)}, pair AS (
  SELECT row_number() OVER () AS pid, path, text, substr(path, {k}, length(path) - {2 * k - 2}) AS a, substr(text, {k}, length(text) - {2 * k - 2}) AS b
  FROM (SELECT DISTINCT n.path, e.text FROM numbered n JOIN ends e ON n.tid = e.tid AND n.roi_start = e.roi_start AND n.conversion = e.conversion WHERE n.path <> e.text)
), dp AS (
  SELECT pid, a, b, CAST(length(a) AS INTEGER) AS r, CAST(length(b) AS INTEGER) AS c, 0 AS d, [struct_pack(s := 0, m := false, n := false, e := false)] AS one,
         CAST([] AS STRUCT(s INTEGER, m BOOLEAN, n BOOLEAN, e BOOLEAN)[]) AS two FROM pair
  UNION ALL
  SELECT pid, a, b, r, c, d + 1, list_transform(list_transform(range(0, least(r, d + 1) + 1), lambda i: {moves}), lambda x: {cell}), one FROM dp WHERE d < r + c
), back AS (
  SELECT pid, r AS i, c AS j, 'M' AS way, '' AS ops FROM dp WHERE d = 0
  UNION ALL
  SELECT pid, i - CASE WHEN w <> 'D' THEN 1 ELSE 0 END, j - CASE WHEN w <> 'I' THEN 1 ELSE 0 END, w, w || ops FROM (
    SELECT t.pid, t.i, t.j, t.ops, CASE WHEN (t.way = 'M' AND x.one[t.i + 1].m) OR (t.way = 'I' AND x.one[t.i + 1].n) OR (t.way = 'D' AND x.one[t.i + 1].e) THEN t.way
        WHEN x.one[t.i + 1].m THEN 'M' WHEN x.one[t.i + 1].n THEN 'I' ELSE 'D' END AS w
    FROM back t JOIN dp x ON x.pid = t.pid AND x.d = t.i + t.j WHERE t.i > 0 AND t.j > 0)
), cigars AS (
  SELECT path, text, array_to_string(list_transform(regexp_extract_all(repeat('M', {k - 1}) || repeat('D', j) || repeat('I', i) || ops || repeat('M', {k - 1}), 'M+|I+|D+'), lambda x: length(x) || x[1]), '') AS cigar
  FROM back JOIN pair ON back.pid = pair.pid WHERE i = 0 OR j = 0)"""


#: The low word of the murmur hash of 128 bits of kmers of 25 letters, step by step; counted(kmer, ...).
def murmur() -> str:
    m = "18446744073709551616"
    mul = lambda a, b: f"CAST((CAST({a} AS UHUGEINT) * CAST({b} AS UHUGEINT)) % CAST({m} AS UHUGEINT) AS UBIGINT)"
    add = lambda a, b: f"CAST((CAST({a} AS UHUGEINT) + CAST({b} AS UHUGEINT)) % CAST({m} AS UHUGEINT) AS UBIGINT)"
    turn = lambda x, r: f"CAST((CAST({x} AS UHUGEINT) * CAST({1 << r} AS UHUGEINT)) % CAST({m} AS UHUGEINT) + CAST({x} AS UHUGEINT) // CAST({1 << 64 - r} AS UHUGEINT) AS UBIGINT)"
    word = lambda at, n: " + ".join(f"CAST(ascii(kmer[{at + j + 1}]) AS UBIGINT) * CAST({256**j} AS UBIGINT)" for j in range(n))
    c1, c2, seed = 0x87C37B91114253D5, 0x4CF5AD432745937F, 0xAAAAAAAA
    steps = [
        ("w", f"SELECT *, {word(0, 8)} AS k1, {word(8, 8)} AS k2, {word(16, 8)} AS t1, {word(24, 1)} AS t2 FROM (SELECT DISTINCT kmer FROM counted)"),
        ("x1", f"SELECT *, {mul('k1', c1)} AS p, {mul('k2', c2)} AS q, {mul('t1', c1)} AS u, {mul('t2', c2)} AS v FROM w"),
        ("x2", f"SELECT *, {turn('p', 31)} AS p2, {turn('q', 33)} AS q2, {turn('u', 31)} AS u2, {turn('v', 33)} AS v2 FROM x1"),
        ("x3", f"SELECT kmer, {mul('p2', c2)} AS p3, {mul('q2', c1)} AS q3, {mul('u2', c2)} AS u3, {mul('v2', c1)} AS v3 FROM x2"),
        ("x4", f"SELECT *, xor(CAST({seed} AS UBIGINT), p3) AS low, xor(CAST({seed} AS UBIGINT), q3) AS high FROM x3"),
        ("x5", f"SELECT * REPLACE ({add(mul(add(turn('low', 27), seed), 5), 0x52DCE729)} AS low) FROM x4"),
        ("x6", f"SELECT * REPLACE ({add(mul(add(turn('high', 31), 'low'), 5), 0x38495AB5)} AS high) FROM x5"),
        ("x7", "SELECT kmer, xor(xor(low, u3), CAST(25 AS UBIGINT)) AS low, xor(xor(high, v3), CAST(25 AS UBIGINT)) AS high FROM x6"),
        ("x8", f"SELECT kmer, {add('low', 'high')} AS low, high FROM x7"),
        ("x9", f"SELECT kmer, low, {add('low', 'high')} AS high FROM x8"),
    ]
    for i, factor in enumerate((0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)):
        steps.append((f"y{i}", f"SELECT kmer, {mul('xor(low, low >> 33)', factor)} AS low, {mul('xor(high, high >> 33)', factor)} AS high FROM {'x9' if not i else 'y0'}"))
    steps.append(("hashed", f"SELECT kmer, {add('xor(low, low >> 33)', 'xor(high, high >> 33)')} AS h FROM y1"))
    return ", ".join(f"{name} AS ({text})" for name, text in steps)


def _spread(cigar: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({cigar}, '\\d+[MIDNSHP=X]'), lambda x: repeat(right(x, 1), CAST(left(x, length(x) - 1) AS INTEGER))), '')"


def _packed(ops: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({ops}, 'M+|I+|D+|N+|S+|H+|P+|=+|X+'), lambda x: length(x) || x[1]), '')"


def _cut(ops: str, bases: str) -> str:
    """How many letters of spread operations hold so many bases."""
    return f"CASE WHEN {bases} = 0 THEN 0 ELSE list_filter(range(1, length({ops}) + 1), lambda i: {ops}[CAST(i AS INTEGER)] IN ('M', 'I', 'S', '=', 'X'))[CAST({bases} AS INTEGER)] END"


def realigned(k: int) -> str:
    """The query realign_full, from reads to reads, where no read meets two regions: votes, choice, new CIGARs, distances and the rule of acceptance.

    Names of reads get what may differ between equal ones, and lose it at the end.
    """
    both = f"{scored(k)}, {aligned(k)[len(walks(k)) + 2:]}"
    both = both.replace(PAIRS, f"{PAIRS}, {members(k)}").replace("FROM pairs p JOIN win w", "FROM members p JOIN win w")
    both = both.replace("SELECT qname, flag, i.tid, site - o AS pos, mapq,", "SELECT qname || '|' || flag || '|' || xg || '|' || mapq AS qname, flag, i.tid, site - o AS pos, mapq,")
    ops = OPS.replace("FROM reads", "FROM alts").replace("ops AS (", "alt_ops AS (").replace("FROM ops", "FROM alt_ops").replace("placed AS (", "alt_placed AS (")
    distance = DISTANCE.replace("FROM placed a", "FROM alt_placed a").replace("m AS (", "alt_m AS (").replace("FROM m ", "FROM alt_m ").replace("dist AS (", "alt_dist AS (")
    return f"""{both}, chosen AS (
  SELECT DISTINCT p.qname, p.tid, b.pos, b.cigar, b.seq, b.i0, b.i1, b.ref_start, p."offset" AS o, {_spread('b.cigar')} AS own, {_spread('g.cigar')} AS along
  FROM picked p JOIN numbered n ON p.tid = n.tid AND p.roi_start = n.roi_start AND p.conversion = n.conversion AND p.path_id = n.path_id
  JOIN ends e ON e.tid = p.tid AND e.roi_start = p.roi_start AND e.conversion = p.conversion JOIN cigars g ON g.path = n.path AND g.text = e.text
  JOIN bounded b ON b.qname = p.qname AND b.tid = p.tid AND b.roi_start = p.roi_start WHERE place = 1
), cuts AS (
  SELECT *, {_cut('along', 'o')} AS begins, {_cut('along', '(o + i1 - i0 + 1)')} AS stops, {_cut('own', 'i0')} AS head_end, {_cut('own', '(i1 + 1)')} AS tail_from FROM chosen
), parts AS (
  SELECT *, substr(along, begins + 1, stops - begins) AS middle, substr(own, tail_from + 1) AS tail, regexp_extract(substr(along, begins + 1, stops - begins), '^D*') AS skipped FROM cuts
), made AS (
  SELECT qname, tid, pos, cigar, seq,
         CAST(CASE WHEN i0 > 0 THEN pos ELSE ref_start + length(regexp_replace(left(along, begins), '[^MDN=X]', '', 'g')) + length(skipped) END AS INTEGER) AS new_pos,
         {_packed("CASE WHEN i0 > 0 THEN left(own, head_end) || middle ELSE regexp_extract(own, '^H*') || substr(middle, length(skipped) + 1) END || CASE WHEN regexp_matches(tail, '[MIS=X]') THEN tail ELSE regexp_replace(tail, '[^H]', '', 'g') END")} AS new_cigar
  FROM parts
), differ AS (SELECT * FROM made WHERE new_pos <> pos OR new_cigar <> cigar
), alts AS (
  SELECT qname || '|old' AS qname, tid, pos, 0 AS mapq, cigar, seq FROM differ UNION ALL SELECT qname || '|new', tid, new_pos, 0, new_cigar, seq FROM differ
), {ops}, {distance}, accepted AS (
  SELECT d.qname, d.tid, d.pos, d.cigar, new_pos, new_cigar FROM differ d
  JOIN alt_dist a ON a.qname = d.qname || '|old' AND a.tid = d.tid JOIN alt_dist b ON b.qname = d.qname || '|new' AND b.tid = d.tid
  WHERE NOT (b.mismatches > a.mismatches AND b.mismatches - a.mismatches >= b.covered - a.covered)
)
SELECT split_part(r.qname, '|', 1) AS qname, r.flag, r.tid, coalesce(new_pos, r.pos) AS pos, coalesce(new_cigar, r.cigar) AS cigar,
       CASE WHEN new_pos <> r.pos THEN r.pos + 1 END AS op, CASE WHEN new_cigar <> r.cigar THEN r.cigar END AS oc
FROM reads r LEFT JOIN accepted a ON a.qname = r.qname AND a.tid = r.tid AND a.pos = r.pos AND a.cigar = r.cigar"""
