"""Realignment of reads around regions: assembly of haplotypes, votes, and new positions and CIGARs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from haplospark import storage
from haplospark.functions import bisulfite, cigar
from haplospark.operators import alignment, assembly, haplotypes, kmers, overlap


@dataclass(frozen=True)
class Settings:
    """k: letters of a k-mer, odd (an even one becomes the next). The others bound reads, k-mers and paths; 0 for breadth and max_insert is no bound."""

    k: int = 25
    min_mapq: int = 10
    min_kmer_count: int = 4
    max_insert: int = 0
    breadth: int = 300
    no_cycles: bool = False
    max_reads: int = 1000
    single_end_forward_is_top: bool = False
    stop_at_short: bool = False
    #: Without effect: chains of any length are taken in order. Kept for callers that set it.
    max_chain_reads: int = 20_000

    @property
    def size(self) -> int:
        return self.k + (self.k + 1) % 2

    def path_limit(self, start: int, end: int) -> int:
        return self.breadth + 2 * (end - start - 1) if self.breadth else 0

    def longest(self, length: int, max_ins: int) -> int:
        return length + (min(self.max_insert, max_ins) if self.max_insert else max_ins)


_REGION = ["tid", "roi_start", "roi_end"]


def haplotype_paths(found: DataFrame, windows: DataFrame, indels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """tid, roi_start, roi_end, conversion, path_id, path, too_many: the paths of each region and conversion, the reference included.

    found: sufficient k-mers; windows: of the regions; indels: most_indel. A group is one region's k-mers, bounded by the
    reads of a region. too_many: the region has more paths than the bound and isn't realigned.
    """
    schema = "tid int, roi_start int, roi_end int, conversion string, path_id int, path string, too_many boolean"

    def walk(key: tuple, rows: pa.Table, info: pa.Table) -> pa.Table:
        tid, start, end = (x.as_py() for x in key)
        own = info.to_pylist()[:1]
        out = []
        for r in own:
            known: dict[str, set[str]] = {"CT": set(), "GA": set()}
            for kind, kmer in zip(rows.column("conversion").to_pylist(), rows.column("kmer").to_pylist()):
                known[kind].add(kmer)
            limit = settings.path_limit(start, end)
            for kind in ("CT", "GA"):
                ref = r[kind]
                got = haplotypes.paths(known[kind], ref, settings.size, kind, settings.longest(len(ref), r["max_ins"] or 0), len(ref) - (r["max_del"] or 0), limit, settings.no_cycles, settings.stop_at_short)
                many = bool(limit) and len(got) > limit
                out += [(tid, start, end, kind, i, p, many) for i, p in enumerate(haplotypes.with_reference(got, ref))]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.bool_())
        names = [x.split()[0] for x in schema.split(", ")]
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names)

    text = windows.select(*(F.col(c).cast("int") for c in _REGION), bisulfite.c_to_t(F.col("ref")).alias("CT"), bisulfite.g_to_a(F.col("ref")).alias("GA"))
    info = text.join(indels.select(*(F.col(c).cast("int") for c in _REGION), "max_ins", "max_del"), _REGION, "left")
    found = found.select(*(F.col(c).cast("int") for c in _REGION), "conversion", "kmer")
    return found.groupBy(*_REGION).cogroup(info.groupBy(*_REGION)).applyInArrow(walk, schema)


def assembled(pairs: DataFrame, windows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """haplotype_paths of regions by their windows and the pairs of gated reads and regions; k-mers are shuffled in packed form only."""
    k = settings.size
    if k <= assembly.LONGEST_K and not settings.no_cycles and not settings.stop_at_short:
        return assembly.haplotypes(pairs, windows, settings)
    return haplotype_paths(assembly.sufficient(pairs, windows, k), windows, kmers.most_indel(assembly.patches(pairs, k)), settings)


def read_scores(reads: DataFrame, paths: DataFrame, k: int) -> DataFrame:
    """tid, roi_start, roi_end, conversion, qname, path_id, score, offset: each read's best place in each path of its conversion.

    reads: bounded and gated pairs with qname, conversion, piece (the converted bases in the window) and likely.
    """
    schema = "tid int, roi_start int, roi_end int, conversion string, qname string, path_id int, score int, offset int"
    names = [x.split()[0] for x in schema.split(", ")]

    def score(key: tuple, rows: pa.Table, texts: pa.Table) -> pa.Table:
        wanted = sorted(set(zip(rows.column("piece").to_pylist(), rows.column("likely").to_pylist())))
        coded, likely = [alignment.codes(p) for p, _ in wanted], [at for _, at in wanted]
        known: dict[tuple, list[tuple]] = {w: [] for w in wanted}
        for i, path in sorted(zip(texts.column("path_id").to_pylist(), texts.column("path").to_pylist())):
            for w, cost, at in zip(wanted, *(x.tolist() for x in alignment.ungapped(alignment.codes(path), coded, k, likely))):
                if cost >= 0:
                    known[w].append((i, cost, at))
        out = [(name, *hit) for name, *w in zip(*(rows.column(c).to_pylist() for c in ("qname", "piece", "likely"))) for hit in known[tuple(w)]]
        fixed = [pa.array([x.as_py()] * len(out), t) for x, t in zip(key, (pa.int32(), pa.int32(), pa.int32(), pa.string()))]
        return pa.table([*fixed, *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int32())))], names)

    group = [*_REGION, "conversion"]
    cast = [F.col(c).cast("int") for c in _REGION]
    left = reads.select(*cast, "conversion", "qname", "piece", "likely").groupBy(*group)
    return left.cogroup(paths.select(*cast, "conversion", "path_id", "path").groupBy(*group)).applyInArrow(score, schema)


def pieces(bounded: DataFrame, k: int) -> DataFrame:
    """bounded with conversion, piece and likely (where a read without an indel would lie in its path)."""
    kind = bisulfite.conversion(bisulfite.strand(F.col("flag"), F.col("xg")))
    rows = bounded.withColumn("conversion", kind).withColumn("likely", F.col("p0") - F.col("lo") + k)
    return rows.withColumn("piece", bisulfite.converted(F.expr("substring(seq, i0 + 1, i1 - i0 + 1)"), F.col("conversion")))


def votes(scores: DataFrame) -> DataFrame:
    """tid, roi_start, roi_end, conversion, path_id, n: each read counts for every path at its least penalty."""
    least = F.min("score").over(Window.partitionBy(*_REGION, "qname"))
    return scores.withColumn("least", least).where("score = least").groupBy(*_REGION, "conversion", "path_id").agg(F.count("*").alias("n"))


def assigned(scores: DataFrame, counted: DataFrame) -> DataFrame:
    """tid, roi_start, roi_end, conversion, qname, path_id, score, offset: of a read's best paths the one with most votes, then the first."""
    ranked = scores.join(counted, [*_REGION, "conversion", "path_id"], "left")
    order = Window.partitionBy(*_REGION, "qname").orderBy("score", F.desc("n"), "path_id")
    return ranked.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place", "n")


class _Kept(dict):
    """Letters as they are converted; any other becomes N."""

    def __missing__(self, _: int) -> str:
        return "N"


_CONVERTED = {"CT": _Kept(str.maketrans("ACGTacgt", "ATGTATGT")), "GA": _Kept(str.maketrans("ACGTacgt", "ACATACAT"))}


def converted(text: str, kind: str) -> str:
    return text.translate(_CONVERTED[kind])


class Region:
    """One region with the text of the reference around it: takes reads (mutable rows), assembles haplotypes and moves reads onto them.

    text begins at text_start and holds the region's window and whatever its reads can reach.
    """

    def __init__(self, start: int, end: int, text: str, text_start: int, settings: Settings):
        k, self.s = settings.size, settings
        self.start, self.end, self.text, self.text_start = start, end, text.upper(), text_start
        self.lo, self.hi, self.ref_start = max(0, start - k), end + k, max(0, start - 2 * k)
        ref = self.text[self.ref_start - text_start : self.hi + k - text_start]
        self.refs = {kind: converted(ref, kind) for kind in _CONVERTED}
        self.held: list[tuple] = []

    def inside(self, read: dict) -> tuple[int, int, int, int] | None:
        return alignment.bounds(read["pos"], read["cigar"], len(read["seq"]), self.lo, self.hi)

    def paths(self, found: list[tuple]) -> dict[str, list[str]] | None:
        """The haplotypes of either conversion, or None if there are too many."""
        k, texts = self.s.size, Counter()
        max_ins = max_del = 0
        for read, (i0, i1, p0, p1) in found:
            if p0 - self.ref_start + i1 - i0 + 1 <= 2 * k:
                continue
            more = i1 - i0 - (p1 - p0)
            max_ins, max_del = max(max_ins, more), max(max_del, -more)
            ref = self.refs[read["kind"]]
            texts[read["kind"], ref[: p0 - self.ref_start] + converted(read["seq"][i0 : i1 + 1], read["kind"]) + ref[p1 - self.ref_start + 1 :]] += 1
        counts: dict[str, Counter] = {kind: Counter() for kind in self.refs}
        for (kind, text), times in texts.items():
            own = counts[kind]
            for i in range(1, len(text) - k):
                own[text[i : i + k]] += times
        limit, out = self.s.path_limit(self.start, self.end), {}
        for kind, ref in self.refs.items():
            known = {m for m, n in counts[kind].items() if n >= self.s.min_kmer_count} | {ref[i : i + k] for i in range(len(ref) - k + 1)}
            out[kind] = haplotypes.paths(known, ref, k, kind, self.s.longest(len(ref), max_ins), len(ref) - max_del, limit, self.s.no_cycles, self.s.stop_at_short)
            if limit and len(out[kind]) > limit:
                return None
        return {kind: haplotypes.with_reference(p, self.refs[kind]) for kind, p in out.items()}

    def assign(self, reads: list[dict]) -> list[tuple[str, str]]:
        """Gives each read its haplotype, and returns the haplotypes other than the reference that reads lie on, each with its reference."""
        k = self.s.size
        found = [(r, at) for r in reads if r["mapq"] is not None and r["mapq"] >= self.s.min_mapq and (at := self.inside(r))]
        if len(self.refs["CT"]) < 2 * k + 1 or (texts := self.paths(found)) is None:
            return []
        wanted: dict[tuple, list[tuple]] = {}
        for read, at in found:
            wanted.setdefault((read["kind"], read["seq"][at[0] : at[1] + 1], at[2] - self.lo + k), []).append((read, at))
        votes = {kind: np.zeros(len(p), np.int64) for kind, p in texts.items()}
        placed = []
        for kind, paths in texts.items():
            keys = [key for key in wanted if key[0] == kind]
            if not keys:
                continue
            pieces, likely = [alignment.codes(converted(key[1], kind)) for key in keys], [key[2] for key in keys]
            hits = [alignment.ungapped(alignment.codes(p), pieces, k, likely) for p in paths]
            score, offset = (np.stack([h[i] for h in hits]) for i in (0, 1))
            cost = np.where(score < 0, np.iinfo(np.int64).max, score)
            best = (cost == cost.min(0)) & (score >= 0)
            votes[kind] += best @ np.array([len(wanted[key]) for key in keys])
            placed.append((kind, keys, best, offset))
        needed: dict[tuple[str, str], None] = {}
        for kind, keys, best, offset in placed:
            # Of a read's best paths the one with most votes, then the first.
            chosen = np.where(best, votes[kind][:, None], -1).argmax(0)
            for i, key in enumerate(keys):
                path = texts[kind][chosen[i]]
                if best[chosen[i], i] and path != self.refs[kind]:
                    needed[path, self.refs[kind]] = None
                    self.held += [(read, at, (path, self.refs[kind]), int(offset[chosen[i], i])) for read, at in wanted[key]]
        return list(needed)

    def move(self, cigars: dict[tuple[str, str], str]) -> None:
        """Changes pos, cigar, op and oc of the reads that lie no worse on their haplotype, given the haplotypes' CIGARs."""
        new = []
        for read, (i0, i1, _, _), path, offset in self.held:
            pos, text = alignment.rewritten(read["pos"], read["cigar"], i0, i1, cigars[path], offset, offset + i1 - i0, self.ref_start)
            if (pos, text) != (read["pos"], read["cigar"]):
                new.append((read, pos, text))
        seqs, n = [read["seq"] for read, _, _ in new], len(new)
        old, was = alignment.distances([r["pos"] for r, _, _ in new], [r["cigar"] for r, _, _ in new], seqs, [self.text] * n, [self.text_start] * n)
        then, now = alignment.distances([pos for _, pos, _ in new], [text for _, _, text in new], seqs, [self.text] * n, [self.text_start] * n)
        for (read, pos, text), worse in zip(new, (then > old) & (then - old >= now - was)):
            if worse:
                continue
            if pos != read["pos"] and read["op"] is None:
                read["op"] = read["pos"] + 1
            if text != read["cigar"] and read["oc"] is None:
                read["oc"] = read["cigar"]
            read["pos"], read["cigar"] = pos, text


def realign_together(regions: list[tuple[Region, list[dict]]], k: int) -> None:
    """Realigns the reads of regions that share none; their haplotypes meet the reference in one batch."""
    needed = dict.fromkeys(pair for region, reads in regions for pair in region.assign(reads))
    cigars = alignment.gapped([alignment.codes(p) for p, _ in needed], [alignment.codes(r) for _, r in needed], k)
    for region, _ in regions:
        region.move(dict(zip(needed, cigars)))


#: Regions whose haplotypes are aligned in one batch.
TOGETHER = 64


class _Pass:
    """The pass of one task over its regions and their reads, in order."""

    def __init__(self, settings: Settings, out: pa.Schema):
        self.s, self.out = settings, out
        self.held: dict[tuple, dict] = {}  # reads whose regions may not all have come yet
        self.open: tuple[Region, list[tuple]] | None = None  # the region whose reads are coming
        self.waiting: list[tuple[Region, list[dict]]] = []
        self.busy: set[tuple] = set()

    def close(self) -> None:
        """The open region is complete. One that shares a read with those that wait comes after them."""
        if self.open:
            region, members = self.open
            if any(key in self.busy for key, _ in members):
                self.work()
            self.waiting.append((region, [read for _, read in members]))
            self.busy.update(key for key, _ in members)
            self.open = None

    def work(self) -> None:
        realign_together(self.waiting, self.s.size)
        self.waiting, self.busy = [], set()

    def done(self, tid: int | None = None, start: int = 0) -> Iterator[pa.RecordBatch]:
        """The reads that no region of that contig from *start* on can have, after all regions so far."""
        self.close()
        self.work()
        over = {key: r for key, r in self.held.items() if r["tid"] != tid or r["reach"] + self.s.size < start}
        self.held = {key: r for key, r in self.held.items() if key not in over}
        by: dict[int, list[dict]] = {}
        for r in over.values():
            by.setdefault(id(r["rest"]), []).append(r)
        for reads in by.values():
            rest = reads[0]["rest"].take(pa.array([r["at"] for r in reads]))
            columns = dict(zip(self.out.names, rest.flatten()))
            columns |= {c: pa.array([r[c] for r in reads], self.out.field(c).type) for c in ("pos", "cigar", "op", "oc")}
            yield pa.RecordBatch.from_arrays([columns[c].cast(self.out.field(c).type) for c in self.out.names], self.out.names)
        for r in self.held.values():
            if len(r["rest"]) > 1:  # a copy, for a slice would keep its batch
                r["rest"], r["at"] = r["rest"].take(pa.array([r["at"]])), 0

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            rest = batch.column("rest")
            field = lambda c: rest.field(c).to_pylist()
            rows = zip(*(batch.column(c).to_pylist() for c in ("tid", "roi_start", "roi_end", "text", "text_start", "kind", "h1", "h2", "reach")), *map(field, ("pos", "cigar", "seq", "mapq", "op", "oc")))
            for i, (tid, start, end, text, text_start, kind, h1, h2, reach, *own) in enumerate(rows):
                if text is not None:
                    self.close()
                    if len(self.waiting) >= TOGETHER:
                        yield from self.done(tid, start)
                    self.open, seen = (Region(start, end, text, text_start, self.s), []), Counter()
                    continue
                # Equal rows have one hash: the n-th in a region is the n-th in each.
                key = tid, h1, h2, seen[h1, h2]
                seen[h1, h2] += 1
                if key not in self.held:
                    self.held[key] = {"rest": rest, "at": i, "tid": tid, "kind": kind, "reach": reach, **dict(zip(("pos", "cigar", "seq", "mapq", "op", "oc"), own))}
                self.open[1].append((key, self.held[key]))
        yield from self.done()


def _row_hashes(reads: DataFrame) -> list[Column]:
    """Two hashes of 64 bits of a whole row; maps count by their sorted entries."""
    parts = [F.array_sort(F.map_entries(f"`{c}`")) if t.startswith("map") else F.col(f"`{c}`") for c, t in reads.dtypes]
    return [F.xxhash64(F.lit(seed), *parts).alias(name) for seed, name in ((1, "h1"), (2, "h2"))]


def realign(reads: DataFrame, regions: DataFrame, contigs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The reads with new pos and cigar, and op (old position, from 1) and oc (old CIGAR) where they changed; each row once.

    Regions that share a read form a chain and are taken in order in one task, a read meeting the next
    region with its new CIGAR.  The task streams over regions and their reads and holds those reads that later
    regions may have, so a chain may be of any length.  Regions of more than max_reads reads are left out first.
    A region brings the reference once, as far as its reads can reach.  Reads outside regions are found by an anti-join on
    128 bits of hashes of the row, so equal rows share their fate, and pass unchanged.  Columns may have any names.
    """
    size, has = settings.size, reads.columns
    types = {"pos": T.IntegerType(), "cigar": T.StringType(), "op": T.IntegerType(), "oc": T.StringType()}
    missing = [c for c in ("op", "oc") if c not in has]
    reads = reads.select(*(F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in has), *(F.lit(None).cast(types[c]).alias(c) for c in missing))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in reads.schema.fields])
    # A row is one column, so that no name of its columns can meet one of those made here.
    kind = bisulfite.conversion(bisulfite.strand(F.col("flag"), F.col("xg"), settings.single_end_forward_is_top))
    whole = reads.select(F.struct(*(F.col(f"`{c}`") for c in reads.columns)).alias("rest"), *_row_hashes(reads), "tid", "pos", "cigar", "flag", kind.alias("kind"), F.col("seq").isNotNull().alias("readable"))
    regions = storage.stored(regions.selectExpr("cast(tid as int) tid", "cast(start as int) start", "cast(end as int) end").distinct(), "regions")
    usable = whole.where("pos is not null and cigar is not null and readable and tid is not null")
    pairs = overlap.grouped(usable, regions, size).select("rest", "h1", "h2", "kind", "tid", "roi_start", "roi_end", "span_start", "span_end")
    pairs = storage.stored(pairs, "pairs")
    few = overlap.capped(pairs, settings.max_reads).where("not skipped").select(*_REGION)
    narrow = pairs.select("h1", "h2", *_REGION, "span_start", "span_end").join(few, _REGION)
    chains = overlap.chained(narrow, size)
    # Each of its regions moves an end of a read by that region's window at most; equal rows count once.
    own, here = Window.partitionBy("tid", "h1", "h2"), Window.partitionBy("tid", "h1", "h2", "roi_start", "roi_end")
    moves = F.sum(F.expr(f"cast(roi_end - roi_start + {4 * size} as bigint)")).over(own) / F.count("*").over(here)
    reach = narrow.withColumn("moves", moves.cast("bigint")).groupBy(*_REGION).agg(F.min(F.expr("span_start - moves")).alias("low"), F.max(F.expr("span_end + moves")).alias("high"))
    areas = reach.join(chains, _REGION).withColumns({
        "text_start": F.greatest(F.lit(0), F.least(F.col("low"), F.col("roi_start") - 2 * size)).cast("int"),
        "text_end": F.greatest(F.col("high") + 1, F.col("roi_end") + 2 * size).cast("int"),
    })
    areas = storage.stored(areas.drop("low", "high"), "areas")
    texts = overlap.fetched(areas, contigs, "text_start", "text_end", "text")
    order = ["tid", "chain", "roi_start", "roi_end"]
    nothing = {"rest": F.lit(None).cast(pairs.schema["rest"].dataType), "h1": F.lit(None).cast("bigint"), "h2": F.lit(None).cast("bigint"), "kind": F.lit(None).cast("string"), "reach": F.lit(None).cast("int")}
    heads = texts.select(*order, "text", "text_start", *(v.alias(c) for c, v in nothing.items()))
    # A region whose contig is not there has no text, so its reads pass as they are.
    members = pairs.join(texts.select(*order), _REGION)
    rows = members.select(*order, F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("text_start"), "rest", "h1", "h2", "kind", F.col("span_end").alias("reach"))
    arrow = to_arrow_schema(schema)
    stream = heads.unionByName(rows).repartition("tid", "chain").sortWithinPartitions("tid", "chain", "roi_start", "roi_end", F.col("text").isNull())
    changed = stream.drop("chain").mapInArrow(lambda batches: _Pass(settings, arrow).run(batches), schema)
    passed = whole.join(members.select("h1", "h2").distinct(), ["h1", "h2"], "left_anti").select("rest.*")
    return changed.unionByName(passed)


def coordinate_sorted(reads: DataFrame) -> DataFrame:
    """The reads in a total order by contig, position, end, name and flag; those without a contig or a position come last."""
    end = cigar.last_position(F.col("pos"), F.col("cigar")) + 1
    return reads.withColumn("endpos", end).orderBy(F.asc_nulls_last("tid"), F.asc_nulls_last("pos"), "endpos", "qname", "flag")


def bounded_pairs(reads: DataFrame, regions: DataFrame, contigs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Pairs of gated reads and regions with the region's window and the read's bounds in it."""
    k = settings.size
    pairs = overlap.overlapping(overlap.spans(reads.where(F.col("mapq") >= settings.min_mapq)), regions)
    return kmers.bounds(pairs.join(overlap.windows(regions, contigs, k), _REGION))


def windowed_pairs(reads: DataFrame, windows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Pairs of gated reads and regions, of which the windows are there already: these go with the regions through the join by overlap."""
    regions = windows.withColumnsRenamed({"roi_start": "start", "roi_end": "end"})
    return overlap.overlapping(reads.where(F.col("mapq") >= settings.min_mapq), regions, ("lo", "hi", "ref_start", "ref"), overlap.spans_by_shape)
