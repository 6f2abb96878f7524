"""Operators on small hand-made tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from haplospark.functions import bisulfite, cigar, udtf
from haplospark.operators import alignment, assembly, kmers, overlap, realign, targets
from haplospark.sources import bam, bed, bgzf, fasta, sam

EVENTS = "tid int, start int, end int"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_cigar_columns(spark):
    df = spark.createDataFrame([(100, "2S3M2I4D2M1S"), (5, "10S5M"), (3, "5H10S5M"), (0, "4M")], "pos int, cigar string")
    got = df.select(cigar.base_positions(F.col("pos"), F.col("cigar")), cigar.clipped_start(F.col("pos"), F.col("cigar")), cigar.last_position(F.col("pos"), F.col("cigar"))).collect()
    assert got[0][0] == [100, 100, 100, 101, 102, 103, 103, 107, 108, 109]
    assert [r[1] for r in got] == [98, 0, 3, 0]
    assert [r[2] for r in got] == [108, 9, 7, 3]


def test_adjacent_insertion_and_deletion_are_one_event(spark):
    df = spark.createDataFrame([("a", 0, 10, 50, "5M2I3D5M1D4M"), ("b", 0, 10, 5, "5M2I5M"), ("c", 0, 10, 50, "9M")], "qname string, tid int, pos int, mapq int, cigar string")
    assert rows(targets.indel_events(df)) == [("a", 0, 15, 18), ("a", 0, 23, 24)]


@pytest.mark.parametrize("gap, n", [(10, 1), (11, 2)])
def test_merge_gap(spark, gap, n):
    assert targets.merged(spark.createDataFrame([(0, 5, 10), (0, 10 + gap, 30 + gap)], EVENTS)).count() == n


def test_merge_out_of_order(spark):
    df = spark.createDataFrame([(0, 50, 55), (0, 90, 95), (0, 0, 100)], EVENTS)
    assert rows(targets.merged(df)) == [(0, 0, 100, 3)]
    online = targets.merged_in_order(df.withColumn("at", F.expr("case start when 50 then 0 when 90 then 1 else 2 end")))
    assert online.agg(F.sum("n")).first()[0] == 3


def test_merge_against_model(spark):
    r = random.Random(4)
    data = [(t, s, s + r.randint(1, 60)) for t in range(3) for s in (r.randint(0, 5_000_000) if r.random() < 0.5 else r.randint(1_048_000, 1_049_500) for _ in range(150))]
    want = []
    for t, s, e in sorted(data):
        if want and want[-1][0] == t and s - want[-1][2] <= 10:
            want[-1] = (t, want[-1][1], max(want[-1][2], e), want[-1][3] + 1)
        else:
            want.append((t, s, e, 1))
    df = spark.createDataFrame(data, EVENTS)
    assert rows(targets.merged(df)) == want
    assert rows(targets.merged_in_order(df.withColumn("at", F.col("start").cast("long")))) == want


@pytest.mark.parametrize("gap, n", [(49, 1), (50, 2)])
def test_bed_merge(spark, gap, n):
    df = spark.createDataFrame([(0, 5, 10), (0, 10 + gap, 12 + gap)], EVENTS)
    assert targets.bed_merged(df).count() == n and targets.bed_merged(df, shrink=True).count() == n


def test_bed_merge_that_shrinks(spark):
    df = spark.createDataFrame([(0, 5, 300), (0, 20, 30), (0, 90, 95), (1, 0, 9)], EVENTS)
    assert rows(targets.bed_merged(df)) == [(0, 5, 300), (1, 0, 9)] and rows(targets.bed_merged(df, shrink=True)) == [(0, 5, 30), (0, 90, 95), (1, 0, 9)]


def test_no_events(spark):
    assert targets.merged(spark.createDataFrame([], EVENTS)).count() == 0


def test_strands(spark):
    cases = [(0x51, None, 2), (0x41, None, 1), (0x91, None, 1), (0x81, None, 2), (0x1, None, 0), (0x10, None, 2), (0, None, 0), (0x41, "CT", 1), (0x51, "CT", 3), (0x81, "CT", 3), (0x91, "CT", 1), (16, "CT", 3), (0, "CT", 1), (0x41, "GA", 4), (0x51, "GA", 2), (0x81, "GA", 2), (0x91, "GA", 4), (16, "GA", 2), (0, "GA", 4)]
    df = spark.createDataFrame(cases, "flag int, xg string, want int")
    assert df.where(bisulfite.strand(F.col("flag"), F.col("xg")) != F.col("want")).count() == 0


def test_conversions(spark):
    r = spark.createDataFrame([("acgtnRyACGT",)], "s string").select(bisulfite.c_to_t(F.col("s")), bisulfite.g_to_a(F.col("s")), bisulfite.reduced(F.lit("ACGTN"))).first()
    assert tuple(r) == ("ATGTNNNATGT", "ACATNNNACAT", "01123")


def test_bounds_against_positions(spark):
    r = random.Random(9)
    data = [(i, r.randint(0, 40), "".join(f"{r.randint(1, 9)}{r.choice('MIDNSHP=XB')}" for _ in range(r.randint(1, 7))), r.randint(0, 50), r.randint(20, 70)) for i in range(400)]
    got = {x.id: tuple(x.b) for x in spark.createDataFrame(data, "id int, pos int, cigar string, lo int, hi int").select("id", cigar.bounds(F.col("pos"), F.col("cigar"), F.col("lo"), F.col("hi")).alias("b")).collect()}
    for i, pos, text, lo, hi in data:
        at = alignment.positions(pos, text)
        inside = [j for j, p in enumerate(at) if lo <= p < hi]
        assert got[i] == ((inside[0], inside[-1], at[inside[0]], at[inside[-1]]) if inside else (-1, -1, -1, -1))


def test_fetched_text(spark):
    r = random.Random(10)
    seqs = ["".join(r.choice("ACGT") for _ in range(n)) for n in (30_000, 10, 4096, 0)]
    contigs = spark.createDataFrame([*enumerate(seqs)], "tid int, seq string")
    data = [(i, r.choice([0, 0, 0, 1, 2, 3, 9]), s, s + r.choice([0, 7, 100, 1500, 9000])) for i, s in enumerate(r.choice([r.randint(0, 31_000), 4095, 4096, 0]) for _ in range(200))]
    df = spark.createDataFrame(data, "id int, tid int, a int, b int")
    got = {x.id: x.ref for x in overlap.fetched(df, contigs, "a", "b").collect()}
    for i, tid, a, b in data:
        want = seqs[tid][a:b] if tid < 4 else None
        assert got.get(i, "") == (want or ""), (tid, a, b)


def test_chains_against_one_pass(spark):
    r = random.Random(12)
    data = [(t, s, s + 5, s - 3, s + r.choice([5, 60, 2_000_000 if r.random() < 0.02 else 90])) for t in range(2) for s in sorted(r.sample(range(10, 6_000_000), 150)) for s in (s, s + r.randint(1, 120))]
    want, far = [], {}
    for t, a, b, _, e in sorted(set(data)):
        if t not in far or a - far[t][1] > 7:
            far[t] = [a, -1]
        want.append((t, a, b, far[t][0]))
        far[t][1] = max(far[t][1], e)
    assert rows(overlap.chained(spark.createDataFrame(data, "tid int, roi_start int, roi_end int, span_start int, span_end int"), 7)) == sorted(set(want))


def test_overlap_against_theta_join(spark):
    r = random.Random(5)
    reads = spark.createDataFrame([(f"q{i}", r.randint(0, 1), r.randint(0, 2000), r.choice(["60M", "20S40M", "30M300D30M"])) for i in range(300)], "qname string, tid int, pos int, cigar string")
    roi = spark.createDataFrame([(t, s, s + r.randint(1, 700)) for t in range(2) for s in range(0, 2000, 130)], EVENTS)
    got = rows(overlap.overlapping(reads, roi).select("qname", "roi_start", "roi_end"))
    spans = overlap.spans(reads)
    want = rows(spans.join(roi, (spans.tid == roi.tid) & (F.col("span_start") <= F.col("end")) & (F.col("span_end") >= F.col("start"))).select("qname", "start", "end"))
    assert got == want
    assert overlap.outside(reads, roi).count() == 300 - len({q for q, *_ in want})


def test_kmers(spark):
    r = spark.range(1).select(kmers.kmers(F.lit("ABCDEF"), 3), kmers.kmers(F.lit("ABCDEF"), 3, 1, 1), kmers.kmers(F.lit("AB"), 3)).first()
    assert tuple(r) == (["ABC", "BCD", "CDE", "DEF"], ["BCD", "CDE"], [])
    layout = kmers.sketch_layout(F.lit(4), 25)
    assert tuple(spark.range(1).select(*layout.values()).first()) == (515, 4888, 8192)


def regions_with_reads(spark, seed):
    """Pairs of reads and regions on repetitive contigs, so that walks branch, end and close; one read without bases, a contig that ends in a window."""
    r = random.Random(seed)
    contigs = [(t, "".join(r.choice("ACGTTN" if t % 3 else "AT") for _ in range(150 - 40 * (t == 4)))) for t in range(12)]
    regions = spark.createDataFrame([(t, 60, 64 + t) for t in range(12)] + [(4, 100, 103), (5, 1, 4)], EVENTS)
    reads = []
    for t, text in contigs:
        for i in range(60):
            pos, shape = r.randrange(30, 60), r.choice(["40M", "20M3I17M", "20M2D20M", "3S37M", "40M5H", "*"])
            seq = (text[pos : pos + 20] + r.choice(["GGG", "TTA"]) + text[pos + 20 : pos + 37]) if "I" in shape else text[pos : pos + 40]
            seq = "".join(r.choice("ACGT") if r.random() < 0.01 else c for c in seq).lower() if i % 7 == 0 else seq
            reads.append((f"{t}.{i}", r.choice([0, 16]), t, pos, 40, shape, seq if i else None, r.choice(["CT", "GA", None])))
    reads = spark.createDataFrame(reads, "qname string, flag int, tid int, pos int, mapq int, cigar string, seq string, xg string")
    return reads, regions, spark.createDataFrame(contigs, "tid int, seq string")


@pytest.mark.parametrize("k, seed, breadth, letters", [(5, 1, 300, 3 << 20), (7, 2, 1, 500), (11, 3, 0, 3 << 20)])
def test_packed_kmers_and_paths_against_those_of_texts(spark, monkeypatch, k, seed, breadth, letters):
    monkeypatch.setattr(assembly, "MOST_LETTERS", letters)
    monkeypatch.setattr(assembly, "MOST_BYTES", letters)
    reads, regions, contigs = regions_with_reads(spark, seed)
    settings = realign.Settings(k=k, breadth=breadth)
    windows = overlap.windows(regions, contigs, k)
    pairs = realign.windowed_pairs(reads, windows, settings)
    patches = kmers.patched(realign.bounded_pairs(reads, regions, contigs, settings), k)
    plain = kmers.sufficient(kmers.read_kmers(patches, k), kmers.reference_kmers(windows, k))
    assert rows(assembly.sufficient(pairs, windows, k)) == rows(plain)
    if breadth:  # without a bound there are too many
        found = rows(realign.assembled(pairs, windows, settings))
        assert found == rows(realign.haplotype_paths(plain, windows, kmers.most_indel(patches), settings)) and len(found) > 28


def test_equal_patched_texts_are_taken_apart_once(monkeypatch):
    """A deep region costs as many texts as differ, not as many as it has reads."""
    ref = "".join(random.Random(4).choice("ACGT") for _ in range(104))
    reads = [(0, 50, 54, 40, 25, 79, 25, i % 2, "40M", ref[40:80], ref) for i in range(600)] + [(0, 50, 54, 40, 25, 79, 25, 1, "40M", ref[40:70] + "N" + ref[71:80], ref)]
    names = ("tid", "roi_start", "roi_end", "pos", "lo", "hi", "lead", "kind", "cigar", "seq", "ref")
    table = pa.table({n: pa.array(x, pa.string() if isinstance(x[0], str) else pa.int32()) for n, x in zip(names, zip(*reads))})
    seen, inner = [], assembly._codes
    monkeypatch.setattr(assembly, "_codes", lambda letters, starts, *more: seen.append(len(starts)) or inner(letters, starts, *more))
    counted = assembly._counted(table, 25).to_pylist()
    assert seen == [3]
    assert sum(np.frombuffer(r["counts"], "<u4").sum() for r in counted) == 601 * (104 - 25 + 1 - 2)
    assert len(assembly._counted(table.slice(0, 0), 25)) == 0


def test_events_and_spans_by_shape(spark):
    """CIGARs taken apart once each give the events and spans of those that are taken apart for each read."""
    r = random.Random(5)
    shapes = ["60M", "10M4I46M", "10M3D50M", "5S10M2I3D40M", "3H4S50M2D", "2D50M", "3D2I9M", "4I", "*", "", "007S5M2P3I2D1N4=", "5M2B3I4X", None]
    rows_ = [(f"q{i}", r.choice([0, 1, None]), r.choice([-3, -1, 0, 7, 40, 2000, None]), r.choice([3, 10, 40, None]), r.choice(shapes)) for i in range(700)]
    reads = spark.createDataFrame(rows_, "qname string, tid int, pos int, mapq int, cigar string")
    want = targets.indel_events(reads).where("tid is not null").groupBy("tid", "start", "end").count()
    assert rows(targets.summed_events(reads)) == rows(want)
    assert targets.summed_events(reads.where("tid > 5")).count() == 0
    assert rows(overlap.spans_by_shape(reads)) == rows(overlap.spans(reads))


def test_windows_take_reads_apart_once(spark, monkeypatch, tmp_path):
    """Merging events reads those that were written, whatever its number of steps, not all reads again for each of them."""
    from haplospark.plans import queries

    plans = []
    monkeypatch.setattr(queries.storage, "stored", lambda df, name, inner=queries.storage.stored: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or inner(df, name))
    queries._windows(spark, "/root/testdata/sf0.001", 25)
    assert sum("FileScan parquet [l_" in line for name, plan in plans for line in plan.split("\n")) == 1


def test_contigs_are_not_broadcast(spark):
    """Spark's estimate of a contig is a few bytes, whatever its length; a broadcast takes all of them through the driver."""
    reads, regions, contigs = regions_with_reads(spark, 1)
    plan = overlap.windows(regions, contigs, 5)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan


def test_kmer_table_function(spark):
    udtf.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT k.* FROM VALUES ('ABCD') t(s), LATERAL kmers(s, 3) k").collect()] == [(0, "ABC"), (1, "BCD")]


@pytest.fixture(scope="module")
def sample(spark):
    r = random.Random(6)
    seq = "".join(r.choice("ACGT") for _ in range(600))
    contigs = spark.createDataFrame([(0, "c0", seq)], "tid int, name string, seq string")
    alt = seq[:300] + "TTATTAT" + seq[300:]
    data = []
    for i in range(24):
        at = 255 + i
        n = 300 - at
        if i % 2:
            data.append((f"i{i}", 0, 0, at, 40, f"{n}M7I{53 - n}M", alt[at : at + 60], "CT", "keep" if i == 1 else None))
        else:
            data.append((f"s{i}", 0, 0, at, 40, f"{n}M{60 - n}S", alt[at : at + 60], "CT", None))
    data += [("far", 0, 0, 10, 40, "60M", seq[10:70], "CT", None), ("low", 0, 0, 270, 3, "30M30S", alt[270:330], "CT", None), ("far", 0, 0, 10, 40, "60M", seq[10:70], "CT", None)]
    reads = spark.createDataFrame(data, "qname string, flag int, tid int, pos int, mapq int, cigar string, seq string, xg string, oc string")
    return reads, contigs


def test_realign(spark, sample):
    reads, contigs = sample
    out = realign.realign(reads, targets.discover(reads), contigs).collect()
    assert sorted(r.qname for r in out) == sorted(r.qname for r in reads.collect())
    by = {r.qname: r for r in out}
    assert by["low"].cigar == "30M30S" and by["far"].cigar == "60M" and by["i1"].oc == "keep"
    clipped = [r for r in out if r.qname.startswith("s") and 300 - r.pos < 45]
    assert clipped and all("I" in r.cigar and r.oc and "S" in r.oc for r in clipped)
    capped = realign.realign(reads, targets.discover(reads), contigs, realign.Settings(max_reads=3))
    assert capped.where("oc is not null and oc != 'keep'").count() == 0


def test_reads_clipped_at_a_long_deletion(spark):
    r = random.Random(8)
    seq = "".join(r.choice("AT") for _ in range(1600))
    contigs = spark.createDataFrame([(0, "c0", seq)], "tid int, name string, seq string")
    alt = seq[:600] + seq[850:]
    data = [(f"d{i}", 0, 0, 540 + i, 40, f"{60 - i}M250D{40 + i}M", alt[540 + i : 640 + i], "CT") for i in (0, 2, 4, 6, 8, 40)]
    data += [("right", 0, 0, 540, 40, "60M40S", alt[540:640], "CT"), ("left", 0, 0, 850, 40, "20S80M", alt[580:680], "CT")]
    reads = spark.createDataFrame(data, "qname string, flag int, tid int, pos int, mapq int, cigar string, seq string, xg string")
    by = {x.qname: x for x in realign.realign(reads, targets.discover(reads), contigs).collect()}
    assert (by["right"].pos, by["right"].cigar, by["right"].oc) == (540, by["d0"].cigar, "60M40S")
    assert (by["left"].pos, by["left"].cigar, by["left"].op, by["left"].oc) == (580, by["d40"].cigar, 851, "20S80M")


def test_long_chains_keep_all_reads_of_each_region(spark):
    r = random.Random(9)
    seq = "".join(r.choice("AT") for _ in range(700))
    contigs = spark.createDataFrame([(0, "c0", seq)], "tid int, name string, seq string")
    alt = seq[:300] + "TTATTAT" + seq[300:360] + "ATAATTA" + seq[360:]
    data = [(f"b{i}", 0, 0, 262 + i, 40, f"{38 - i}M7I60M7I{8 + i}M", alt[262 + i : 382 + i], "CT") for i in range(0, 16, 2)]
    data += [(f"s{i}", 0, 0, 320 + i, 40, f"{40 - i}M{20 + i}S", alt[327 + i : 387 + i], "CT") for i in range(0, 16, 2)]
    data += [data[0], ("far", 0, 0, 10, 40, "60M", seq[10:70], "CT")]
    reads = spark.createDataFrame(data, "qname string, flag int, tid int, pos int, mapq int, cigar string, seq string, xg string")
    regions = targets.discover(reads).localCheckpoint()
    assert regions.count() == 2
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = realign.realign(reads, regions, contigs, realign.Settings(max_chain_reads=1)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    # The model: both regions in order over all reads that overlap them or begin near.
    held = [{"kind": "CT", "wide": seq, "wide_start": 0, "op": None, "oc": None, **dict(zip(("qname", "flag", "tid", "pos", "mapq", "cigar", "seq"), d))} for d in data]
    for x in sorted(regions.collect(), key=lambda x: x.start):
        near = [h for h in held if h["qname"][0] == "b" or (h["qname"][0] == "s" and x.start > 330)]
        realign.realign_together([(realign.Region(x.start, x.end, seq, 0, realign.Settings()), near)], 25)
    want = sorted((h["qname"], h["pos"], h["cigar"], h["op"] or 0, h["oc"] or "") for h in held)
    assert sorted((x.qname, x.pos, x.cigar, x.op or 0, x.oc or "") for x in out) == want
    assert any(x.qname[0] == "s" and "I" in x.cigar for x in out)


def test_realign_without_regions(spark, sample):
    reads, contigs = sample
    assert realign.realign(reads, spark.createDataFrame([], EVENTS), contigs).count() == reads.count()


def test_files(spark, sample, tmp_path):
    reads, contigs = sample
    path = str(tmp_path / "sam")
    sam.write(reads.withColumn("tags", F.create_map(F.lit("NM"), F.lit("i:0"))), contigs, path)
    back = sam.read(spark, path)
    assert rows(back.select("qname", "tid", "pos", "mapq", "cigar", "seq", "xg", F.coalesce("oc", F.lit("")))) == rows(reads.select("qname", "tid", "pos", "mapq", "cigar", "seq", "xg", F.coalesce("oc", F.lit(""))))
    assert back.first().tags == {"NM": "i:0"}
    regions = targets.discover(reads)
    bed.write(regions, contigs, str(tmp_path / "bed"))
    assert rows(bed.read(spark, str(tmp_path / "bed"), contigs)) == rows(regions.select("tid", "start", "end"))
    (tmp_path / "x.fa").write_text(">c0 first\nACGT\nAC\n>c1\nGG\n")
    assert rows(fasta.read(spark, str(tmp_path / "x.fa"))) == [("c0", "ACGTAC"), ("c1", "GG")]


HEADER = ["@HD\tVN:1.6\tSO:unsorted", "@SQ\tSN:c0\tLN:600\tM5:ab", "@SQ\tSN:c1\tLN:90", "@RG\tID:g\tSM:s", "@PG\tID:p\tCL:a b", "@CO\tany text"]
RECORDS = [
    "r1\t99\tc0\t11\t40\t5M1I4M\t=\t51\t50\tACGTNACGTA\tIIIIIIIIII\tXG:Z:CT\tNM:i:-3\tXA:A:q\tXF:f:0.5\tXB:B:s,1,-2\tXH:H:1AFF",
    "r1\t147\tc0\t51\t40\t10M\t=\t11\t-50\tACGTACGTAC\t*\tOP:i:7\tOC:Z:9M",
    "r2\t65\tc0\t81\t0\t3S7M\tc1\t5\t0\tacgtACGTAC\t*\tXU:i:4000000000",
    "r3\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t#I",
    "r4\t0\tc1\t90\t255\t1M\t*\t0\t0\t*\t*",
]


def test_sam_records_come_back_whole(spark, tmp_path):
    (tmp_path / "in.sam").write_text("\n".join([*HEADER, *RECORDS, ""]) + "\n")
    contigs, reads = sam.read_contigs(spark, str(tmp_path / "in.sam")), sam.read(spark, str(tmp_path / "in.sam"))
    assert sam.read_header(spark, str(tmp_path / "in.sam")) == HEADER and rows(contigs) == [(0, "c0", 600), (1, "c1", 90)]
    sam.write(reads, contigs, str(tmp_path / "out"), HEADER)
    back = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    fields = lambda line: (line.split("\t")[:11], sorted(line.split("\t")[11:]))
    assert sorted(x for x in back if x[0] == "@") == sorted(HEADER) and sorted(fields(x) for x in back if x[0] != "@") == sorted(map(fields, RECORDS))
    assert sam.sorted_header(HEADER)[0] == "@HD\tVN:1.6\tSO:coordinate" and sam.sorted_header([])[0] == "@HD\tVN:1.6\tSO:coordinate"
    (tmp_path / "odd.sam").write_text("\n".join([*HEADER, RECORDS[4] + "\tNM:i:1\tNM:i:2"]))
    assert sam.read(spark, str(tmp_path / "odd.sam")).first().tags == {"NM": "i:1"}
    (tmp_path / "short.sam").write_text("\n".join([*HEADER, "r\t0\tc0"]))
    with pytest.raises(Exception, match="fewer than 11 fields"):
        sam.read(spark, str(tmp_path / "short.sam")).collect()


def test_bam_records_come_back_whole(spark, tmp_path):
    (tmp_path / "in.sam").write_text("\n".join([*HEADER, *RECORDS, ""]))
    reads = sam.read(spark, str(tmp_path / "in.sam"))
    bam.write(reads, str(tmp_path / "out"), HEADER, index=True)
    assert bam.read_header(str(tmp_path / "out"))[0] == HEADER and rows(bam.read_contigs(spark, str(tmp_path / "out"))) == [(0, "c0", 600), (1, "c1", 90)]
    plain = lambda df: sorted((r.asDict(recursive=True) for r in df.withColumn("seq", F.upper("seq")).collect()), key=str)
    assert plain(bam.read(spark, str(tmp_path / "out"))) == plain(reads)
    bam.merged(str(tmp_path / "out"), str(tmp_path / "one.bam"), index=True)
    assert plain(bam.read(spark, str(tmp_path / "one.bam"))) == plain(reads)
    with bgzf.opened(str(tmp_path / "one.bam")) as f:
        data, order = bgzf.Bytes(f, *bam.read_header(str(tmp_path / "one.bam"))[2]), []
        while data.has(4):
            order.append(bam.decoded(data.take(int.from_bytes(data.take(4), "little")))[0])
    assert order == ["r1", "r1", "r2", "r4", "r3"]
    bam.write(reads.limit(0), str(tmp_path / "none"), HEADER)
    assert bam.read(spark, str(tmp_path / "none")).collect() == []


def test_bam_splits_meet_between_records(spark, tmp_path):
    r = random.Random(3)
    made = [(f"q{i}", 0, r.choice([0, 1, None]), r.randint(0, 5000), 60, "100M" if i % 50 else f"{20_000 + i}S100M", "".join(r.choice("ACGTN") for _ in range(100 if i % 50 else 20_100 + i)), None, None, None, None) for i in range(3000)]
    reads = spark.createDataFrame(made, "qname string, flag int, tid int, pos int, mapq int, cigar string, seq string, qual string, xg string, op int, oc string").withColumn("tags", F.create_map(F.lit("XQ"), F.concat(F.lit("Z:"), F.sha2("qname", 512))))
    bam.write(reads.coalesce(1), str(tmp_path / "out"), ["@SQ\tSN:a\tLN:9000", "@SQ\tSN:b\tLN:9000"], index=True)
    bam.merged(str(tmp_path / "out"), str(tmp_path / "one.bam"), index=True)
    whole = sorted(zip(*(c for c in zip(*((x[0], x[5], x[6]) for x in made)))))
    for split in (70_000, 200_000, 1 << 30):
        df = bam.read(spark, str(tmp_path / "one.bam"), split)
        assert rows(df.select("qname", "cigar", "seq")) == whole
    assert df.rdd.getNumPartitions() == 1 and bam.read(spark, str(tmp_path / "one.bam"), 70_000).rdd.getNumPartitions() > 5
    # The index of the whole leads to each record.
    index = bam.Index.unpacked((tmp_path / "one.bam.bai").read_bytes())
    with bgzf.opened(str(tmp_path / "one.bam")) as f:
        for tid, start in ((0, 0), (1, 4096), (0, 2500)):
            first = min(v for w, v in index.windows[tid].items() if w >= start >> 14)
            data = bgzf.Bytes(f, first >> 16, first & 0xFFFF)
            got = bam.decoded(data.take(int.from_bytes(data.take(4), "little")))
            assert got[2] == tid


def test_damaged_blocks_are_found(tmp_path):
    good = bgzf.block(b"some bytes " * 900) + bgzf.END
    (tmp_path / "x").write_bytes(good)
    with bgzf.opened(str(tmp_path / "x")) as f:
        assert b"".join(d for _, _, d in bgzf.blocks(f, 0)) == b"some bytes " * 900
    for bad, why in ((good[:40], "cut short"), (good[:-36] + b"\1" + good[-35:], "damaged"), (b"x" * 70_000, "no block")):
        (tmp_path / "x").write_bytes(bad)
        with bgzf.opened(str(tmp_path / "x")) as f, pytest.raises(ValueError, match=why):
            list(bgzf.blocks(f, 0))


def test_command_line(spark, sample, tmp_path, capsys):
    from haplospark.__main__ import main

    reads, contigs = sample
    sam.write(reads, contigs, str(tmp_path / "in"))
    (tmp_path / "ref.fa").write_text(f">c0\n{contigs.first().seq}\n")
    main(["targets", str(tmp_path / "in"), str(tmp_path / "bed")])
    main(["realign", str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ref.fa"), "-l", str(tmp_path / "bed")])
    got = sam.read(spark, str(tmp_path / "out"))
    assert got.where("oc is not null").count() > 1 and got.count() == reads.count()
    main(["realign", str(tmp_path / "in"), str(tmp_path / "out.bam"), str(tmp_path / "ref.fa"), "--index", "--quiet", "--quiet"])
    assert rows(bam.read(spark, str(tmp_path / "out.bam")).drop("tags").fillna("")) == rows(got.drop("tags").fillna(""))
    assert bam.Index.unpacked((tmp_path / "out.bam.bai").read_bytes()).bins[0]
    main(["targets", str(tmp_path / "out.bam"), "-"])
    assert capsys.readouterr().out.startswith("c0\t")
    for flag in ("-C", "--nope"):
        with pytest.raises(SystemExit):
            main(["realign", str(tmp_path / "in"), str(tmp_path / "x"), str(tmp_path / "ref.fa"), flag])


def test_stream(spark, sample, tmp_path):
    from haplospark.streaming import targets as stream

    reads, _ = sample
    reads.write.parquet(str(tmp_path / "reads"))
    source = spark.readStream.schema(reads.schema).parquet(str(tmp_path / "reads"))
    stream.write_counts(source, str(tmp_path / "counts"), str(tmp_path / "state")).awaitTermination()
    assert rows(stream.regions(spark.read.parquet(str(tmp_path / "counts")))) == rows(targets.discover(reads))
