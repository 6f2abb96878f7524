"""A query for each operator over the derived reads, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplospark import storage
from haplospark.functions import bisulfite, cigar
from haplospark.operators import alignment, assembly, kmers, overlap, realign, targets
from haplospark.plans import reference_sql as sql
from haplospark.plans.fixtures import contigs, reads

K, SMALL = 25, 11
SETTINGS = realign.Settings(k=K)
SMALL_K = realign.Settings(k=SMALL)


def _regions(spark: SparkSession, sf_dir: str, spacing: int = 128) -> DataFrame:
    return targets.discover(reads(spark, sf_dir, spacing))


def _flags(rows: DataFrame) -> DataFrame:
    """Reads with flags of pairs and without XG, by rule, so that all rows of the strand table occur."""
    flag = F.expr("case pos % 4 when 0 then flag when 1 then flag + 65 when 2 then flag + 129 else flag + 1 end")
    return rows.select("qname", flag.alias("flag"), F.expr("if(pos % 5 = 0, null, xg)").alias("xg"))


def reads_scan(spark, sf_dir):
    return reads(spark, sf_dir).where("mapq >= 10").drop("qual")


def contigs_scan(spark, sf_dir):
    return contigs(spark, sf_dir).select("tid", "name", F.length("seq").alias("length"), F.md5("seq").alias("digest"))


def cigar_ops(spark, sf_dir):
    return reads(spark, sf_dir).select("qname", F.posexplode(cigar.operations(F.col("cigar"))).alias("i", "o")).select("qname", "i", "o.op", "o.len")


def base_positions(spark, sf_dir):
    return reads(spark, sf_dir).select("qname", F.array_join(cigar.base_positions(F.col("pos"), F.col("cigar")).cast("array<string>"), ",").alias("positions"))


def read_span(spark, sf_dir):
    return overlap.spans(reads(spark, sf_dir)).select("qname", "span_start", "span_end")


def indel_events(spark, sf_dir):
    return targets.indel_events(reads(spark, sf_dir))


def roi_islands(spark, sf_dir):
    return targets.merged(targets.indel_events(reads(spark, sf_dir)))


def roi_depth(spark, sf_dir):
    return _regions(spark, sf_dir)


def bed_merge(spark, sf_dir):
    return targets.bed_merged(_regions(spark, sf_dir, 40), K)


def strand_class(spark, sf_dir):
    return _flags(reads(spark, sf_dir)).withColumn("strand", bisulfite.strand(F.col("flag"), F.col("xg")))


def ct_convert(spark, sf_dir):
    return reads(spark, sf_dir).select("qname", bisulfite.c_to_t(F.col("seq")).alias("converted"))


def ga_convert(spark, sf_dir):
    return reads(spark, sf_dir).select("qname", bisulfite.g_to_a(F.col("seq")).alias("converted"))


def reduced_alphabet(spark, sf_dir):
    return reads(spark, sf_dir).select("qname", bisulfite.reduced(bisulfite.c_to_t(F.col("seq"))).alias("reduced"))


def roi_overlap(spark, sf_dir):
    return overlap.overlapping(reads(spark, sf_dir), _regions(spark, sf_dir)).select("qname", "tid", "pos", "roi_start", "roi_end")


def roi_group_cap(spark, sf_dir):
    return overlap.capped(overlap.overlapping(reads(spark, sf_dir), _regions(spark, sf_dir)), 50)


def roi_group_members(spark, sf_dir):
    """The reads that a pass in coordinate order gathers for each region: those that overlap it, and those clipped beside it."""
    return overlap.grouped(reads(spark, sf_dir), _regions(spark, sf_dir), K).select("qname", "tid", "pos", "roi_start", "roi_end")


def chain_reads(spark, sf_dir):
    """Reads that a region passes on to the next ones of its chain, with the number of its regions."""
    pairs = overlap.grouped(reads(spark, sf_dir, 40), _regions(spark, sf_dir, 40), K)
    chains = overlap.chained(pairs, K)
    return pairs.join(chains, ["tid", "roi_start", "roi_end"]).groupBy("tid", "chain", "qname", "pos").agg(F.count("*").alias("n_regions")).where("n_regions > 1")


def reads_outside(spark, sf_dir):
    return overlap.outside(reads(spark, sf_dir), _regions(spark, sf_dir)).select("qname", "tid", "pos")


def ref_window(spark, sf_dir):
    return overlap.windows(_regions(spark, sf_dir), contigs(spark, sf_dir), K)


def roi_chains(spark, sf_dir):
    return overlap.chained(overlap.overlapping(reads(spark, sf_dir, 40), _regions(spark, sf_dir, 40)))


def _bounded(spark, sf_dir, settings=SETTINGS):
    return realign.bounded_pairs(reads(spark, sf_dir), _regions(spark, sf_dir), contigs(spark, sf_dir), settings)


def read_window_bounds(spark, sf_dir):
    return _bounded(spark, sf_dir).select("qname", "tid", "roi_start", "i0", "i1", "p0", "p1")


def patched_read(spark, sf_dir):
    return kmers.patched(_bounded(spark, sf_dir), K).select("qname", "tid", "roi_start", "conversion", "patched")


def kmer_counts(spark, sf_dir):
    return kmers.read_kmers(kmers.patched(_bounded(spark, sf_dir), K), K)


def kmer_sketch_md5(spark, sf_dir):
    return kmers.sketched(kmer_counts(spark, sf_dir))


def kmer_murmur(spark, sf_dir):
    return kmers.kmer_hashes(kmer_counts(spark, sf_dir))


def sketch_layout(spark, sf_dir):
    roi = _regions(spark, sf_dir)
    return roi.select("tid", "start", *(c.alias(n) for n, c in kmers.sketch_layout(F.col("end") - F.col("start"), K).items()))


def _windows(spark, sf_dir, k):
    """The windows of the regions, written once: all that follows joins them, and finding them reads all reads.

    So are the events, summed: each step of merging them would read all reads again.
    """
    events = storage.stored(targets.summed_events(reads(spark, sf_dir)), "events")
    return storage.stored(overlap.windows(targets.deep(targets.merged_units(events)), contigs(spark, sf_dir), k), "windows")


def _pairs(spark, sf_dir, settings, windows):
    return realign.windowed_pairs(reads(spark, sf_dir), windows, settings)


def _sufficient(spark, sf_dir, settings):
    windows = _windows(spark, sf_dir, settings.size)
    return assembly.sufficient(_pairs(spark, sf_dir, settings, windows), windows, settings.size)


def kmer_sufficient(spark, sf_dir):
    return _sufficient(spark, sf_dir, SETTINGS)


def max_indel(spark, sf_dir):
    return kmers.most_indel(kmers.patched(_bounded(spark, sf_dir), K))


def kmer_edges(spark, sf_dir):
    return kmers.edges(_sufficient(spark, sf_dir, SETTINGS))


def _paths(spark, sf_dir, settings, windows=None):
    windows = _windows(spark, sf_dir, settings.size) if windows is None else windows
    return realign.assembled(_pairs(spark, sf_dir, settings, windows), windows, settings)


def haplotype_paths(spark, sf_dir):
    return _paths(spark, sf_dir, SMALL_K).select("tid", "roi_start", "roi_end", "conversion", "path")


def haplotype_paths_25(spark, sf_dir):
    return _paths(spark, sf_dir, SETTINGS)


def ref_path_union(spark, sf_dir):
    return _paths(spark, sf_dir, SMALL_K).groupBy("tid", "roi_start", "conversion").agg(F.count("*").alias("n_paths"), F.max("path_id").alias("last_id"))


def breadth_cap(spark, sf_dir):
    """Regions by their paths without the reference's, and whether that is above a bound of one."""
    windows = _windows(spark, sf_dir, SMALL)
    ref = windows.select("tid", "roi_start", "ref", F.explode(F.array(F.lit("CT"), F.lit("GA"))).alias("conversion"))
    ref = ref.select("tid", "roi_start", "conversion", bisulfite.converted(F.col("ref"), F.col("conversion")).alias("path"))
    other = _paths(spark, sf_dir, SMALL_K, windows).join(ref, ["tid", "roi_start", "conversion", "path"], "left_anti")
    return other.groupBy("tid", "roi_start", "conversion").agg(F.count("*").alias("n_other")).withColumn("skipped", F.col("n_other") > 1)


def breadth_skipped(spark, sf_dir):
    """Whether a region has more paths of a conversion than its bound, here 1 and twice its width less two."""
    found = _paths(spark, sf_dir, realign.Settings(k=SMALL, breadth=1))
    return found.groupBy("tid", "roi_start", "roi_end", "conversion").agg(F.max("too_many").alias("too_many"))


def noncycle_paths(spark, sf_dir):
    return _paths(spark, sf_dir, realign.Settings(k=SMALL, no_cycles=True))


def _scores(spark, sf_dir):
    """Scores and the paths that they are of, both written once."""
    windows = _windows(spark, sf_dir, SMALL)
    paths = storage.stored(_paths(spark, sf_dir, SMALL_K, windows), "paths")
    read = realign.pieces(kmers.bounds(_pairs(spark, sf_dir, SMALL_K, windows)), SMALL)
    return storage.stored(realign.read_scores(read, paths, SMALL), "scores"), paths


def ungapped_best(spark, sf_dir):
    return _scores(spark, sf_dir)[0].groupBy("tid", "roi_start", "conversion", "qname").agg(F.min("score").alias("score"), F.count("*").alias("n_paths"), F.sum(F.col("score").cast("long") * 1000 + F.col("offset")).alias("digest"))


def path_votes(spark, sf_dir):
    return realign.votes(_scores(spark, sf_dir)[0]).groupBy("tid", "roi_start", "conversion").agg(F.sum("n").alias("votes"), F.max("n").alias("most"))


def path_assign(spark, sf_dir):
    scores, paths = _scores(spark, sf_dir)
    paths = paths.select("tid", "roi_start", "conversion", "path_id", "path")
    picked = realign.assigned(scores, realign.votes(scores)).join(paths, ["tid", "roi_start", "conversion", "path_id"])
    return picked.select("tid", "roi_start", "conversion", "qname", "score", "offset", "path")


def _measured(spark, sf_dir, plain=False):
    """mismatches and covered bases of reads, and with *plain* those of 60M at their places."""
    rows = overlap.spans(reads(spark, sf_dir)).withColumn("reach", F.greatest(F.col("span_end"), F.col("pos") + 59) + 1)
    rows = overlap.fetched(rows, contigs(spark, sf_dir), "pos", "reach", "there")
    rows = alignment.with_distance(rows, "pos", "cigar", "seq", "there", "pos", ("mismatches", "covered"))
    return alignment.with_distance(rows.withColumn("whole", F.lit("60M")), "pos", "whole", "seq", "there", "pos", ("plain_mismatches", "plain_covered")) if plain else rows


def edit_distance(spark, sf_dir):
    return _measured(spark, sf_dir).select("qname", "mismatches", "covered")


def accept_rule(spark, sf_dir):
    """Whether each read would keep its CIGAR rather than become 60M at its place."""
    return _measured(spark, sf_dir, True).select("qname", cigar.keeps_old(F.col("mismatches"), F.col("plain_mismatches"), F.col("covered"), F.col("plain_covered")).alias("kept"))


def op_oc_tags(spark, sf_dir):
    """Tags of reads that move to an even place and become 60M; every seventh has both tags already."""
    rows = reads(spark, sf_dir).withColumns({"op": F.expr("if(pos % 7 = 0, 5, null)"), "oc": F.expr("if(pos % 7 = 0, '9M', null)"), "new_pos": F.expr("pos + pos % 2")})
    return rows.select("qname", "new_pos", cigar.original_position(F.col("pos"), F.col("new_pos"), F.col("op")).alias("op"), cigar.original_cigar(F.col("cigar"), F.lit("60M"), F.col("oc")).alias("oc"))


def coordinate_sort(spark, sf_dir):
    return realign.coordinate_sorted(reads(spark, sf_dir)).select("tid", "pos", "endpos", "qname", "flag")


def gapped_cigar(spark, sf_dir):
    """The CIGAR of each haplotype on its reference, a row for each region, conversion and path."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            pairs = b.column("path").to_pylist(), b.column("reference").to_pylist()
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(alignment.gapped(*([alignment.codes(x) for x in column] for column in pairs), SMALL), pa.string())], [*b.schema.names[:4], "cigar"])

    ref = _windows(spark, sf_dir, SMALL)
    rows = _paths(spark, sf_dir, SMALL_K, ref).join(ref.select("tid", "roi_start", "ref"), ["tid", "roi_start"])
    rows = rows.select("tid", "roi_start", "conversion", "path_id", "path", bisulfite.converted(F.col("ref"), F.col("conversion")).alias("reference"))
    return rows.mapInArrow(run, "tid int, roi_start int, conversion string, path_id int, cigar string")


def targets_in_order(spark, sf_dir):
    """Regions as an online merge in the order of read names gives them."""
    return targets.merged_in_order(targets.indel_events(reads(spark, sf_dir)).withColumn("at", F.xxhash64("qname")))


def realign_full(spark, sf_dir):
    out = realign.realign(reads(spark, sf_dir), _regions(spark, sf_dir), contigs(spark, sf_dir), SETTINGS)
    return out.select("qname", "flag", "tid", "pos", "cigar", "op", "oc")


def realign_chains(spark, sf_dir):
    out = realign.realign(reads(spark, sf_dir, 40), _regions(spark, sf_dir, 40), contigs(spark, sf_dir), SETTINGS)
    return out.select("qname", "flag", "tid", "pos", "cigar", "op", "oc")


_ALL = (
    reads_scan, contigs_scan, cigar_ops, base_positions, read_span, indel_events, roi_islands, roi_depth, bed_merge, strand_class,
    ct_convert, ga_convert, reduced_alphabet, roi_overlap, roi_group_members, chain_reads, roi_group_cap, reads_outside, ref_window, roi_chains, read_window_bounds,
    patched_read, kmer_counts, kmer_sketch_md5, kmer_murmur, sketch_layout, kmer_sufficient, max_indel, kmer_edges, haplotype_paths,
    haplotype_paths_25, ref_path_union, breadth_cap, breadth_skipped, noncycle_paths, ungapped_best, path_votes, path_assign, edit_distance,
    accept_rule, op_oc_tags, coordinate_sort, gapped_cigar, targets_in_order, realign_full, realign_chains,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    plain = sql.reads()
    with_ops = f"{plain}, {sql.OPS}"
    base = f"{plain}, {sql.POSITIONS}"
    roi = sql.regions()
    chain = f"""{sql.regions(40)}, {sql.PAIRS}, far AS (SELECT tid, roi_start, roi_end, max(span_end) AS far FROM pairs GROUP BY ALL
), flags AS (SELECT *, CASE WHEN max(far) OVER (PARTITION BY tid ORDER BY roi_start, roi_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= roi_start THEN NULL ELSE roi_start END AS opens FROM far)"""
    flags = f"""{plain}, flags AS (SELECT qname, CASE pos % 4 WHEN 0 THEN flag WHEN 1 THEN flag + 65 WHEN 2 THEN flag + 129 ELSE flag + 1 END AS flag,
      CASE WHEN pos % 5 = 0 THEN NULL ELSE xg END AS xg FROM reads)"""
    moved = "CASE WHEN pos % 7 = 0 THEN {} ELSE NULL END"
    q = {
        "reads_scan": f"WITH {plain} SELECT * FROM reads WHERE mapq >= 10",
        "contigs_scan": f"WITH {sql.CONTIGS} SELECT tid, name, CAST(length(seq) AS INTEGER) AS length, md5(seq) AS digest FROM contigs",
        "cigar_ops": f"WITH {with_ops} SELECT qname, CAST(i - 1 AS INTEGER) AS i, op, len FROM ops",
        "base_positions": f"WITH {base} SELECT qname, array_to_string(places, ',') AS positions FROM reads r JOIN bases b ON r.pos = b.pos AND r.cigar = b.cigar",
        "read_span": f"WITH {plain}, {sql.SPANS} SELECT qname, span_start, span_end FROM spans",
        "indel_events": f"WITH {plain}, {sql.events()} SELECT * FROM events",
        "roi_islands": f"WITH {roi} SELECT * FROM isl",
        "roi_depth": f"WITH {roi} SELECT * FROM roi",
        "bed_merge": f'WITH {sql.regions(40)}, {sql.islands("roi", "bed", 49)} SELECT tid, start, "end" FROM bed',
        "strand_class": f"WITH {flags} SELECT *, {sql.STRAND} AS strand FROM flags",
        "ct_convert": f"WITH {plain} SELECT qname, {sql.ct('seq')} AS converted FROM reads",
        "ga_convert": f"WITH {plain} SELECT qname, {sql.ga('seq')} AS converted FROM reads",
        "reduced_alphabet": f"WITH {plain} SELECT qname, translate({sql.ct('seq')}, 'AGTN', '0123') AS reduced FROM reads",
        "roi_overlap": f"WITH {roi}, {sql.PAIRS} SELECT qname, tid, pos, roi_start, roi_end FROM pairs",
        "roi_group_members": f"WITH {roi}, {sql.SPANS}, {sql.members(K)} SELECT qname, tid, pos, roi_start, roi_end FROM members",
        "chain_reads": f"""WITH {sql.regions(40)}, {sql.SPANS}, {sql.members(K)}, far AS (SELECT tid, roi_start, roi_end, max(span_end) AS far FROM members GROUP BY ALL
          ), flags AS (SELECT *, CASE WHEN roi_start - max(far) OVER (PARTITION BY tid ORDER BY roi_start, roi_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {K} THEN NULL ELSE roi_start END AS opens FROM far
          ), chains AS (SELECT tid, roi_start, roi_end, max(opens) OVER (PARTITION BY tid ORDER BY roi_start, roi_end ROWS UNBOUNDED PRECEDING) AS chain FROM flags)
          SELECT m.tid, chain, qname, pos, count(*) AS n_regions FROM members m JOIN chains c ON m.tid = c.tid AND m.roi_start = c.roi_start GROUP BY ALL HAVING count(*) > 1""",
        "roi_group_cap": f"WITH {roi}, {sql.PAIRS} SELECT tid, roi_start, roi_end, count(*) AS n_reads, count(*) > 50 AS skipped FROM pairs GROUP BY ALL",
        "reads_outside": f"WITH {roi}, {sql.PAIRS} SELECT qname, tid, pos FROM reads WHERE qname NOT IN (SELECT qname FROM pairs)",
        "ref_window": f"WITH {roi}, {sql.windows(K)} SELECT tid, roi_start, roi_end, lo, hi, ref_start, ref FROM win",
        "roi_chains": f"WITH {chain} SELECT tid, roi_start, roi_end, max(opens) OVER (PARTITION BY tid ORDER BY roi_start, roi_end ROWS UNBOUNDED PRECEDING) AS chain FROM flags",
        "read_window_bounds": f"WITH {sql.bounded(K)} SELECT qname, tid, roi_start, i0, i1, p0, p1 FROM bounded",
        "patched_read": f"WITH {sql.patched(K)} SELECT qname, tid, roi_start, conversion, patched FROM patched",
        "kmer_counts": f"WITH {sql.counted(K)} SELECT * FROM counted",
        "kmer_sketch_md5": f"WITH {sql.counted(K)} SELECT tid, roi_start, roi_end, conversion, CAST(('0x' || left(md5(kmer), 8)) AS BIGINT) % 8192 AS bucket, least(CAST(sum(n) AS BIGINT), 15) AS n FROM counted GROUP BY ALL",
        "sketch_layout": f"""WITH {roi}, c AS (SELECT tid, start, 5 * ("end" - start + {4 * K - 1}) AS items FROM roi), d AS (SELECT *, CAST(round_even(-items / ln(0.9), 0) AS BIGINT) AS cells FROM c)
          SELECT *, CAST(2 ** ceil(log2(cells)) AS BIGINT) AS buckets FROM d""",
        "kmer_murmur": f"WITH {sql.counted(K)}, {sql.murmur()} SELECT c.*, CAST(CASE WHEN h >= 9223372036854775808 THEN CAST(h AS HUGEINT) - 18446744073709551616 ELSE CAST(h AS HUGEINT) END AS BIGINT) AS hash FROM counted c JOIN hashed USING (kmer)",
        "kmer_sufficient": f"WITH {sql.sufficient(K)} SELECT * FROM suff",
        "max_indel": f"WITH {sql.patched(K)}, {sql.INDEL} SELECT * FROM indel",
        "kmer_edges": f"""WITH {sql.sufficient(K)}, source AS (SELECT tid, roi_start, roi_end, conversion, kmer AS source, substr(kmer, 2) AS shared FROM suff
          ), target AS (SELECT tid AS t, roi_start AS s, conversion AS c, kmer AS target, left(kmer, {K - 1}) AS shared FROM suff)
          SELECT tid, roi_start, roi_end, conversion, source, target FROM source JOIN target ON source.shared = target.shared AND tid = t AND roi_start = s AND conversion = c""",
        "haplotype_paths": f"WITH RECURSIVE {sql.walks(SMALL)} SELECT tid, roi_start, roi_end, conversion, path FROM haps",
        "haplotype_paths_25": f"""WITH RECURSIVE {sql.walks(K)}, many AS (SELECT e.tid, e.roi_start, e.conversion, count(w.path) > 300 + 2 * (e.roi_end - e.roi_start - 1) AS too_many
          FROM ends e LEFT JOIN walked w ON w.tid = e.tid AND w.roi_start = e.roi_start AND w.conversion = e.conversion GROUP BY e.tid, e.roi_start, e.roi_end, e.conversion)
          SELECT n.tid, n.roi_start, n.roi_end, n.conversion, path_id, path, too_many FROM numbered n JOIN many m ON n.tid = m.tid AND n.roi_start = m.roi_start AND n.conversion = m.conversion""",
        "gapped_cigar": f"""WITH RECURSIVE {sql.aligned(SMALL)} SELECT n.tid, n.roi_start, n.conversion, path_id, coalesce(g.cigar, length(n.path) || 'M') AS cigar
          FROM numbered n JOIN ends e ON n.tid = e.tid AND n.roi_start = e.roi_start AND n.conversion = e.conversion LEFT JOIN cigars g ON g.path = n.path AND g.text = e.text""",
        "ref_path_union": f"WITH RECURSIVE {sql.walks(SMALL)} SELECT tid, roi_start, conversion, count(*) AS n_paths, CAST(count(*) - 1 AS INTEGER) AS last_id FROM haps GROUP BY ALL",
        "breadth_cap": f"WITH RECURSIVE {sql.walks(SMALL)} SELECT h.tid, h.roi_start, h.conversion, count(*) AS n_other, count(*) > 1 AS skipped FROM haps h JOIN refs r ON h.tid = r.tid AND h.roi_start = r.roi_start AND h.conversion = r.conversion AND h.path <> r.text GROUP BY ALL",
        "breadth_skipped": f"""WITH RECURSIVE {sql.walks(SMALL)} SELECT e.tid, e.roi_start, e.roi_end, e.conversion, count(w.path) > 1 + 2 * (e.roi_end - e.roi_start - 1) AS too_many
          FROM ends e LEFT JOIN walked w ON w.tid = e.tid AND w.roi_start = e.roi_start AND w.conversion = e.conversion GROUP BY e.tid, e.roi_start, e.roi_end, e.conversion""",
        "realign_full": f"WITH RECURSIVE {sql.realigned(K)}",
        "ungapped_best": f'WITH RECURSIVE {sql.scored(SMALL)} SELECT tid, roi_start, conversion, qname, min(score) AS score, count(*) AS n_paths, CAST(sum(CAST(score AS BIGINT) * 1000 + "offset") AS BIGINT) AS digest FROM scores GROUP BY ALL',
        "path_votes": f"WITH RECURSIVE {sql.scored(SMALL)} SELECT tid, roi_start, conversion, CAST(sum(n) AS BIGINT) AS votes, max(n) AS most FROM voted GROUP BY ALL",
        "path_assign": f'WITH RECURSIVE {sql.scored(SMALL)} SELECT p.tid, p.roi_start, p.conversion, qname, score, "offset", path FROM picked p JOIN numbered n ON p.tid = n.tid AND p.roi_start = n.roi_start AND p.conversion = n.conversion AND p.path_id = n.path_id WHERE place = 1',
        "edit_distance": f"WITH {with_ops}, {sql.DISTANCE} SELECT qname, mismatches, covered FROM dist",
        "accept_rule": f"WITH {with_ops}, {sql.DISTANCE} SELECT d.qname, hamming(r.seq, substr(c.seq, r.pos + 1, 60)) > mismatches AND hamming(r.seq, substr(c.seq, r.pos + 1, 60)) - mismatches >= 60 - covered AS kept FROM dist d JOIN reads r ON d.qname = r.qname AND d.tid = r.tid AND d.pos = r.pos AND d.cigar = r.cigar JOIN contigs c ON r.tid = c.tid",
        "op_oc_tags": f"WITH {plain} SELECT qname, pos + pos % 2 AS new_pos, CASE WHEN pos % 2 <> 0 THEN coalesce({moved.format('5')}, pos + 1) ELSE {moved.format('5')} END AS op, CASE WHEN cigar <> '60M' THEN coalesce({moved.format(chr(39) + '9M' + chr(39))}, cigar) ELSE {moved.format(chr(39) + '9M' + chr(39))} END AS oc FROM reads",
        "coordinate_sort": f"WITH {plain}, {sql.SPANS} SELECT tid, pos, span_end + 1 AS endpos, qname, flag FROM spans ORDER BY ALL",
    }
    assert set(q) <= set(queries())
    return q


