"""Queries against their SQL."""

import os

import duckdb
import pytest

from haplospark.plans.queries import oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
SMALL = os.path.join(os.path.dirname(SF), "sf0.001")
LIGHT = ("reads_scan", "contigs_scan", "cigar_ops", "base_positions", "read_span", "indel_events", "roi_islands", "roi_depth", "bed_merge", "strand_class", "ct_convert", "ga_convert", "reduced_alphabet", "roi_overlap", "roi_group_members", "chain_reads", "roi_group_cap", "reads_outside", "ref_window", "roi_chains", "max_indel", "sketch_layout", "edit_distance", "accept_rule", "op_oc_tags")


#: Those whose SQL walks graphs or fills matrices, on the smallest tables.
DEEP = ("kmer_murmur", "kmer_edges", "haplotype_paths_25", "breadth_skipped", "gapped_cigar", "realign_full")


def duck(folder):
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for name in ("supplier", "lineitem"):
        c.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return c


def compared(spark, name, folder):
    df = queries()[name](spark, folder)
    got = sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    out = duck(folder).execute(oracle_sql()[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    assert got == sorted((tuple(r[i] for i in at) for r in out.fetchall()), key=repr)


@pytest.mark.parametrize("name", LIGHT)
def test_query(spark, name):
    compared(spark, name, SF)


@pytest.mark.parametrize("name", DEEP)
def test_deep_query(spark, name):
    compared(spark, name, SMALL)


def test_names():
    assert set(oracle_sql()) <= set(queries())
