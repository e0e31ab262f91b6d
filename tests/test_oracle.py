"""A sample of the queries against their SQL twins on the smallest tables; the driver compares all of them."""

import os

import duckdb
import pytest
from conftest import SF

import __spark_entry__
from contactspark import queries as map_queries

NAMES = "src3_coarsen co3_genome_to_chrom co7_bp_to_chrom_exclusive sc5_log_ratio_balanced sc7_labels jn4_cut_windows jn5_match_calls ag5_minmax_scale ag9_patch_argmax wn1_chain_groups wn2_thin_anchors wn3_merge_vcf pa1_diagonal_windows pa11_gaussian_blur3 sa1_negatives_per_call sa4_diagonal_negatives job4_evaluate jn2_point_in_interval wn8_order_detections pa4_densify_48 job3_norms job5_filter_real".split()


def cell(x):
    if x is None or isinstance(x, str):
        return str(x)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(cell, x)) + "]"
    return repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    df = map_queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    cursor = con.execute(map_queries.SQL[name])
    columns = [d[0] for d in cursor.description]
    order = sorted(columns)
    assert order == sorted(df.columns)
    want = sorted(tuple(cell(r[columns.index(c)]) for c in order) for r in cursor.fetchall())
    assert sorted(tuple(cell(r[c]) for c in order) for r in df.collect()) == want
    assert want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_only_for_registered_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
