"""Queries that do the whole job: all positions, resolutions, chromosomes and components."""

import os

import duckdb
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_oracle import cell

import __spark_entry__
from contactspark import queries as map_queries
from contactspark.operators import evaluate, windows
from contactspark.plans import jobs
from contactspark.plans import queries as plan_queries


@pytest.mark.parametrize("name", "job2_scan_resolutions pa3_windows_or_zero fi9_upper ag17_ensemble_average ag18_feature_correlation ag14_one_to_one wn7_smooth_expected job10_expected_curve src8_read_fasta_lengths wn5_running_min wn6_truncate".split())
def test_whole_query_matches_sql(spark, name):
    df = map_queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    cursor = con.execute(map_queries.SQL[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(tuple(map(cell, r)) for r in cursor.fetchall())
    assert sorted(columns) == sorted(df.columns) and want
    assert sorted(tuple(cell(r[c]) for c in columns) for r in df.collect()) == want


def test_flagship_scans_all_resolutions_by_quarters(spark):
    found = __spark_entry__.entry(spark).collect()
    assert {r["resolution"] for r in found} == {50000, 25000, 10000}
    assert len({r["local_bin"] % 4 for r in found if r["resolution"] == 10000 and r["chrom_idx"] == 0}) > 1


def test_two_step_scan_finds_breakpoints_between_strides(spark, monkeypatch):
    """Breakpoints at bins 16 and 32, which only windows at other than every eighth position have in their centre block."""
    spots = [(15, 15), (15, 16), (16, 16), (31, 31), (31, 32), (32, 32), (15, 31), (15, 32), (16, 31), (16, 32)]
    cells = spark.createDataFrame([("test", 0, i, 0, j, 1000) for i, j in spots], "sample string, chrom1_idx int, bin1 long, chrom2_idx int, bin2 long, count long")
    sizes = spark.createDataFrame([(0, "a", 40 * 50_000)], "chrom_idx int, chrom string, length long")
    monkeypatch.setattr(plan_queries, "pixels", lambda *_: cells)
    monkeypatch.setattr(plan_queries, "chromsizes", lambda *_: sizes)
    found = plan_queries.job9_two_step(None, None).collect()
    assert any(abs(r["x"] - 32) <= 1 and abs(r["y"] - 16) <= 1 for r in found)


def test_maps_end_with_their_chromosomes(spark):
    sizes = spark.createDataFrame([(0, "a", 200 * 50_000), (3, "d", 20 * 50_000)], "chrom_idx int, chrom string, length long")
    at = [(0, 0, 150, 160), (0, 0, 150, 193), (0, 3, 5, 12), (0, 3, 5, 13), (3, 3, -1, 2), (3, 3, 9, 8)]
    w = spark.createDataFrame(at, "chrom1_idx int, chrom2_idx int, x long, y long").withColumn("patch_id", F.concat_ws("-", "chrom1_idx", "chrom2_idx", "x", "y"))
    kept = windows.filter_corners_inside(w, sizes, 8, 50_000, upper=True).collect()
    assert sorted(r["patch_id"] for r in kept) == ["0-0-150-160", "0-3-5-12"]
    cells = spark.createDataFrame([(a, x + 3, b, y + 3, 5.0) for a, b, x, y in at], "chrom1_idx int, bin1 long, chrom2_idx int, bin2 long, value double")
    out = jobs.windows_of_maps_or_zero(cells, w, sizes, 50_000, 8).collect()
    assert len(out) == len(at) and sorted(r["patch_id"] for r in out if any(r["values"])) == ["0-0-150-160", "0-3-5-12", "3-3-9-8"]


def test_correlation_of_all_components(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 12)) + 1000
    df = spark.createDataFrame([(r.tolist(),) for r in x], "values array<double>").repartition(3)
    got = {(r["i"], r["j"]): r["corr"] for r in evaluate.full_feature_correlation(df).collect()}
    want = np.corrcoef(x.T)
    assert len(got) == 78 and all(v == pytest.approx(want[k]) for k, v in got.items())
