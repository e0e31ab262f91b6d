"""Operators on hand-made maps against dense NumPy, and properties."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from contactspark import queries as map_queries
from contactspark.functions import coords, values
from contactspark.operators import calls, cluster, evaluate, expected, maps, normalize, sampling, scoring, windows
from contactspark.plans import jobs

SIZES = [(0, "a", 25_000), (1, "b", 12_600), (2, "m", 1_700)]
RES = 1000


@pytest.fixture(scope="module")
def chromsizes(spark):
    return spark.createDataFrame(SIZES, "chrom_idx int, chrom string, length long")


def pixels(spark, dense, sample="test", chrom=0):
    rows = [(sample, chrom, i, chrom, j, int(dense[i, j])) for i in range(len(dense)) for j in range(i, len(dense)) if dense[i, j]]
    return spark.createDataFrame(rows, "sample string, chrom1_idx int, bin1 long, chrom2_idx int, bin2 long, count long")


def random_map(n=24, seed=0, zeros=0.5):
    rng = np.random.default_rng(seed)
    a = np.where(rng.random((n, n)) < zeros, 0, rng.integers(1, 9, (n, n)))
    return np.triu(a) + np.triu(a, 1).T


def test_ends_belong_to_different_chromosomes(spark, chromsizes):
    at = spark.createDataFrame([(25,), (26,), (0,), (40,)], "x long")
    found = {r["x"]: (r["chrom_idx"], r["local_bin"]) for r in coords.genome_to_chrom(at, chromsizes, "x", RES).collect()}
    assert found == {25: (0, 25), 26: (1, 1), 0: (0, 0)}
    bp = spark.createDataFrame([(25_000,), (24_999,), (39_300,)], "p long")
    assert {r["p"]: (r["name"], r["pos"]) for r in coords.bp_to_chrom_exclusive(bp, chromsizes, {"p": ("name", "pos")}).collect()} == {25_000: ("b", 0), 24_999: ("a", 24_999)}


def test_genome_and_back_is_the_identity_inside(spark, chromsizes):
    inner = spark.createDataFrame([(i,) for i in range(1, 36)], "x long").withColumn("y", F.col("x"))
    there = coords.genome_to_chrom_pair(inner, chromsizes, RES)
    back = coords.chrom_to_genome_pair(there.withColumnsRenamed({"x": "gx", "y": "gy", "local_x": "x", "local_y": "y"}), chromsizes, RES)
    assert back.where("gx <> genome_x and chrom1_idx = 0").count() == 0
    assert back.where("abs(gx - genome_x) > 1").count() == 0


def test_coarsen_in_two_steps_and_totals(spark):
    p = pixels(spark, random_map())
    once = {tuple(r) for r in maps.coarsen(p, 10).collect()}
    assert {tuple(r) for r in maps.coarsen(maps.coarsen(p, 2), 5).collect()} == once
    assert sum(r[-1] for r in once) == p.agg(F.sum("count")).first()[0]


def test_missing_resolution(spark):
    p = pixels(spark, random_map()).withColumn("resolution", F.lit(1000))
    maps.check_resolutions(p, [1000])
    with pytest.raises(ValueError):
        maps.check_resolutions(p, [1000, 5000])


def test_diagonal_means(spark):
    dense = random_map()
    n = spark.createDataFrame([(0, 24)], "chrom_idx int, n long")
    found = {r["d"]: r["expected"] for r in normalize.diagonal_expected(pixels(spark, dense), n).collect()}
    for d, v in found.items():
        assert v == pytest.approx(np.diagonal(dense, d).mean())


@pytest.mark.parametrize("zeros", [0.0, 0.6])
def test_scaling_counts_zeros_only_where_there_are_some(spark, zeros):
    dense = random_map(8, 3, zeros).astype(float)
    rows = [(0, i, j, float(dense[i, j])) for i in range(8) for j in range(8) if dense[i, j]]
    df = spark.createDataFrame(rows, "k int, dx int, dy int, value double").withColumn("cells", F.lit(64))
    want = 2 * (dense - dense.min()) / (dense.max() - dense.min()) - 1
    for r in normalize.minmax_scale(df, ["k"], "cells").collect():
        assert r["scaled"] == pytest.approx(want[r["dx"], r["dy"]])


def test_constant_block_has_no_scale(spark):
    df = spark.createDataFrame([(0, 2.0), (0, 2.0)], "k int, value double").withColumn("cells", F.lit(2))
    assert {r["scaled"] for r in normalize.minmax_scale(df, ["k"], "cells").collect()} == {None}


def test_windows_at_the_borders(spark):
    dense = random_map()
    cells = maps.symmetric(pixels(spark, dense)).withColumn("value", F.col("count").cast("double"))
    corners = [(-3, 2), (20, 20), (5, 5), (22, -2)]
    w = spark.createDataFrame([(k, 0, 0, x, y) for k, (x, y) in enumerate(corners)], "patch_id long, chrom1_idx int, chrom2_idx int, x long, y long")
    got = {r["patch_id"]: np.array(r["values"]).reshape(6, 6) for r in scoring.densify(windows.cut_windows(cells, w, 6), 6).collect()}
    big = np.pad(dense, 10)
    for k, (x, y) in enumerate(corners):
        assert (got[k] == big[x + 10 : x + 16, y + 10 : y + 16]).all()


def test_window_join_has_no_nested_loop(spark):
    cells = maps.symmetric(pixels(spark, random_map())).withColumn("value", F.col("count").cast("double"))
    w = spark.createDataFrame([(1, 0, 0, 3, 3)], "patch_id long, chrom1_idx int, chrom2_idx int, x long, y long")
    plan = windows.cut_windows(cells, w, 6)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_diagonal_windows_move_back_at_the_end(spark):
    c = spark.createDataFrame([(i, j) for i in range(22) for j in range(i, min(22, i + 8))], "bin1 long, bin2 long")
    got = {(r["window"], r["bin1"], r["bin2"]) for r in windows.diagonal_windows(c, 22, 8, 4).collect()}
    want = {(w, i, j) for w in range(22 // 4) for s in [min(w * 4, 14)] for i in range(s, s + 8) for j in range(i, s + 8)}
    assert got == want


def test_argmax_ties_and_empty(spark):
    df = spark.createDataFrame([(0, 1, 2, 5.0), (0, 2, 1, 5.0), (1, 3, 3, 0.0)], "k int, dx long, dy long, value double")
    assert {r["k"]: (r["dx"], r["dy"]) for r in cluster.patch_argmax(df, ["k"]).collect()} == {0: (1, 2), 1: (0, 0)}


def test_recentre(spark):
    rows = [(0, 4, 4, 8.0), (0, 1, 1, 64.0), (1, 4, 4, 16.0), (1, 2, 2, 20.0), (2, 3, 3, 1.0)]
    df = spark.createDataFrame(rows, "k int, dx long, dy long, value double")
    assert {r["k"]: (r["move_x"], r["move_y"]) for r in cluster.recentre(df, 8, ["k"]).collect()} == {0: (-3, -3), 1: (0, 0), 2: (-1, -1)}


def test_chains_and_ties(spark):
    det = spark.createDataFrame([(0, 1, 5), (0, 3, 3), (0, 4, 4), (0, 30, 30)], "k int, x long, y long")
    boxes = cluster.chain_groups(det, 2, ["k"]).orderBy("chain").collect()
    assert [(b["x0"], b["width"], b["members"]) for b in boxes] == [(0, 5, 3), (29, 2, 1)]
    assert cluster.chain_groups(det.limit(0), 2, ["k"]).count() == 0


def test_thinning_is_greedy(spark):
    df = spark.createDataFrame([(0, x) for x in (0, 3, 5, 9, 10, 20)], "k int, x long")
    assert sorted(r["x"] for r in cluster.thin_anchors(df, 8, ["k"]).collect()) == [0, 5, 10, 20]


def test_merge_reaches_over_a_long_one(spark):
    v = spark.createDataFrame([("a", 0, 100), ("a", 20, 10), ("a", 105, 5), ("a", 500, 3)], "chrom string, pos long, sv_len long")
    got = sorted((r["start"], r["end"]) for r in calls.merge_vcf(v, 10, 0).collect())
    assert got == [(0, 110), (500, 503)]


def test_duplicates_all_go(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert [tuple(r) for r in calls.drop_all_duplicates(df).collect()] == [(2, "x")]


def test_matching_by_buckets(spark):
    rng = np.random.default_rng(1)
    r, a = rng.integers(0, 500, (60, 2)), rng.integers(0, 500, (40, 2))
    res = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(r)], "result_id long, bp_1 long, bp_2 long")
    ans = spark.createDataFrame([(int(x), int(y)) for x, y in a], "bp_1 long, bp_2 long")
    for g in evaluate.match_calls(res, ans, 3).collect():
        assert g["found_x"] == bool((abs(a[:, 1] - g["bp_1"]) <= 3).any()) and g["found_y"] == bool((abs(a[:, 0] - g["bp_2"]) <= 3).any())


def test_samples_do_not_depend_on_partitions(spark, chromsizes):
    c = spark.createDataFrame([(i,) for i in range(50)], "call_id long")
    one = {tuple(r) for r in sampling.negatives_per_call(c.repartition(1), chromsizes, 4, RES).collect()}
    assert one == {tuple(r) for r in sampling.negatives_per_call(c.repartition(7), chromsizes, 4, RES).collect()} and len(one) == 50
    lengths = {k: n for k, _, n in SIZES}
    assert all(2000 <= r[2] <= lengths[r[1]] - 2001 for r in one)


def test_log_values(spark):
    v = spark.createDataFrame([(0,), (100,)], "v long").select(values.log_value(F.col("v")).alias("a"), values.log_value(F.col("v"), zero_to_null=True).alias("b")).collect()
    assert v[0]["a"] == float("-inf") and v[0]["b"] is None and v[1]["a"] == pytest.approx(2)


def test_patch_keys(spark):
    k = spark.createDataFrame([("chr_1_10_20.png",), ("x",)], "k string").select(values.parse_patch_key(F.col("k")).alias("p")).collect()
    assert tuple(k[0]["p"]) == ("chr_1", 10, 20) and k[1]["p"]["x"] is None


def test_conv_scorer_against_loops():
    rng = np.random.default_rng(2)
    w, b = rng.normal(size=(2, 1, 3, 3)), rng.normal(size=2)
    x = rng.normal(size=(3, 4, 4))
    dense = (rng.normal(size=(1, 8)), np.zeros(1))
    s = scoring.ConvScorer([[("conv", w, b), ("relu",), ("pool",)]], [dense])
    out = []
    for m in x:
        p, y = np.pad(m, 1), np.zeros((2, 4, 4))
        for o in range(2):
            for i in range(4):
                for j in range(4):
                    y[o, i, j] = max(0, (p[i : i + 3, j : j + 3] * w[o, 0]).sum() + b[o])
        pooled = [y[o, i : i + 2, j : j + 2].max() for o in range(2) for i in (0, 2) for j in (0, 2)]
        out.append(1 / (1 + np.exp(-(dense[0] @ pooled)[0])))
    assert np.allclose(s(x), out)


def test_lowess_keeps_a_line_and_coarsegrain_fills():
    x = np.linspace(0, 3, 50)
    assert np.allclose(expected.lowess(x, 2 * x + 1, 0.3), 2 * x + 1)
    counts = np.full((4, 4), 9)
    values_ = np.arange(16.0).reshape(4, 4)
    assert np.allclose(expected.coarsegrain(values_, counts), values_)
    counts[:2, :2] = 0
    filled = expected.coarsegrain(values_, counts)
    assert np.allclose(filled[:2, :2], values_.mean()) and np.allclose(filled[2:], values_[2:])
    counts[:2, :2] = 2
    assert np.allclose(expected.coarsegrain(values_, counts)[:2, :2], values_[:2, :2].mean())


def test_planted_block_is_found(spark, tmp_path):
    """A block of contacts far from the diagonal, in one sample only, gives a breakpoint near it."""
    n = 192
    rng = np.random.default_rng(5)
    base = np.maximum(0, 24 - abs(np.subtract.outer(np.arange(n), np.arange(n)))) // 2 + rng.integers(0, 2, (n, n))
    base = np.triu(base) + np.triu(base, 1).T
    test = base.copy()
    for c in (48, 144):
        test[c - 4 : c + 4, c - 4 : c + 4] *= 9
    test[142:146, 46:50] += 400
    test[46:50, 142:146] = test[142:146, 46:50].T
    one = pixels(spark, test).union(pixels(spark, base, "clean"))
    both = {1000: one, 2000: maps.coarsen(one, 2), 4000: maps.coarsen(one, 4)}
    sizes = spark.createDataFrame([(0, "a", n * 1000 - 1)], "chrom_idx int, chrom string, length long")
    found = jobs.detect_svs(both, sizes, scoring.contrast, lambda s: np.stack([s.mean(axis=(1, 2))] * 5, axis=1), size=8, class_size=8, resolutions=(4000, 2000, 1000), cutoff=0.6, stage_path=str(tmp_path)).collect()
    assert any(abs(r["bp_1"] - 144_000) <= 8000 and abs(r["bp_2"] - 48_000) <= 8000 for r in found)


def test_dense_windows_of_48_bins(spark):
    """Cells of one place count once, gaps and ends are filled, and the work follows the places."""
    rng = np.random.default_rng(7)
    want = np.where(rng.random((3, 48, 48)) < 0.3, rng.integers(1, 9, (3, 48, 48)), 0).astype(float)
    rows = [(k, i, j, float(want[k, i, j])) for k, i, j in zip(*np.nonzero(want), strict=True)]
    rows += [(int(k), int(i), int(j), 0.5) for k, i, j, _ in rows[:40]] + [(0, 0, 0, None)]
    df = spark.createDataFrame([(int(k), int(i), int(j), v) for k, i, j, v in rows], "patch_id int, dx int, dy int, value double")
    got = {r["patch_id"]: np.array(r["values"]) for r in scoring.densify(df, 48).collect()}
    assert len(got) == 3 and all((got[k] == want[k].reshape(-1)).all() for k in got)


def test_scorer_from_a_file(tmp_path):
    rng = np.random.default_rng(2)
    blocks = [[("conv", rng.normal(size=(2, 1, 3, 3)), rng.normal(size=2)), ("norm", rng.normal(size=2), rng.normal(size=2)), ("relu",), ("pool",)] for _ in range(3)]
    scorer = scoring.ConvScorer(blocks, [(rng.normal(size=(4, 24)), np.zeros(4)), (rng.normal(size=(1, 4)), np.zeros(1))])
    scorer.save(str(tmp_path / "w.npz"))
    x = rng.normal(size=(5, 4, 4))
    assert np.allclose(scoring.ConvScorer.load(str(tmp_path / "w.npz"))(x), scorer(x))


def test_order_of_detections(spark):
    rng = np.random.default_rng(3)
    rows = [tuple(int(v) for v in r) for r in rng.integers(0, 6, (300, 4))] + [(None, 0, 1, 1)]
    df = spark.createDataFrame(rows, "chrom1_idx int, chrom2_idx int, x long, y long").repartition(5)
    got = sorted((r["place"], *[-1 if v is None else v for v in r[:4]]) for r in cluster.order_detections(df).collect())
    assert [g[0] for g in got] == list(range(301)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
    assert cluster.order_detections(df.limit(0)).count() == 0


def test_coarsegrained_patches(spark):
    rng = np.random.default_rng(4)
    v, n = rng.random((4, 36)).round(3), rng.integers(0, 5, (4, 36))
    rows = [(k, [None if i == 5 else float(x) for i, x in enumerate(v[k])], [int(x) for x in n[k]]) for k in range(4)] + [(9, None, None)]
    df = spark.createDataFrame(rows, "patch_id int, values array<double>, counts array<int>")
    for r in expected.adaptive_coarsegrain(df, 6).collect():
        if r["patch_id"] == 9:
            assert r["coarse"] is None
            continue
        a = v[r["patch_id"]].copy()
        a[5] = np.nan
        want = expected.coarsegrain(a.reshape(6, 6), n[r["patch_id"]].reshape(6, 6)).reshape(-1)
        assert np.allclose(np.array([np.nan if x is None else x for x in r["coarse"]]), want, equal_nan=True) and r["coarse"][5] is None


def test_anchor_pairs_by_blocks(spark):
    anchors = [(c, x) for c in range(3) for x in range(0, 60, 5)]
    df = spark.createDataFrame(anchors, "chrom_idx int, x long")
    for by_chrom in (False, True):
        want = set()
        for c, x in anchors:
            for d, y in anchors:
                order = (c == d and x >= y) or c > d if by_chrom else x >= y
                if order and not (c == d and abs(x - y) < 8):
                    want.add((c, x, d, y))
        found = [(r["chrom1_idx"], r["x"], r["chrom2_idx"], r["y"]) for r in windows.cross_anchors(df, 8, by_chrom, block=7).collect()]
        assert len(found) == len(want) and set(found) == want
    plan = windows.cross_anchors(df, 8)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_windows_without_cells_are_scored(spark, chromsizes):
    """An empty window is a patch of scaled zeros, one over the end a patch of plain zeros."""
    cells = spark.createDataFrame([(0, 10, 0, 10, 3.0), (0, 11, 0, 11, -1.0)], "chrom1_idx int, bin1 long, chrom2_idx int, bin2 long, value double")
    ends = spark.createDataFrame([(0, 0, -1.0, 3.0)], "chrom1_idx int, chrom2_idx int, lo double, hi double")
    points = spark.createDataFrame([(0, 0, 10, 10), (0, 0, 20, 20), (0, 0, 1, 1), (0, 0, 10, 10)], "chrom1_idx int, chrom2_idx int, x long, y long")
    mean = lambda s: s.mean(axis=(1, 2))
    got = {(r["x"], r["y"]): r["score"] for r in jobs.score_points(cells, points, 4, mean, blur=False, ends=ends, inside=(chromsizes, RES)).collect()}
    zero = 2 * 1 / 4 - 1
    assert got == {(10, 10): pytest.approx((1 - 1 + 14 * zero) / 16), (20, 20): pytest.approx(zero), (1, 1): 0.0}
    plain = {(r["x"], r["y"]): r["score"] for r in jobs.score_points(cells, points, 4, lambda s: mean(s) + 7, blur=False).collect()}
    assert plain == {(10, 10): pytest.approx(7 + 2 / 16), (20, 20): 7.0, (1, 1): 7.0}


def test_diagonal_scan_by_a_scorer(spark):
    """Each window is scaled by itself, zeros included; those without cells score as zeros."""
    rng = np.random.default_rng(6)
    dense = [np.triu(rng.integers(0, 4, (40, 40))) for _ in range(2)]
    p = pixels(spark, dense[0]).union(pixels(spark, dense[1], "clean")).where("bin1 < 24 and bin2 < 24")
    sizes = spark.createDataFrame([(0, "a", 40_000)], "chrom_idx int, chrom string, length long")
    fn = lambda s: 0.6 + s[:, 2, 2] / 10
    got = {r["window"]: r["score"] for r in jobs.scan_diagonal(p, sizes, RES, 8, 4, scorer=fn).collect()}
    a, b = (np.where((np.arange(40) < 24)[:, None] & (np.arange(40) < 24), d + np.triu(d, 1).T, 0) for d in dense)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where((a > 0) & (b > 0), np.log10(a) - np.log10(b) + 1e-6, 0.0)
    for w in range(10):
        s = min(w * 4, 32)
        m = ratio[s : s + 8, s : s + 8]
        scaled = 2 * (m - m.min()) / (m.max() - m.min()) - 1 if m.max() > m.min() else m * 0
        score = fn(scaled[None])[0]
        assert (w in got) == (score > 0.5) and (w not in got or got[w] == pytest.approx(score))


def test_unknown_normalisation_is_an_error(spark, chromsizes):
    p = pixels(spark, random_map())
    with pytest.raises(ValueError):
        jobs.training_cells(p, chromsizes, RES, "other")
    with pytest.raises(ValueError):
        jobs.training_cells(p, chromsizes, RES, "balanced")


def test_smoothing_of_a_query_is_local_lines(spark):
    """Each smoothed value is the weighted line through its nearest points, worked out by lstsq."""
    x = np.arange(60)
    y = np.sin(x / 9.0) - x / 20
    df = spark.createDataFrame([("s", int(d), float(v)) for d, v in zip(x, y, strict=True)], "sample string, dist long, log_avg double")
    got = {r["dist"]: r["smooth"] for r in expected.smooth_expected(df, ["sample"], head=8, near=40, near_frac=0.1, far_frac=0.3).collect()}
    t = np.log(x + 1.0)[8:]
    for d in x:
        if d < 8:
            assert got[d] == pytest.approx(y[d])
            continue
        k = int(np.ceil((0.1 if d < 40 else 0.3) * len(t)))
        far = np.abs(t - np.log(d + 1.0))
        near = np.argsort(far, kind="stable")[:k]
        w = np.sqrt((1 - np.minimum(far[near] / far[near].max(), 1) ** 3) ** 3 + 1e-12)
        line = np.linalg.lstsq(np.c_[np.ones(k), t[near]] * w[:, None], y[8:][near] * w, rcond=None)[0]
        assert got[d] == pytest.approx(line[0] + line[1] * np.log(d + 1.0), abs=1e-6)


def test_chains_over_ranges(spark):
    """Chains and thinned points are those of one pass, though the order is dealt out in ranges."""
    rng = np.random.default_rng(9)
    det = sorted({(int(k), int(x), int(y)) for k, x, y in np.c_[rng.integers(0, 3, 400), rng.integers(0, 300, (400, 2))]})
    df = spark.createDataFrame(det, "k int, x long, y long")
    boxes = {(b["k"], b["chain"]): b["members"] for b in cluster.chain_groups(df, 4, ["k"]).collect()}
    want = {}
    for k in range(3):
        before, chain = None, 0
        for x, y in sorted(((x, y) for j, x, y in det if j == k), key=lambda p: (p[0] + p[1], *p)):
            chain += before is not None and (x - before[0]) ** 2 + (y - before[1]) ** 2 > 32
            want[k, chain] = want.get((k, chain), 0) + 1
            before = (x, y)
    assert boxes == want
    kept = sorted((r["k"], r["x"]) for r in cluster.thin_anchors(df, 8, ["k"]).collect())
    greedy = []
    for k in range(3):
        last = None
        for x in sorted({x for j, x, _ in det if j == k}):
            if last is None or x - 4 > last:
                greedy.append((k, x))
                last = x
    assert kept == greedy


def test_recentre_takes_ties_as_sql_does(spark):
    """22 against 11 is a doubling: the difference of the two logarithms as the C library has them, not as Java has."""
    pairs = [(2 * n, n) for n in range(8, 128)]
    rows = [(k, dx, dx, float(v)) for k, (most, mid) in enumerate(pairs) for dx, v in ((1, most), (4, mid))]
    got = {r["k"]: r["move_x"] for r in cluster.recentre(spark.createDataFrame(rows, "k int, dx int, dy int, value double"), 8, ["k"]).collect()}
    want = duckdb.connect().execute(f"select {', '.join(f'log2({a}::double) - log2({b}::double) > floor(log2({a}::double) / 4)' for a, b in pairs)}").fetchone()
    assert [got[k] == -3 for k in range(len(pairs))] == list(want)


def test_zeros_keep_their_sign_as_in_sql(spark, monkeypatch):
    """Numbers that round to zero: the queries' own rounding of arrays against DuckDB's."""
    rows = [(k, [[-1e-9, 1e-9, -0.3, 0.0][(k // 4 + i) % 4] for i in range(64)]) for k in range(8)]
    df = spark.createDataFrame(rows, "patch_id long, values array<double>")
    monkeypatch.setattr(map_queries, "patches", lambda *_: df)
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding double[])")
    con.executemany("insert into embeddings values (?, ?)", rows)
    for name in NAMES_OF_ARRAYS:
        want = con.execute(f"select {name[1]} from ({name[2]}) order by patch_id").fetchall()
        got = map_queries.QUERIES[name[0]](None, None).orderBy("patch_id").select(name[1]).collect()
        assert any(str(x) == "-0.0" for r in want for x in r[0])
        assert [[str(x) for x in r[0]] for r in got] == [[str(x) for x in r[0]] for r in want]


#: Name, column and the SQL without its views, which need tables that these queries do not.
NAMES_OF_ARRAYS = [(n, c, map_queries.SQL[n].rpartition("\nselect")[1].strip() + map_queries.SQL[n].rpartition("\nselect")[2]) for n, c in (("ag17_ensemble_average", "scores"), ("pa11_gaussian_blur3", "blurred"))]


def test_places_of_rows_that_come_in_any_order(spark, request):
    """Rows that come in another order each time they are read, as after a shuffle; so the bounds of ranges fall elsewhere each time."""
    df = spark.range(20_000, numPartitions=4).select(F.lit(0).alias("chrom1_idx"), F.lit(0).alias("chrom2_idx"), F.xxhash64("id").alias("x"), F.col("id").alias("y"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so short a table is one range
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    out = cluster.order_detections(df.mapInPandas(lambda frames: (f.sample(frac=1, random_state=int.from_bytes(os.urandom(4))) for f in frames), df.schema))
    for _ in range(2):
        assert tuple(out.agg(F.count_distinct("place"), F.min("place"), F.max("place")).first()) == (20_000, 0, 19_999)
