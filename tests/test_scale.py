"""Forms that hold at scale, against plain versions: blocks, tiles, ranges, splits, buckets."""

import random
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from contactspark.functions import coords, ranges
from contactspark.operators import blocks, calls, cluster, evaluate, expected, maps, scoring, windows
from contactspark.plans import jobs
from contactspark.sources import readers, store

POINT = "chrom1_idx int, chrom2_idx int, x long, y long"
CELLS = "chrom1_idx int, bin1 long, chrom2_idx int, bin2 long, value double"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- windows in blocks


@pytest.mark.parametrize("block", [None, 5, 8, 64])
@pytest.mark.parametrize("scaled", [False, True])
def test_blocks_score_as_single_windows(spark, block, scaled):
    rng = random.Random(1)
    rows = {(c, d, rng.randrange(-3, 60), rng.randrange(-3, 60)): rng.choice([None, 0.0, -1.5, 2.25, 3.5]) for _ in range(500) for c, d in ((0, 0), (0, 1))}
    rows = [(c, x, d, y, v) for (c, d, x, y), v in rows.items()] + [(0, 5, 0, 5, 1.0), (0, 5, 0, 5, 4.0), (0, 5, 0, 5, -9.0)]
    cells = spark.createDataFrame(rows, CELLS).repartition(3)
    points = sorted({(rng.choice([0, 0, 1]), rng.choice([0, 1]), rng.randrange(-10, 70), rng.randrange(-10, 70)) for _ in range(400)} | {(0, 0, x, y) for x in range(20) for y in range(20)})
    ends = {(0, 0): (-1.5, 4.0), (0, 1): (2.0, 2.0), (1, 0): (0.0, 1.0)} if scaled else {}
    fn = lambda s: s[:, 0, 0] * 3 + s.sum(axis=(1, 2)) + s[:, 2, 1]
    table = spark.createDataFrame([(*k, *v) for k, v in ends.items()], "chrom1_idx int, chrom2_idx int, lo double, hi double") if scaled else None
    got = {(r["chrom1_idx"], r["chrom2_idx"], r["x"], r["y"]): r["score"] for r in blocks.score_corners(cells, spark.createDataFrame(points, POINT), 6, fn, table, block=block, batch=7).collect()}
    dense = {}
    for c, x, d, y, v in rows:
        if v is not None:
            k = (c, d, x, y)
            dense[k] = max(v, dense.get(k, -1e9))
    empty = 0
    for c, d, x, y in points:
        patch = np.array([[dense.get((c, d, x + i, y + j), 0.0) for j in range(6)] for i in range(6)])
        if scaled:
            lo, hi = ends.get((c, d), (0.0, 0.0))
            patch = 2 * (patch - lo) / (hi - lo) - 1 if hi > lo else np.zeros((6, 6))
        if (c, d, x, y) in got:
            assert got[c, d, x, y] == pytest.approx(float(fn(patch[None])[0]))
        else:  # a block without any cell
            empty += 1
            assert not any((c, d, x + i, y + j) in dense for i in range(6) for j in range(6))
    assert len(got) + empty == len(points)


def test_rows_of_blocks_follow_the_cells(spark):
    """A box of windows at every place: each cell goes to four blocks at most, not to every window that holds it."""
    cells = spark.range(9216).select(F.lit(0).alias("chrom1_idx"), F.expr("id div 96").alias("bin1"), F.lit(0).alias("chrom2_idx"), (F.col("id") % 96).alias("bin2"), F.lit(1.0).alias("value"))
    corners = spark.range(49 * 49).select(F.lit(0).alias("chrom1_idx"), F.lit(0).alias("chrom2_idx"), F.expr("id div 49").alias("x"), (F.col("id") % 49).alias("y"))
    rows = blocks.blocks_of(cells, corners, 48, 48).select(F.size("cells").alias("n"), F.size("spots").alias("m")).collect()
    assert sum(r["n"] for r in rows) <= 4 * 9216 and sum(r["m"] for r in rows) == 49 * 49


def test_tiles_leave_only_cells_near_windows(spark):
    rng = random.Random(2)
    rows = [(0, rng.randrange(5000), 0, rng.randrange(5000), 1.0) for _ in range(5000)]
    cells = spark.createDataFrame(rows, CELLS)
    corners = spark.createDataFrame([(0, 0, 100, 200), (0, 0, 3000, 10)], POINT)
    kept = {(r["bin1"], r["bin2"]) for r in blocks.near(cells.where("bin1 <= bin2"), corners, 50).collect()}
    wanted = {(min(a, b), max(a, b)) for _, a, _, b, _ in rows for x, y in ((100, 200), (3000, 10)) for a, b in ((a, b), (b, a)) if x <= a < x + 50 and y <= b < y + 50 and (min(a, b), max(a, b)) in {(p, q) for _, p, _, q, _ in rows}}
    assert wanted <= kept and len(kept) < 50
    assert len(blocks.touched(cells, corners, 50, most=1).collect()) == 5000  # too many tiles to broadcast: all stay
    pairs = maps.pair_samples(blocks.near(cells.withColumns({"sample": F.lit("test"), "count": F.lit(1)}), corners, 50))
    shuffled = plan_of(pairs).split("Exchange hashpartitioning")
    assert all("BroadcastHashJoin" in part and "LeftSemi" in part for part in shuffled[1:])  # the tiles are met below every shuffle


# --- training sets of a manifest


def test_manifest_in_one_plan_is_what_single_sets_are(spark, tmp_path):
    rng = random.Random(3)
    rows = [(s, c, x, c, min(59, x + rng.randrange(6)), rng.randrange(1, 9)) for s in ("a", "b", "k") for c in (0, 1) for x in range(60) for _ in range(2)]
    pixels = spark.createDataFrame(rows, "sample string, chrom1_idx int, bin1 long, chrom2_idx int, bin2 long, count long").groupBy("sample", "chrom1_idx", "bin1", "chrom2_idx", "bin2").agg(F.sum("count").alias("count"))
    sizes = spark.createDataFrame([(0, "x", 600_000), (1, "y", 590_000)], "chrom_idx int, chrom string, length long")
    truth = spark.createDataFrame([(t, i, i % 2, 60_000 + 10_000 * i, 200_000 + 20_000 * i, lab) for t, lab in (("t1", "++"), ("t2", "-+")) for i in range(9)], "truth_id string, call_id long, chrom_idx int, start long, end long, label string")
    manifest = spark.createDataFrame([("a", "k", "t1", "train"), ("b", "k", "t1", "train"), ("b", "a", "t2", "test"), ("a", "k", "t1", "train")], "sample_id string, clean_id string, truth_id string, split string")
    shown = lambda df: sorted(str([r[c] if c != "values" else [round(v, 9) for v in r[c]] for c in ("call_id", "is_sv", "which", "label_idx", "values")]) for r in df.collect())
    for norm in ("masked", "exp/obs"):
        every = jobs.build_training_sets(manifest, pixels, truth, sizes, 10_000, 8, norm=norm)
        total = 0
        for s, k, t in (("a", "k", "t1"), ("b", "k", "t1"), ("b", "a", "t2")):
            two = [pixels.where(F.col("sample") == n).withColumn("sample", F.lit(as_)) for n, as_ in ((s, "test"), (k, "clean"))]
            one = jobs.build_training_set(truth.where(F.col("truth_id") == t), two[0].unionByName(two[1]), sizes, 10_000, 8, norm=norm)
            mine = every.where((F.col("sample_id") == s) & (F.col("clean_id") == k) & (F.col("truth_id") == t))
            assert shown(mine) == shown(one)
            total += one.count()
        assert every.count() == total == 3 * 36
    path = str(tmp_path / "sets")
    for _ in range(2):  # a rerun leaves the same rows
        jobs.write_training_sets(manifest, pixels, truth, sizes, 10_000, 8, path)
        assert spark.read.parquet(path).count() == 3 * 36


def test_many_sets_are_one_write(spark, tmp_path):
    pixels = spark.range(200 * 20).select((F.col("id") % 200).cast("string").alias("sample"), F.lit(0).alias("chrom1_idx"), F.expr("id div 200").alias("bin1"), F.lit(0).alias("chrom2_idx"), F.expr("id div 200 + 1").alias("bin2"), F.lit(3).alias("count"))
    sizes = spark.createDataFrame([(0, "x", 600_000)], "chrom_idx int, chrom string, length long")
    truth = spark.createDataFrame([("t", 1, 0, 60_000, 200_000, "++")], "truth_id string, call_id long, chrom_idx int, start long, end long, label string")
    manifest = spark.range(200).select(F.col("id").cast("string").alias("sample_id"), F.lit("0").alias("clean_id"), F.lit("t").alias("truth_id"), F.lit("train").alias("split"))
    jobs.write_training_sets(manifest, pixels, truth, sizes, 10_000, 8, str(tmp_path / "many"))
    assert spark.read.parquet(str(tmp_path / "many")).groupBy("sample_id").count().where("count = 4").count() == 200


# --- positions among many contigs


def test_positions_among_many_contigs(spark):
    rng = random.Random(4)
    lengths = [rng.choice([0, 1, 7, 100, 5000, 90_000]) for _ in range(3000)]
    sizes = spark.createDataFrame([(i, f"k{i}", n) for i, n in enumerate(lengths)], "chrom_idx int, chrom string, length long")
    stops = np.cumsum(lengths)
    points = sorted({rng.randrange(-50, int(stops[-1]) + 500) for _ in range(4000)} | {0, 1, int(stops[-1]), *map(int, stops[:50])})
    df = spark.createDataFrame([(p,) for p in points], "p long")
    got = coords.genome_to_chrom(df, sizes, "p", 1)
    assert "NestedLoop" not in plan_of(got)
    want = [(p, i, p if i == 0 else p - int(stops[i] - lengths[i])) for p in points if p <= stops[-1] for i in [0 if p <= stops[0] else int(np.searchsorted(stops, p))]]
    assert sorted((r["p"], r["chrom_idx"], r["local_bin"]) for r in got.collect()) == want
    out = coords.bp_to_chrom_exclusive(df, sizes, {"p": ("chrom", "pos")})
    assert "NestedLoop" not in plan_of(out)
    want = [(p, f"k{i}", p - int(stops[i] - lengths[i])) for p in points if 0 <= p < stops[-1] for i in [int(np.searchsorted(stops, p, side="right"))]]
    assert sorted((r["p"], r["chrom"], r["pos"]) for r in out.collect()) == want


# --- ranges


@pytest.mark.parametrize("size", [1, 2, 8, 48])
def test_thinning_of_dense_anchors(spark, size):
    rng = random.Random(size)
    points = {(c, x) for c, n in (("a", 4000), ("b", 300)) for x in rng.sample(range(n + 1000), n)} | {("c", 5)}
    df = spark.createDataFrame(sorted(points), "k string, x long").repartition(7)
    want = []
    for c in "abc":
        last = None
        for x in sorted(x for k, x in points if k == c):
            if last is None or x - size // 2 > last:
                want.append((c, x))
                last = x
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(map(tuple, cluster.thin_anchors(df, size, ["k"]).collect())) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert cluster.thin_anchors(df.limit(0), size, ["k"]).count() == 0


def test_running_values_and_merged_variations_over_ranges(spark):
    rng = random.Random(6)
    rows = [(k, i, rng.choice([None, rng.randrange(100)])) for k in "ab" for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = ranges.dealt(df, ["k"], [F.col("i")])
        assert placed.select("_range").distinct().count() > 2
        out = ranges.carried(placed, ["k"], [F.col("i")], "most", F.col("v"), F.max, F.greatest, inclusive=False)
        out = ranges.carried(out, ["k"], [F.col("i")], "sum", F.col("v"), F.sum, ranges.total).orderBy("k", "i").collect()
        sums = [(k, p, rng.randrange(1, 4000)) for k in "ab" for p in range(0, 500_000, 1000)]
        merged = calls.merge_vcf(spark.createDataFrame(sums, "chrom string, pos long, sv_len long"), 10, 600).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k in "ab":
        most = total = None
        for r, (_, _, v) in zip([r for r in out if r["k"] == k], [x for x in rows if x[0] == k], strict=True):
            assert r["most"] == most
            if v is not None:
                most, total = max(v, most or 0), v + (total or 0)
            assert r["sum"] == total
    want = []
    for k in "ab":
        start = reach = None
        for _, p, n in (x for x in sums if x[0] == k):
            if reach is None or reach + 10 < p:
                want += [(k, start, reach, reach - start)] if reach is not None else []
                start, reach = p, p + n
            reach = max(reach, p + n)
        want.append((k, start, reach, reach - start))
    assert sorted(map(tuple, merged)) == sorted(w for w in want if w[3] > 600)
    assert "partitionBy" not in "".join(x for x in plan_of(calls.merge_vcf(spark.createDataFrame(sums, "chrom string, pos long, sv_len long"))).splitlines() if "hashpartitioning(chrom#" in x and "_range" not in x and "cluster" not in x)


# --- curves


def plain_lowess(x, y, frac):
    n = len(x)
    k = min(n, max(2, int(np.ceil(frac * n))))
    out = []
    for i in range(n):
        near = sorted(range(n), key=lambda j: (abs(x[j] - x[i]), x[j]))[:k]
        d = np.abs(x[near] - x[i])
        w = np.sqrt((1 - np.minimum(d / max(d.max(), 1e-12), 1) ** 3) ** 3 + 1e-12)
        design = np.c_[np.ones(k), x[near] - x[i]] * w[:, None]
        out.append(np.linalg.lstsq(design, y[near] * w, rcond=None)[0][0])
    return np.array(out)


def test_smoothing_is_the_plain_one_and_fast():
    rng = np.random.default_rng(7)
    x = np.log(np.arange(400) + 1.0)
    y = -x + rng.normal(size=400) / 10
    assert np.allclose(expected.lowess(x, y, 0.1), plain_lowess(x, y, 0.1), atol=1e-7)
    x = np.log(np.arange(5000) + 1.0)
    y = -x + rng.normal(size=5000) / 10
    whole = expected.lowess(x, y, 0.3, fits=10**9)
    assert np.abs(expected.lowess(x, y, 0.3, fits=64) - whole).max() < 0.002 * np.ptp(y)  # the stated error
    x = np.log(np.arange(250_000) + 1.0)
    began = time.time()
    for frac in (0.01, 0.1):
        expected.lowess(x, -x, frac)
    assert time.time() - began < 60


def test_expected_curve_as_a_whole(spark):
    """Cut at the first bad value, smoothed, and never rising, against plain Python from the table on."""
    rng = np.random.default_rng(8)
    rows = [(s, d, int(n), float(n * np.exp(4 - np.log(d + 1) + rng.normal() / 5)) if not (s == "b" and d == 150) else 0.0) for s in "ab" for d in range(200) for n in rng.integers(1, 50, 2)]
    df = spark.createDataFrame(rows, "sample string, dist long, n_valid long, balanced_sum double").repartition(4)
    got = jobs.expected_curve(df, ["sample"], head=10, near=60, near_frac=0.1, far_frac=0.3).collect()
    for s in "ab":
        y = []
        for d in range(200):
            mine = [(n, v) for a, b, n, v in rows if (a, b) == (s, d)]
            avg = sum(v for _, v in mine) / sum(n for n, _ in mine)
            if avg <= 0:
                break
            y.append(np.log(avg))
        y, x = np.array(y), np.log(np.arange(len(y)) + 1.0)
        near, far = (plain_lowess(x[10:], y[10:], f) for f in (0.1, 0.3))
        smooth = np.minimum.accumulate(np.r_[y[:10], near[:50], far[50:]])
        found = [r["smooth"] for r in sorted((r for r in got if r["sample"] == s), key=lambda r: r["dist"])]
        assert len(found) == len(smooth) == (200 if s == "a" else 150) and np.allclose(found, smooth, atol=1e-6)


# --- FASTA


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_across_splits(spark, tmp_path, end):
    rng = random.Random(9)
    want = []
    for f in range(3):
        parts = [f"; a note{end}"] if f == 1 else []
        for i in range(12):
            n = rng.choice([0, 1, 60, 3000, 20_000])
            seq = "".join(rng.choice("ACGTN") for _ in range(n))
            want.append((f"r{f}_{i}", n))
            parts.append(f">r{f}_{i} some words{end}" + "".join(seq[k : k + 60] + end for k in range(0, n, 60)) + (end if i % 5 == 0 else ""))
        (tmp_path / f"{f}.fa").write_bytes("".join(parts).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        got = readers.read_fasta_lengths(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() >= 1 and sorted(map(tuple, got.collect())) == sorted(want)
        assert sorted(map(tuple, readers.read_fasta_lengths(spark, str(tmp_path), ["r0_3", "r2_1"]).collect())) == sorted(w for w in want if w[0] in ("r0_3", "r2_1"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


# --- one-to-one


def largest_matching(a, b, tol):
    """By augmenting paths."""
    taken = {}

    def place(i, seen):
        for j in range(len(b)):
            if abs(a[i] - b[j]) <= tol and j not in seen:
                seen.add(j)
                if j not in taken or place(taken[j], seen):
                    taken[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(a)))


@pytest.mark.parametrize("tol", [0, 1, 3])
def test_one_to_one_is_a_largest_matching(spark, tol):
    rng = random.Random(tol)
    r = [(i, rng.randrange(120), rng.randrange(40)) for i in range(60)]
    a = [(rng.choice([None, rng.randrange(120)]), rng.randrange(40)) for _ in range(45)]
    results, answers = spark.createDataFrame(r, "result_id long, bp_1 long, bp_2 long").repartition(3), spark.createDataFrame(a, "bp_1 long, bp_2 long")
    for crossed in (False, True):
        got = evaluate.matched_one_to_one(results, answers, tol, crossed)
        rows = got.collect()
        assert len(rows) == 60
        first, second = ([y for _, y in a], [x for x, _ in a if x is not None]) if crossed else ([x for x, _ in a if x is not None], [y for _, y in a])
        assert sum(x["found_x"] for x in rows) == largest_matching([x for _, x, _ in r], first, tol)
        assert sum(x["found_y"] for x in rows) == largest_matching([y for _, _, y in r], second, tol)
        assert evaluate.call_scores(got, answers).first()["recall"] <= 1


def test_one_to_one_sweeps_positions_and_not_rows(spark):
    """Very many results on few neighbouring positions are one run, which no task of Python may get as a whole: it gets a row a position."""
    spots = spark.range(20_000).select(F.col("id").alias("result_id"), (F.col("id") % 50).alias("bp_1"), (F.col("id") % 50).alias("bp_2"))
    found = evaluate.matched_one_to_one(spots, spots.where("result_id % 2 = 0"), 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and plan.count("MapInArrow") == 2
    assert found.agg(F.count_if("found_x"), F.count_if("found_y"), F.count("*")).first()[:] == (10_000, 10_000, 20_000)


# --- networks


def test_network_of_full_size_is_broadcast_once(spark):
    """Ten blocks over 48 bins, 23,040 x 1,024 x 256 x 1 dense weights, in single precision, against double precision and, for some places, loops."""
    rng = np.random.default_rng(10)
    conv = lambda o, c: ("conv", rng.normal(size=(o, c, 3, 3)) / np.sqrt(9 * c), rng.normal(size=o) / 10)
    norm = lambda o: ("norm", 1 + rng.normal(size=o) / 10, rng.normal(size=o) / 10)
    blocks_ = [[layer for o, c in ((16, 1), (32, 16), (64, 32)) for layer in (conv(o, c), norm(o), ("relu",), ("pool",))] for _ in range(10)]
    sizes = (23_040, 1024, 256, 1)
    dense = [(rng.normal(size=(b, a)).astype("f4") / np.sqrt(a), np.zeros(b)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
    single = scoring.ConvScorer(blocks_, dense, "f4")
    assert 90e6 < single.nbytes < 110e6
    x = rng.normal(size=(6, 48, 48))
    double = scoring.ConvScorer(blocks_, dense)
    want = double(x)
    assert np.allclose(single(x), want, atol=1e-5) and np.ptp(want) > 1e-4
    y, (_, w, b) = double.layer(x[:2, None], *double.blocks[3][0]), double.blocks[3][0]
    p = np.pad(x[:2], ((0, 0), (1, 1), (1, 1)))
    for n, o, i, j in ((0, 0, 0, 0), (1, 5, 47, 3), (0, 15, 20, 47)):
        assert y[n, o, i, j] == pytest.approx(sum(p[n, i + u, j + v] * w[o, 0, u, v] for u in range(3) for v in range(3)) + b[o])
    shared = single.shared(spark)
    df = spark.createDataFrame([(k, r.reshape(-1).tolist()) for k, r in enumerate(x)], "k long, values array<double>").repartition(3)
    for _ in range(2):  # two jobs, one broadcast
        got = {r["k"]: r["score"] for r in scoring.score_patches(df, shared, 48).collect()}
        assert np.allclose([got[k] for k in range(6)], want, atol=1e-5)
    assert shared.held.value.nbytes == single.nbytes


# --- the map store


def test_store_pairs_without_a_shuffle_and_reads_few_row_groups(spark, tmp_path):
    rng = random.Random(12)
    cells = {(s, rng.randrange(2), a, a + rng.randrange(300)) for s in ("test", "clean") for a in range(4000) for _ in range(6)}
    rows = [(s, c, a, c, b, 1 + (a + b) % 7) for s, c, a, b in cells]
    pixels = spark.createDataFrame(rows, "sample string, chrom1_idx int, bin1 long, chrom2_idx int, bin2 long, count long")
    store.write_map_store(pixels, "map_store_test", str(tmp_path / "store"), 4, **{"parquet.block.size": 8192, "parquet.page.size": 1024})
    try:
        table = spark.read.table("map_store_test")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        pairs = maps.pair_samples(table)
        assert "Exchange" not in plan_of(pairs)
        assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, maps.pair_samples(pixels).collect()))
        corners = spark.createDataFrame([(0, 0, 1000, 1100), (1, 1, 3050, 3000)], POINT)
        found = store.read_near(spark, "map_store_test", corners, 48)
        got = {(r["sample"], r["chrom1_idx"], r["bin1"], r["bin2"]) for r in found.collect()}
        wanted = {(s, c, a, b) for s, c, a, b in cells if any(c == k and x <= p < x + 48 and y <= q < y + 48 for k, x, y in ((0, 1000, 1100), (1, 3050, 3000)) for p, q in ((a, b), (b, a)))}
        assert wanted and wanted <= got and len(got) < len(cells) / 10
        assert "PushedFilters" in plan_of(found) and "In(tile_at" in plan_of(found)
        one = store.read_near(spark, "map_store_test", corners.where("x = 1000"), 48)
        asked = [(r["chrom1_idx"], r["tile_at"]) for r in one.select("chrom1_idx", "tile_at").distinct().collect()]
        groups = read = 0  # row groups whose ranges meet what is asked for
        for f in (tmp_path / "store").rglob("*.parquet"):
            meta = pq.ParquetFile(f).metadata
            at = {meta.schema.column(k).name: k for k in range(meta.num_columns)}
            for k in range(meta.num_row_groups):
                chrom, tile = (meta.row_group(k).column(at[c]).statistics for c in ("chrom1_idx", "tile_at"))
                groups += 1
                read += any(chrom.min <= c <= chrom.max and tile.min <= t <= tile.max for c, t in asked)
        assert groups >= 32 and read <= groups / 2, (groups, read)
        many = spark.range(3000).select(F.lit(0).alias("chrom1_idx"), F.lit(0).alias("chrom2_idx"), (F.col("id") * 200).alias("x"), (F.col("id") * 200).alias("y"))
        whole = store.read_near(spark, "map_store_test", many, 48)
        assert whole.count() >= sum(c == 0 for _, c, _, _ in cells)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table if exists map_store_test")


def test_z_order(spark):
    pairs = [(random.Random(i).randrange(1 << 31), random.Random(-i).randrange(1 << 31)) for i in range(1, 60)] + [(0, 0), (1, 0), (0, 1)]
    for r in spark.createDataFrame(pairs, "a long, b long").withColumn("z", store.z_order(F.col("a"), F.col("b"))).collect():
        assert r["z"] == sum((r["a"] >> k & 1) << 2 * k | (r["b"] >> k & 1) << 2 * k + 1 for k in range(31))


def test_grid_points_are_not_broadcast(spark, monkeypatch):
    """Spark takes the exploded points for as short as the fingerprints; at 0.6 GB they were broadcast and the driver's memory did not do."""
    from contactspark.llm import simhash

    plans, kept = [], simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, name: plans.append(df) or kept(df, name))
    pairs = simhash.links(kept(spark.range(500).select(F.xxhash64("id").alias("fp")), "prints"))
    for df in (*plans, pairs):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_windows_of_few_chromosomes_and_boxes_are_dealt_out(spark):
    """Short tables that grow: no task makes most of the windows of a chromosome or of a box."""
    sizes = spark.createDataFrame([(0, "a", 400_000)], "chrom_idx int, chrom string, length long")
    box = spark.createDataFrame([("a", 0, 0, 100, 100)], "box_id string, x0 long, y0 long, width long, height long")
    for df in (windows.full_map_windows(sizes, 1000, 8, 4), windows.box_windows(box, 8)):
        tasks = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert len(tasks) > 1 and max(tasks) < 0.6 * sum(tasks)


def test_training_patches_go_by_blocks(spark):
    """A window is shuffled once and a cell four times at most: no cells are gathered by window. Values are those of plain loops."""
    rng = np.random.default_rng(5)
    a = np.triu(np.where(rng.random((60, 60)) < 0.6, 0, rng.integers(1, 50, (60, 60))))
    rows = [(s, 0, i, 0, j, int(a[i, j]) + (s == "clean")) for i in range(60) for j in range(i, 60) if a[i, j] for s in ("test", "clean")]
    cells = spark.createDataFrame(rows, "sample string, chrom1_idx int, bin1 long, chrom2_idx int, bin2 long, count long")
    sizes = spark.createDataFrame([(0, "a", 59_999)], "chrom_idx int, chrom string, length long")
    w = spark.createDataFrame([(k, 1, 0, 0, int(x), int(y)) for k, (x, y) in enumerate(rng.integers(4, 56, (40, 2)))] + [(40, 1, 0, 0, None, None)], "k int, label_idx int, chrom1_idx int, chrom2_idx int, x long, y long")
    out = jobs.training_patches(w, cells, sizes, 1000, 8, ("k",))
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    v = np.where(a > 0, np.log10(np.maximum(a, 1)) - np.log10(a + 1) + 1e-6, 0.0)
    lo, hi = v.min(), max(v.max(), 0.0)
    v = 2 * (v + np.triu(v, 1).T - lo) / (hi - lo) - 1
    got, at = {r["k"]: r["values"] for r in out.collect()}, {r["k"]: (r["x"], r["y"]) for r in w.collect()}
    assert len(got) == 41 and np.allclose(got[40], 2 * (0 - lo) / (hi - lo) - 1)
    assert all(np.allclose(got[k], v[x - 4 : x + 4, y - 4 : y + 4].ravel()) for k, (x, y) in at.items() if k < 40)
