"""Jobs made of the operators: detection, training samples, evaluation, and the conversion of call lists.

Detections stay in chromosome bins (chrom1_idx, chrom2_idx, x, y) from stage to stage; genome positions
are made at the end. `stored` writes a stage's detections and reads them back, which cuts the lineage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import coords, values
from ..functions.common import bounded, floor_div, scratch
from ..operators import blocks, calls, cluster, evaluate, expected, maps, normalize, sampling, scoring, windows
from ..sources.readers import read_wide_calls
from ..sources.writers import read_stage, write_calls, write_stage

Scorer = Callable[[np.ndarray], np.ndarray]
Measure = Callable[[np.ndarray], dict[str, np.ndarray]]
POINT = ["chrom1_idx", "chrom2_idx", "x", "y"]


def attach_labels(refined: DataFrame, classified: DataFrame, key: str = "det_id") -> DataFrame:
    """Refined detections with their class label; detections without a class keep a null."""
    return refined.join(classified.select(key, "label"), key, "left")


def stored(df: DataFrame, path: str | None, stage: str) -> DataFrame:
    """df, written as a stage and read back if there is a path."""
    if not path:
        return df
    write_stage(df, path, stage)
    return read_stage(df.sparkSession, path, stage).select(df.columns)


def genome_cells(pixels: DataFrame, chromsizes: DataFrame, res: int) -> DataFrame:
    """Counts by genome bins g1 <= g2; two cells may fall on one pair of genome bins."""
    c = coords.chrom_to_genome_pair(pixels, chromsizes, res, "bin1", "bin2")
    return c.groupBy("sample", F.least("genome_x", "genome_y").alias("g1"), F.greatest("genome_x", "genome_y").alias("g2")).agg(F.sum("count").alias("count"))


def scored_windows(cut: DataFrame, n: int, size: int, step: int, scorer: Scorer) -> DataFrame:
    """(window, start, score) of each window on the diagonal, scaled by itself and scored densely; windows without cells are patches of zeros."""
    keys = ("window", "start")
    dense = scoring.densify(cut, size, keys)
    lo, hi = F.array_min("values"), F.array_max("values")
    dense = dense.withColumns({"lo": lo, "hi": hi}).withColumn("values", F.transform("values", lambda v: F.coalesce(2 * F.try_divide(v - F.col("lo"), F.col("hi") - F.col("lo")) - 1, F.lit(0.0))))
    found = scoring.score_patches(dense.select(*keys, "values"), scorer, size).select(*keys, "score")
    every = cut.sparkSession.range(max(0, n // step) if n >= size else 0).select(F.col("id").alias("window"), F.least(F.col("id") * step, F.lit(n - size)).alias("start"))
    return every.join(found, list(keys), "left").select(*keys, F.coalesce("score", F.lit(of_zeros(scorer, size))).alias("score"))


def of_zeros(scorer: Scorer, size: int) -> float:
    """The score of a patch of zeros, as windows without cells have it."""
    return float(np.asarray(scorer(np.zeros((1, size, size)))).reshape(-1)[0])


def scan_diagonal(pixels: DataFrame, chromsizes: DataFrame, res: int, size: int = 48, step: int = 24, centre: int = 4, scorer: Scorer | None = None, ratio: str = "masked") -> DataFrame:
    """Windows along the diagonal of the whole genome, scored on the two samples' log-ratio, each scaled by itself:
    window, chrom_idx, local_bin (of the window's centre) and score above a half.

    scorer takes dense patches; without one the plain contrast is worked out from the stored cells. ratio: masked or pseudo.
    Cells farther from the diagonal than a window go before the samples are joined.
    """
    near = genome_cells(pixels, chromsizes, res).where(F.col("g2") - F.col("g1") < size)
    side = lambda s, c: near.where(F.col("sample") == s).select("g1", "g2", F.col("count").alias(c))
    both = side("test", "a").join(side("clean", "b"), ["g1", "g2"], "inner" if ratio == "masked" else "full")
    both = both.withColumn("value", (values.log_ratio_masked if ratio == "masked" else values.log_ratio_pseudo)(F.col("a"), F.col("b")))
    n = sampling.genome_length(chromsizes) // res
    cut = windows.diagonal_windows(both, n, size, step, "g1", "g2").select("window", "start", (F.col("g1") - F.col("start")).alias("dx"), (F.col("g2") - F.col("start")).alias("dy"), "value")
    cut = cut.union(cut.where("dx <> dy").select("window", "start", "dy", "dx", "value"))
    scored = scored_windows(cut, n, size, step, scorer) if scorer else scoring.contrast_of_windows(cut, size, centre, ("window", "start"))
    scored = scored.where(values.threshold(F.col("score")))
    return coords.genome_to_chrom(scored.withColumn("x", F.col("start") + size // 2), chromsizes, "x", res).select("window", "chrom_idx", "local_bin", "score")


def scan_resolutions(pixels: dict[int, DataFrame], chromsizes: DataFrame, size: int = 48, centre: int = 4, scorer: Scorer | None = None, ratio: str = "masked") -> DataFrame:
    """scan_diagonal of each resolution's map, a quarter of a window at a time: resolution, window, chrom_idx, local_bin, score."""
    scans = [scan_diagonal(p, chromsizes, res, size, size // 4, centre, scorer, ratio).select(F.lit(res).alias("resolution"), "*") for res, p in pixels.items()]
    return functools.reduce(DataFrame.unionByName, scans)


def log_cells(pixels: DataFrame, base: float) -> DataFrame:
    """The test sample's cells in both triangles, value the logarithm of the count."""
    test = maps.symmetric(pixels.where("sample = 'test'"))
    return test.withColumn("value", values.log_value(F.col("count"), base))


def ratio_cells(pixels: DataFrame, chromsizes: DataFrame, res: int, points: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Log-ratios of the samples (both triangles, value) near the windows around points, and the extremes (lo, hi) over each pair of chromosomes, in both
    orders. Only the extremes pair the samples' whole maps."""
    n = bounded(chromsizes.select("chrom_idx", F.expr(f"length div {res} + 1").alias("n")))
    ratio = lambda p: maps.pair_samples(p).select(*maps.CELL, values.log_ratio_masked(F.col("a"), F.col("b")).alias("value"))
    return maps.symmetric(ratio(near_points(pixels, points, size))), pair_ends(ratio(pixels), n)


def near_points(pixels: DataFrame, points: DataFrame, size: int) -> DataFrame:
    """The pixels that windows around points may hold."""
    return blocks.near(pixels, windows.centre_to_corner(points, size), size)


def pair_ends(v: DataFrame, n: DataFrame) -> DataFrame:
    """chrom1_idx, chrom2_idx, lo, hi of a table of upper triangles; each pair of chromosomes has n1 * n2 cells. In both orders."""
    sized = v
    for k in ("1", "2"):
        sized = sized.join(n.select(F.col("chrom_idx").alias(f"chrom{k}_idx"), F.col("n").alias(f"n{k}")), f"chrom{k}_idx")
    ends = bounded(normalize.block_ends(sized.withColumn("cells", F.col("n1") * F.col("n2")), ["chrom1_idx", "chrom2_idx"], "cells"))
    return ends.union(ends.where("chrom1_idx <> chrom2_idx").select("chrom2_idx", "chrom1_idx", "lo", "hi"))


def scaled(patches: DataFrame, ends: DataFrame) -> DataFrame:
    """patches (chrom1_idx, chrom2_idx, values) with the values scaled to -1..1 by their pair's extremes; 0 in constant pairs."""
    up = lambda v: F.coalesce(2 * F.try_divide(v - F.col("lo"), F.col("hi") - F.col("lo")) - 1, F.lit(0.0))
    return patches.join(bounded(ends), ["chrom1_idx", "chrom2_idx"], "left").withColumn("values", F.transform("values", up)).select(patches.columns)


def score_points(cells: DataFrame, points: DataFrame, size: int, scorer: Scorer, blur: bool = True, ends: DataFrame | None = None, inside: tuple[DataFrame, int] | None = None) -> DataFrame:
    """The distinct points with the score of the window around each.

    ends: extremes by pair of chromosomes, by which patches are scaled before they are scored. A window without cells counts as a patch of
    zeros, scaled as the others; inside (chromsizes, res): one that crosses a map's end is a patch of unscaled zeros. Windows are scored in blocks of
    the map, so those that overlap share their cells; what blocks without cells score is worked out once.
    """
    points = points.select(*POINT).distinct()
    points = windows.mark_inside(points, *inside[:1], size, inside[1]) if inside else points.withColumn("inside", F.lit(True))
    fn = (lambda s: scorer(scoring.blur3(s))) if blur else scorer
    found = blocks.score_corners(cells, windows.centre_to_corner(points.where("inside"), size).select(*POINT), size, fn, ends)
    found = found.withColumns({"x": F.col("x") + size // 2, "y": F.col("y") + size // 2})
    out, zero = points.join(found, POINT, "left"), F.lit(of_zeros(fn, size))
    if ends is None:
        return out.select(*POINT, F.coalesce("score", zero).alias("score"))
    pairs = ends.select("chrom1_idx", "chrom2_idx", F.array_repeat(F.lit(0.0), size * size).alias("values"))
    blank = scoring.score_patches(scaled(pairs, ends), fn, size).select("chrom1_idx", "chrom2_idx", F.col("score").alias("blank"))
    out = out.join(bounded(blank), ["chrom1_idx", "chrom2_idx"], "left")
    return out.select(*POINT, F.coalesce("score", F.when(F.col("inside"), F.col("blank")), zero).alias("score"))


def detect_svs(
    pixels: dict[int, DataFrame], chromsizes: DataFrame, scorer: Scorer, classifier: Scorer, size: int = 48, class_size: int = 24, resolutions: tuple[int, int, int] = (50_000, 10_000, 5_000),
    fine: int | None = None, cutoff: float = 0.95, stage_path: str | None = None,
) -> DataFrame:
    """bp_1, bp_2, label of structural variations, from coarse to fine.

    pixels: by resolution, with both samples. scorer gives a number for each patch, classifier five. Stages: scan of
    the diagonal, thinned anchors, pairs of anchors at the coarse resolution, refinement, chains into boxes, windows of each
    box, refinement, the largest count of each box, class, and recentring on a finer map if there is one.
    """
    coarse, middle, small = resolutions
    ratio = coarse // middle
    stage_path = stage_path or scratch(chromsizes.sparkSession, "detect")  # stages serve more than once
    anchors = scan_diagonal(pixels[middle], chromsizes, middle, size, size // 2, scorer=scorer).select("chrom_idx", F.col("local_bin").alias("x"))
    anchors = stored(cluster.thin_anchors(anchors, size, ["chrom_idx"]), stage_path, "anchors")
    pairs = windows.cross_anchors(anchors, size).withColumns({"x": floor_div(F.col("x"), ratio), "y": floor_div(F.col("y"), ratio)}).distinct()
    pairs = stored(pairs, stage_path, "candidates")
    ratios, ends = ratio_cells(pixels[coarse], chromsizes, coarse, pairs, size)
    found = score_points(ratios, pairs, size, scorer, ends=ends, inside=(chromsizes, coarse)).where(values.threshold(F.col("score"))).select(*POINT)
    found = stored(found, stage_path, "pairs")

    fine_cells = lambda at: log_cells(near_points(pixels[small], at, size), 10)
    grid = stored(windows.filter_inside(windows.refine_grid(found, size, coarse, size, small), chromsizes, size, small), stage_path, "grid")
    refined = score_points(fine_cells(grid), grid, size, scorer).where(values.threshold(F.col("score"))).select(*POINT)
    refined = stored(refined, stage_path, "refined")

    half = middle // small
    points = refined.withColumns({"x": floor_div(F.col("x"), half), "y": floor_div(F.col("y"), half)}).distinct()
    keys = ["chrom1_idx", "chrom2_idx"]
    boxes = cluster.chain_groups(points, size, keys).withColumn("box_id", F.struct(*keys, "chain"))
    inner = windows.box_windows(boxes, size).select("box_id.chrom1_idx", "box_id.chrom2_idx", F.col("cx").alias("x"), F.col("cy").alias("y"))
    inner = stored(inner.distinct(), stage_path, "inner")
    sure = score_points(log_cells(near_points(pixels[middle], inner, size), 10), inner, size, scorer).where(values.threshold(F.col("score"), "cutoff", cutoff)).select(*POINT)
    grid = stored(windows.filter_inside(windows.refine_grid(sure, size, middle, size, small), chromsizes, size, small), stage_path, "last_grid")
    last = score_points(fine_cells(grid), grid, size, scorer).where(values.threshold(F.col("score"))).select(*POINT)
    last = stored(last, stage_path, "boxes")

    boxes = cluster.chain_groups(last, class_size, keys).withColumn("box_id", F.struct(*keys, "chain"))
    raw = maps.symmetric(pixels[small].where("sample = 'test'")).withColumn("value", F.col("count").cast("double"))
    held = windows.box_cells(raw, boxes).join(boxes.select("box_id", "x0", "y0"), "box_id")
    best = cluster.patch_argmax(held.select("box_id", (F.col("bin1") - F.col("x0")).alias("dx"), (F.col("bin2") - F.col("y0")).alias("dy"), "value"), ["box_id"])
    det = best.join(boxes.select("box_id", "x0", "y0"), "box_id").select("box_id.chrom1_idx", "box_id.chrom2_idx", (F.col("x0") + F.col("dx")).alias("x"), (F.col("y0") + F.col("dy")).alias("y")).distinct()
    if refined.isEmpty():  # then the coarse detections are classified as they are
        up = coarse // small
        det = found.withColumns({"x": F.col("x") * up, "y": F.col("y") * up})
    det = stored(det.withColumn("det_id", F.xxhash64(*POINT)), stage_path, "best")

    at = det.select("det_id", "chrom1_idx", "chrom2_idx", floor_div(F.col("x"), half).alias("x"), floor_div(F.col("y"), half).alias("y"))
    held = log_cells(near_points(pixels[middle], at, class_size), 2)
    cut = windows.cut_windows(held, windows.centre_to_corner(windows.filter_margin(at, class_size), class_size), class_size, keep=("det_id",))
    classes = scoring.classify_patches(scoring.densify(cut, class_size, ("det_id",)), lambda s: classifier(scoring.blur3(s)), class_size)
    res = small
    if fine:
        res, k, wide = fine, small // fine, 120
        det = det.withColumns({"x": F.col("x") * k, "y": F.col("y") * k})
        raw = maps.symmetric(near_points(pixels[fine].where("sample = 'test'"), det, wide)).withColumn("value", F.col("count").cast("double"))
        moves = cluster.recentre(windows.cut_windows(raw, windows.centre_to_corner(det, wide), wide, keep=("det_id",)), wide, ["det_id"])
        det = det.join(moves, "det_id", "left").withColumns({"x": F.col("x") + F.coalesce("move_x", F.lit(0)), "y": F.col("y") + F.coalesce("move_y", F.lit(0))})
    o = coords.chrom_offsets(chromsizes).select("chrom_idx", "start")
    for k, c in (("1", "x"), ("2", "y")):
        det = det.join(bounded(o.select(F.col("chrom_idx").alias(f"chrom{k}_idx"), F.col("start").alias(f"o{k}"))), f"chrom{k}_idx").withColumn(f"bp_{k}", F.col(c) * res + F.col(f"o{k}"))
    return attach_labels(det, classes).select("bp_1", "bp_2", "label")


NORMS = ("masked", "pseudo", "balanced", "raw_log", "log10_only", "exp/obs", "expected")


def training_cells(pixels: DataFrame, chromsizes: DataFrame, res: int, norm: str = "masked", bins: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The upper triangle's cells with a normalised value, and the extremes to scale patches by, if this kind is scaled.

    masked, pseudo and balanced are log-ratios of test and clean, scaled over each pair of chromosomes; balanced takes the weights of bins.
    raw_log is the log-ratio as it is, log10_only the test sample's logarithm, exp/obs its diagonal's mean over the count, expected the
    logarithm of the count over its diagonal's mean. The last two hold cells within chromosomes only. Other names are an error.
    """
    if norm not in NORMS:
        raise ValueError(f"norm is {norm}, not one of {', '.join(NORMS)}")
    test = pixels.where("sample = 'test'")
    if norm == "log10_only":
        return test.select(*maps.CELL, values.log_value(F.col("count"), 10).alias("value")), None
    if norm == "raw_log":
        return calls.call_log_ratios(maps.pair_samples(pixels)).select(*maps.CELL, "value"), None
    if norm in ("exp/obs", "expected"):
        n = chromsizes.select("chrom_idx", F.expr(f"length div {res} + 1").alias("n"))
        met = normalize.observed_expected(test, normalize.diagonal_expected(test, n))
        if norm == "exp/obs":
            return met.select(*maps.CELL, F.coalesce("ratio", F.lit(0.0)).alias("value")), None
        eps = bounded(met.groupBy("chrom1_idx").agg(F.min("expected").alias("eps")))
        logs = normalize.normalise_by_expected(met.join(eps, "chrom1_idx").withColumn("value", F.col("count").cast("double")), norm="expected")
        return logs.select(*maps.CELL, F.col("normalised").alias("value")), None
    if norm == "balanced":
        if bins is None:
            raise ValueError("norm is balanced, so bins with weights are needed")
        weighed = maps.apply_balance(pixels, bins)
        side = lambda s, c: weighed.where(F.col("sample") == s).select(*maps.CELL, F.col("value").alias(c), F.col("value").isNull().alias(f"{c}_masked"))
        pairs = side("test", "a").join(side("clean", "b"), maps.CELL, "full")
        masked = lambda c: F.coalesce(f"{c}_masked", F.lit(False))
        v = pairs.withColumn("value", values.log_ratio_balanced(F.col("a"), masked("a"), F.col("b"), masked("b")))
    elif norm == "pseudo":
        v = maps.pair_samples(pixels, how="full").withColumn("value", values.log_ratio_pseudo(F.col("a"), F.col("b")))
    else:
        v = maps.pair_samples(pixels).withColumn("value", values.log_ratio_masked(F.col("a"), F.col("b")))
    v = v.select(*maps.CELL, "value")
    return v, pair_ends(v, bounded(chromsizes.select("chrom_idx", F.expr(f"length div {res} + 1").alias("n"))))


def training_windows(calls_: DataFrame, chromsizes: DataFrame, res: int, size: int, kind: str = "diagonal", by: tuple[str, ...] = ()) -> DataFrame:
    """Window centres (chrom1_idx, chrom2_idx, x, y) of calls and as many negatives: by, call_id, is_sv, which, label_idx. Clamped to the map."""
    pad = size // 2
    named = calls_.select(*by, "call_id", "chrom_idx", "start", "end", "label")
    both = sampling.union_samples(named, sampling.negatives_per_call(calls_, chromsizes, size, res, keep=by))
    n = bounded(chromsizes.select("chrom_idx", F.expr(f"length div {res} + 1").alias("n")))
    centres = windows.endpoint_windows(both, kind).withColumns({"x": floor_div(F.col("x"), res), "y": floor_div(F.col("y"), res)})
    centres = sampling.jitter(centres, pad // 2).join(n, "chrom_idx").withColumn("p", windows.clamp_to_map(F.col("x"), F.col("y"), pad, F.col("n")))
    return centres.select(*by, "call_id", "is_sv", "which", values.label_to_index(F.col("label")).alias("label_idx"), F.col("chrom_idx").alias("chrom1_idx"), F.col("chrom_idx").alias("chrom2_idx"), "p.x", "p.y")


#: Kinds of values that need no more of a map than the cells themselves.
LOCAL_NORMS = ("masked", "pseudo", "balanced", "raw_log", "log10_only")


def training_patches(w: DataFrame, pixels: DataFrame, chromsizes: DataFrame, res: int, size: int, keys: tuple[str, ...], norm: str = "masked", bins: DataFrame | None = None, blur: bool = False, measure: Measure | None = None) -> DataFrame:
    """keys, label_idx and values (or what measure makes of them, see blocks.patches) of the windows around w (keys, label_idx, chrom1_idx, chrom2_idx, x, y). Cells that no window holds go before the samples
    are paired, but for what is taken over whole maps: extremes, and means of diagonals."""
    cells, ends = training_cells(pixels, chromsizes, res, norm, bins)
    corners = windows.centre_to_corner(w, size)
    if norm in LOCAL_NORMS:
        cells, _ = training_cells(blocks.near(pixels, corners, size), chromsizes, res, norm, bins)
    if measure and blur:
        plain = measure
        measure = lambda v: plain(scoring.blur3(v.reshape(-1, size, size)).reshape(len(v), -1))
    patches = blocks.patches(maps.symmetric(cells), corners, size, (*keys, "label_idx"), ends, measure)
    return scoring.gaussian_blur3(patches, size).drop("values").withColumnRenamed("blurred", "values") if blur and not measure else patches


def build_training_set(
    calls_: DataFrame, pixels: DataFrame, chromsizes: DataFrame, res: int, size: int, kind: str = "diagonal", norm: str = "masked", bins: DataFrame | None = None, blur: bool = False, measure: Measure | None = None
) -> DataFrame:
    """Patches around calls and as many negatives: call_id, is_sv, which, label_idx, values. Windows are clamped to the map; one without cells is
    a patch of zeros. norm, bins: see training_cells; measure: see training_patches."""
    w = training_windows(calls_, chromsizes, res, size, kind)
    return training_patches(w, pixels, chromsizes, res, size, ("call_id", "is_sv", "which"), norm, bins, blur, measure)


SET = ["sample_id", "clean_id", "truth_id", "split"]


def build_training_sets(
    manifest: DataFrame, pixels: DataFrame, truth: DataFrame, chromsizes: DataFrame, res: int, size: int, kind: str = "diagonal", norm: str = "masked", bins: DataFrame | None = None, blur: bool = False
) -> DataFrame:
    """The training sets of all rows of a manifest (sample_id, clean_id, truth_id, split) in one plan: these and build_training_set's columns.

    pixels hold all samples, truth all calls, by truth_id. Each pair of a sample and its clean one is a genome of its own: its number is part of
    the chromosomes' indices, so maps, extremes and windows of different pairs never meet, and there is no loop over rows. Repeated rows of the manifest count once.
    """
    k = (chromsizes.agg(F.max("chrom_idx")).first()[0] or 0) + 1
    sets = manifest.select(*SET).distinct()
    pairs = sets.select("sample_id", "clean_id").distinct()
    pairs = bounded(pairs.withColumn("pair", F.row_number().over(Window.orderBy("sample_id", "clean_id")).cast("long")))
    of = lambda c: (F.col("pair") * k + F.col(c)).alias(c)
    counted = [c for c in pixels.columns if c not in ("sample", "chrom1_idx", "chrom2_idx")]
    sides = [pixels.join(pairs, F.col("sample") == F.col(side)).select(F.lit(name).alias("sample"), of("chrom1_idx"), of("chrom2_idx"), *counted) for side, name in (("sample_id", "test"), ("clean_id", "clean"))]
    sizes = chromsizes.crossJoin(pairs.select("pair"))  # two short lists
    sizes = sizes.select(*(of(c) if c == "chrom_idx" else c for c in chromsizes.columns))
    weights = bins.crossJoin(pairs.select("pair")).select(*(of(c) if c == "chrom_idx" else c for c in bins.columns)) if bins is not None else None
    w = training_windows(truth, chromsizes, res, size, kind, by=("truth_id",)).join(bounded(sets), "truth_id").join(pairs, ["sample_id", "clean_id"])
    w = w.withColumns({"chrom1_idx": of("chrom1_idx"), "chrom2_idx": of("chrom2_idx")}).drop("pair")
    return training_patches(w, sides[0].unionByName(sides[1]), sizes, res, size, (*SET, "call_id", "is_sv", "which"), norm, weights, blur)


def write_training_sets(manifest: DataFrame, pixels: DataFrame, truth: DataFrame, chromsizes: DataFrame, res: int, size: int, path: str, **how) -> None:
    """build_training_sets as parquet, partitioned by split and sample_id. The partitions that are written replace those that are there, so a rerun, or a retry
    after a failure, leaves the same rows."""
    sets = build_training_sets(manifest, pixels, truth, chromsizes, res, size, **how)
    sets.repartition("split", "sample_id", "call_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split", "sample_id").parquet(path)


def evaluate_calls(results: DataFrame, answers: DataFrame, chromsizes: DataFrame, res: int, tol: int, least: int = 10_000, crossed: bool = True) -> DataFrame:
    """Precision, recall and F1 of results (bp_1, bp_2) against answers (chrom_idx, start, end)."""
    kept = calls.filter_eval_results(results.select("result_id", "bp_1", "bp_2"), coords.chrom_offsets(chromsizes), least=least)
    once = kept.join(calls.drop_all_duplicates(kept.select("bp_1", "bp_2")), ["bp_1", "bp_2"])
    binned = once.withColumns({"bp_1": floor_div(F.col("bp_1"), res), "bp_2": floor_div(F.col("bp_2"), res)})
    truth = sampling.call_bins(answers, chromsizes, res).select(F.col("x").alias("bp_1"), F.col("y").alias("bp_2"))
    return evaluate.call_scores(evaluate.match_calls(binned, truth, tol, crossed), truth)


def filter_real_svs(svs: DataFrame, pixels: DataFrame, res: int, size: int, block: tuple[int, int], whole: float = 0.2, centre: float = 0.4) -> DataFrame:
    """Calls (call_id, hap, chrom_idx, start, end) long enough and with signal in the patch of the two samples: call_id, chrom, start, end, whole, centre."""
    named = svs.withColumns({"chrom": values.strip_haplotype(F.col("hap")), "start_bin": floor_div(F.col("start"), res), "end_bin": floor_div(F.col("end"), res)})
    kept = calls.filter_span(named)
    at = windows.centre_to_corner(kept.select(F.col("call_id").alias("patch_id"), F.col("chrom_idx").alias("chrom1_idx"), F.col("chrom_idx").alias("chrom2_idx"), F.col("start_bin").alias("x"), F.col("end_bin").alias("y")), size)
    side = lambda s: windows.cut_windows(maps.symmetric(pixels.where(F.col("sample") == s)).withColumn("value", F.col("count")), at, size)
    pairs = side("test").withColumnRenamed("value", "a").join(side("clean").withColumnRenamed("value", "b"), ["patch_id", "dx", "dy"], "full")
    good = calls.filter_signal(pairs, size, block, whole, centre)
    return kept.join(good.withColumnRenamed("patch_id", "call_id"), "call_id").select("call_id", "chrom", "start", "end", "whole", "centre")


def merge_vcf_svs(vcf: DataFrame, bin_size: int = 5000, gap: int = 50_000, least: int = 5000) -> DataFrame:
    return calls.merge_vcf(calls.vcf_bin_sums(vcf, bin_size), gap, least)


def convert_wide_folder(spark: SparkSession, folder: str, out: str) -> None:
    """Foreign callers' tables of a folder, one file or many, as a list of calls within chromosomes."""
    write_calls(calls.convert_wide_calls(read_wide_calls(spark, folder)), out)


def results_to_chrom(results: DataFrame, chromsizes: DataFrame) -> DataFrame:
    return coords.bp_to_chrom_exclusive(results, chromsizes, {"bp_1": ("chrom_x", "coord_x"), "bp_2": ("chrom_y", "coord_y")})


def two_step_scan(pixels: DataFrame, chromsizes: DataFrame, res: int, size: int, dist: int, scorer: Scorer, step: int = 1, stage_path: str | None = None) -> DataFrame:
    """Every diagonal position of each chromosome, then the pairs of those found, then near ones merged: chrom1_idx, chrom2_idx, x, y, members."""
    stage_path = stage_path or scratch(pixels.sparkSession, "two-step")
    spots = chromsizes.where(F.expr(f"length div {res} >= {size}")).withColumn("x", F.explode(F.expr(f"sequence({size // 2}L, length div {res} - {size // 2}, {step}L)")))
    spots = spots.select(F.col("chrom_idx").alias("chrom1_idx"), F.col("chrom_idx").alias("chrom2_idx"), "x", F.col("x").alias("y"))
    first = score_points(log_cells(near_points(pixels, spots, size), 10), spots, size, scorer).where(values.threshold(F.col("score")))
    anchors = stored(first.select(F.col("chrom1_idx").alias("chrom_idx"), "x"), stage_path, "spots")
    pairs = stored(windows.cross_anchors(anchors, size).select(*POINT), stage_path, "pairs")
    second = score_points(log_cells(near_points(pixels, pairs, size), 10), pairs, size, scorer).where(values.threshold(F.col("score"))).select(*POINT)
    return cluster.merge_near_points(second, dist, ["chrom1_idx", "chrom2_idx"]).drop("chain")


def expected_curve(table: DataFrame, keys: list[str], **smoothing) -> DataFrame:
    """keys, dist, smooth: log of the expected value, cut at the first bad one, smoothed, and never rising."""
    curve = expected.truncate_at_first_bad(expected.expected_by_distance(table, keys), keys)
    return expected.running_min(expected.smooth_expected(curve, keys, **smoothing), keys, "smooth")


def crops_for_calls(results: DataFrame, pixels: DataFrame, chromsizes: DataFrame, chrom: int, res: int, size: int) -> DataFrame:
    """log2(count + 1) around the calls of one chromosome: result_id, dx, dy, value."""
    points = coords.points_for_chrom_pair(results, chromsizes, chrom, chrom, res)
    cells = maps.symmetric(pixels.where("sample = 'test'")).withColumn("value", values.log_value(F.col("count"), 2, 1))
    return windows.cut_windows(cells, windows.centre_to_corner(points, size), size, keep=("result_id",))


def score_model(pred: DataFrame) -> DataFrame:
    """One row: the confusion counts, accuracy, macro F1 and F0.5, and the loss of a table of y_true, y_pred and score."""
    one = evaluate.confusion(pred)
    parts = (evaluate.macro_scores(pred).withColumnRenamed("macro_f", "macro_f1"), evaluate.macro_scores(pred, 0.5).withColumnRenamed("macro_f", "macro_f05"), evaluate.log_loss(pred))
    for p in parts:
        one = one.crossJoin(F.broadcast(p))  # one row each
    return one


def windows_or_zero(cells: DataFrame, anchors: DataFrame, n: int, size: int) -> DataFrame:
    """Dense windows (patch_id, values); one that crosses the map's end is all zeros, as is one without cells."""
    inside = anchors.where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") + size <= n) & (F.col("y") + size <= n))
    dense = scoring.densify(windows.cut_windows(cells, inside, size), size)
    return anchors.select("patch_id").join(dense, "patch_id", "left").withColumn("values", F.coalesce("values", F.array_repeat(F.lit(0.0), size * size)))


def windows_of_maps_or_zero(cells: DataFrame, anchors: DataFrame, chromsizes: DataFrame, res: int, size: int) -> DataFrame:
    """windows_or_zero on the maps of all pairs of chromosomes, each as long as its chromosomes."""
    inside = windows.filter_corners_inside(anchors, chromsizes, size, res)
    dense = scoring.densify(windows.cut_windows(cells, inside, size), size)
    return anchors.select("patch_id").join(dense, "patch_id", "left").withColumn("values", F.coalesce("values", F.array_repeat(F.lit(0.0), size * size)))
