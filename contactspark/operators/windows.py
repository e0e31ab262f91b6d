"""Windows on maps: which ones to cut, and the cells that fall into each.

Cells meet windows by an equi-join on square tiles as large as a window, of which a window touches four
at most; so the join deals out by tile and never compares all with all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import bounded, floor_div, spread
from .maps import CELL


def diagonal_windows(cells: DataFrame, n_bins: int, size: int, step: int, low: str = "bin1", high: str = "bin2") -> DataFrame:
    """Each cell once for each window on the diagonal that holds it: adds window and start.

    Window i starts at i * step, or is moved back to end with the map; there are n_bins // step. The ids are
    arithmetic, size / step of them at most, so nothing is joined. Cells need low <= high.
    """
    last = n_bins // step - 1
    if last < 0 or n_bins < size:
        return cells.limit(0).withColumns({"window": F.lit(0).cast("long"), "start": F.lit(0).cast("long")})
    first = F.greatest(F.lit(0).cast("long"), floor_div(F.col(high) - size, step) + 1)
    until = F.least(F.lit(last).cast("long"), F.expr(f"({low} + {size}) div {step}"))
    near = cells.where(F.col(high) - F.col(low) < size).withColumn("window", F.explode(F.when(first <= until, F.sequence(first, until)).otherwise(F.array().cast("array<bigint>"))))
    near = near.withColumn("start", F.least(F.col("window") * step, F.lit(n_bins - size).cast("long")))
    return near.where((F.col("start") <= F.col(low)) & (F.col(high) < F.col("start") + size))


def full_map_windows(chromsizes: DataFrame, res: int, size: int, step: int) -> DataFrame:
    """All windows (chrom_idx, x, y) of each chromosome with x <= y that lie inside it; too small chromosomes have none."""
    n = F.expr(f"length div {res}")
    fits = chromsizes.where(n >= size).select("chrom_idx", n.alias("n"))
    xs = fits.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - size, F.lit(step).cast("long"))))
    return spread(xs, "chrom_idx", "x").withColumn("y", F.explode(F.sequence(F.col("x"), F.col("n") - size, F.lit(step).cast("long")))).select("chrom_idx", "x", "y")


def cut_windows(cells: DataFrame, windows: DataFrame, width: int, height: int | None = None, keep: tuple[str, ...] = ("patch_id",)) -> DataFrame:
    """keep + dx, dy, value for each cell in each window; windows have chrom1_idx, chrom2_idx, x and y (their corner).

    cells need both triangles where a window may cross the diagonal. Empty windows have no row.
    """
    height = height or width
    w = windows.withColumns({
        "_t": F.explode(F.sequence(floor_div(F.col("x"), width), floor_div(F.col("x") + width - 1, width))),
    }).withColumn("_u", F.explode(F.sequence(floor_div(F.col("y"), height), floor_div(F.col("y") + height - 1, height))))
    c = cells.select(*CELL, "value", floor_div(F.col("bin1"), width).alias("_t"), floor_div(F.col("bin2"), height).alias("_u"))
    met = w.join(c, ["chrom1_idx", "chrom2_idx", "_t", "_u"]).where(
        (F.col("bin1") >= F.col("x")) & (F.col("bin1") < F.col("x") + width) & (F.col("bin2") >= F.col("y")) & (F.col("bin2") < F.col("y") + height)
    )
    return met.select(*keep, (F.col("bin1") - F.col("x")).alias("dx"), (F.col("bin2") - F.col("y")).alias("dy"), "value")


def box_cells(cells: DataFrame, boxes: DataFrame, tile: int = 64) -> DataFrame:
    """Cells of boxes of any size (box_id, chrom1_idx, chrom2_idx, x0, y0, width, height), by tiles: box_id, bin1, bin2, value."""
    ends = {"_t": ("x0", "width"), "_u": ("y0", "height")}
    b = boxes
    for tiles, (at, size) in ends.items():
        b = b.withColumn(tiles, F.explode(F.sequence(floor_div(F.col(at), tile), floor_div(F.col(at) + F.col(size) - 1, tile))))
    c = cells.select(*CELL, "value", floor_div(F.col("bin1"), tile).alias("_t"), floor_div(F.col("bin2"), tile).alias("_u"))
    inside = F.expr("bin1 >= x0 and bin1 < x0 + width and bin2 >= y0 and bin2 < y0 + height")
    return b.join(c, ["chrom1_idx", "chrom2_idx", "_t", "_u"]).where(inside).select("box_id", "bin1", "bin2", "value")


def box_windows(boxes: DataFrame, size: int, step: int = 1) -> DataFrame:
    """Every window of a box, as its corner x, y and its centre cx, cy; boxes smaller than a window have none. A box's columns are dealt out, as one box may hold most windows."""
    along = lambda at, side: F.explode(F.sequence(F.col(at), F.col(at) + F.col(side) - size, F.lit(step).cast("long")))
    b = boxes.where((F.col("width") >= size) & (F.col("height") >= size)).withColumn("x", along("x0", "width"))
    b = spread(b, "box_id", "x").withColumn("y", along("y0", "height"))
    return b.select("box_id", "x", "y", (F.col("x") + size // 2).alias("cx"), (F.col("y") + size // 2).alias("cy"))


def sub_windows(windows: DataFrame, n: int, size: int, step: int, factor: int = 1) -> DataFrame:
    """Small windows along the diagonal of larger ones that start at `start`: offsets 0, step, ... below n - size, on a map `factor` times finer."""
    return windows.withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(max(0, n - size - 1)), F.lit(step)))).withColumn("sub_start", F.col("start") * factor + F.col("sub"))


def refine_grid(det: DataFrame, patch_size: int, patch_res: int, size: int, res: int) -> DataFrame:
    """Distinct candidates (chrom1_idx, chrom2_idx, x, y) on a finer map around detections on a coarser one."""
    step, coef = max(1, patch_size // ((patch_size * patch_res) // (size * res))), patch_res // res
    near = lambda c: F.explode(F.sequence(F.lit(0), F.lit(patch_size - 1), F.lit(step))).alias(c)
    grid = det.select("chrom1_idx", "chrom2_idx", "x", "y", near("i")).select("*", near("j"))
    at = lambda c, i: (F.col(c) - patch_size // 2 + F.col(i)) * coef
    return distinct_coords(grid.select("chrom1_idx", "chrom2_idx", at("x", "i").alias("x"), at("y", "j").alias("y")))


def distinct_coords(df: DataFrame) -> DataFrame:
    return df.dropDuplicates(["chrom1_idx", "chrom2_idx", "x", "y"])


def mark_inside(df: DataFrame, chromsizes: DataFrame, size: int, res: int, flag: str = "inside") -> DataFrame:
    """df with a flag of whether the window of `size` around the point lies inside both chromosomes; unknown chromosomes hold none."""
    pad, n = size // 2, F.expr(f"length div {res}")
    lengths = bounded(chromsizes.select(F.col("chrom_idx").alias("chrom1_idx"), n.alias("_n1")))
    joined = df.join(lengths, "chrom1_idx", "left").join(lengths.toDF("chrom2_idx", "_n2"), "chrom2_idx", "left")
    inside = (F.col("x") >= pad) & (F.col("y") >= pad) & (F.col("x") + pad <= F.col("_n1")) & (F.col("y") + pad <= F.col("_n2"))
    return joined.select(*df.columns, F.coalesce(inside, F.lit(False)).alias(flag))


def filter_inside(df: DataFrame, chromsizes: DataFrame, size: int, res: int) -> DataFrame:
    """Points whose window of `size` around them lies inside both chromosomes."""
    return mark_inside(df, chromsizes, size, res, "_inside").where("_inside").drop("_inside")


def filter_corners_inside(df: DataFrame, chromsizes: DataFrame, size: int, res: int, upper: bool = False) -> DataFrame:
    """Windows whose corner is x, y that lie inside both chromosomes; upper: only those with x <= y."""
    inside = filter_inside(df.withColumns({"x": F.col("x") + size // 2, "y": F.col("y") + size // 2}), chromsizes, size, res)
    found = centre_to_corner(inside, size).select(df.columns)
    return found.where("x <= y") if upper else found


def filter_margin(df: DataFrame, size: int, k: int = 1) -> DataFrame:
    return df.where((F.col("x") * k > size // 2) & (F.col("y") * k > size // 2))


def filter_upper_in_bounds(df: DataFrame, n: int, size: int) -> DataFrame:
    return df.where((F.col("x") <= F.col("y")) & (F.col("y") + size <= n) & (F.col("x") >= 0))


def cross_anchors(anchors: DataFrame, size: int, ordered_by_chrom: bool = False, block: int = 2000) -> DataFrame:
    """Pairs of anchors (chrom_idx, x): all but those with x < y, or near each other on one chromosome.

    The number of pairs is what is asked for here and follows the square of the thinned anchors. Both sides are dealt out in blocks
    of about `block` anchors and joined on the pair of blocks, so a task holds one pair's anchors. ordered_by_chrom: order pairs between
    chromosomes by chromosome instead of by local bin.
    """
    n = max(math.isqrt(anchors.sparkSession.sparkContext.defaultParallelism), -(-anchors.count() // block))
    dealt = anchors.select("chrom_idx", "x", F.pmod(F.xxhash64("chrom_idx", "x"), F.lit(n)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other"))
    a = dealt.select(F.col("chrom_idx").alias("chrom1_idx"), "x", F.col("own").alias("_i"), F.col("other").alias("_j"))
    b = dealt.select(F.col("chrom_idx").alias("chrom2_idx"), F.col("x").alias("y"), F.col("other").alias("_i"), F.col("own").alias("_j"))
    cis = F.expr("chrom1_idx = chrom2_idx")
    order = (cis & (F.col("x") >= F.col("y"))) | (F.col("chrom1_idx") > F.col("chrom2_idx")) if ordered_by_chrom else F.col("x") >= F.col("y")
    return a.join(b, ["_i", "_j"]).where(order & ~(cis & (F.abs(F.col("x") - F.col("y")) < size))).drop("_i", "_j")


def centre_to_corner(df: DataFrame, size: int) -> DataFrame:
    return df.withColumns({"x": F.col("x") - size // 2, "y": F.col("y") - size // 2})


def clamp_to_map(x: Column, y: Column, pad: int, n: Column) -> Column:
    """Struct of x and y moved into the map: by one common shift on the low side, each by itself on the high side."""
    shift = F.greatest(F.lit(0), pad - F.least(x, y))
    return F.struct(F.least(x + shift, n - pad - 1).alias("x"), F.least(y + shift, n - pad - 1).alias("y"))


def endpoint_windows(calls: DataFrame, kind: str = "diagonal") -> DataFrame:
    """Window centres of calls: both ends on the diagonal, or one patch (start, end), or (end, start) for kind turned."""
    points = {
        "diagonal": F.array(F.struct(F.col("start").alias("x"), F.col("start").alias("y")), F.struct(F.col("end").alias("x"), F.col("end").alias("y"))),
        "patch": F.array(F.struct(F.col("start").alias("x"), F.col("end").alias("y"))),
        "turned": F.array(F.struct(F.col("end").alias("x"), F.col("start").alias("y"))),
    }[kind]
    return calls.select("*", F.posexplode(points).alias("which", "p")).select(*calls.columns, "which", "p.x", "p.y")
