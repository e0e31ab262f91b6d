"""Contact maps as long tables: coarser bins, balancing, and the alignment of two samples.

A cell has sample, chrom1_idx, bin1, chrom2_idx, bin2 and a count; bins count from each chromosome's start.
Zeros are not stored. Joins are on the whole cell key, so they deal out evenly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import bounded

CELL = ["chrom1_idx", "bin1", "chrom2_idx", "bin2"]


def coarsen(pixels: DataFrame, factor: int) -> DataFrame:
    """Counts of factor by factor blocks of bins; sums are made before the shuffle."""
    return pixels.withColumns({"bin1": F.expr(f"bin1 div {factor}"), "bin2": F.expr(f"bin2 div {factor}")}).groupBy("sample", *CELL).agg(F.sum("count").alias("count"))


def coarsen_all(pixels: DataFrame, factors: list[int]) -> DataFrame:
    """coarsen for each factor, with the factor as a column, from one scan; a cell is summed up for each of them before the shuffle."""
    levels = F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.expr(f"bin1 div {f}").alias("bin1"), F.expr(f"bin2 div {f}").alias("bin2")) for f in factors)))
    each = pixels.select("sample", "chrom1_idx", "chrom2_idx", "count", levels.alias("at")).select("sample", "chrom1_idx", "chrom2_idx", "count", "at.*")
    return each.groupBy("factor", "sample", *CELL).agg(F.sum("count").alias("count"))


def check_resolutions(pixels: DataFrame, required: list[int]) -> None:
    """Raises ValueError if a required resolution has no pixel."""
    if missing := sorted(r["resolution"] for r in available_resolutions(pixels, required).where("not available").collect()):
        raise ValueError(f"resolutions missing: {missing}")


def available_resolutions(pixels: DataFrame, required: list[int]) -> DataFrame:
    """(resolution, available) for each required resolution."""
    wanted = pixels.sparkSession.createDataFrame([(r,) for r in required], "resolution int")
    found = pixels.select(F.col("resolution").cast("int").alias("resolution")).distinct().withColumn("found", F.lit(True))
    return wanted.join(found, "resolution", "left").select("resolution", F.coalesce("found", F.lit(False)).alias("available"))


def symmetric(cells: DataFrame) -> DataFrame:
    """Both triangles: each cell off the diagonal also with its sides exchanged."""
    off = cells.where("chrom1_idx <> chrom2_idx or bin1 <> bin2")
    swap = {"chrom1_idx": "chrom2_idx", "chrom2_idx": "chrom1_idx", "bin1": "bin2", "bin2": "bin1"}
    turned = off.select(*(F.col(swap.get(c, c)).alias(c) for c in off.columns))
    return cells.unionByName(turned)


def pair_samples(cells: DataFrame, test: str = "test", clean: str = "clean", how: str = "inner", value: str = "count") -> DataFrame:
    """Cells of two samples side by side as a and b. how: inner, or full for cells of either."""
    a = cells.where(F.col("sample") == test).select(*CELL, F.col(value).alias("a"))
    b = cells.where(F.col("sample") == clean).select(*CELL, F.col(value).alias("b"))
    return a.join(b, CELL, how)


def apply_balance(pixels: DataFrame, bins: DataFrame) -> DataFrame:
    """pixels with value = count times both bins' weights; null where a weight is. The weights are broadcast if few."""
    w = bins.select("chrom_idx", "local_bin", "weight")
    w1 = w.select(F.col("chrom_idx").alias("chrom1_idx"), F.col("local_bin").alias("bin1"), F.col("weight").alias("w1"))
    w2 = w.select(F.col("chrom_idx").alias("chrom2_idx"), F.col("local_bin").alias("bin2"), F.col("weight").alias("w2"))
    return pixels.join(bounded(w1), ["chrom1_idx", "bin1"]).join(bounded(w2), ["chrom2_idx", "bin2"]).withColumn("value", F.col("count") * F.col("w1") * F.col("w2"))


def attach_expected(cells: DataFrame, expected: DataFrame) -> DataFrame:
    """Cells within a chromosome with the expected value of their distance."""
    cis = cells.where("chrom1_idx = chrom2_idx").withColumn("dist", F.abs(F.col("bin2") - F.col("bin1")))
    return cis.join(bounded(expected.select("dist", "expected")), "dist", "left")


def attach_manifest(samples: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of samples with their clean sample, truth list and split."""
    return samples.join(bounded(manifest), "sample_id")
