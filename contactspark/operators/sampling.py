"""Training samples. All chance is a hash of ids and a seed, so results do not depend on the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import bounded, floor_div
from ..functions.coords import chrom_offsets

MODULUS = 2_147_483_647


def chance(key: Column, k: int, seed: int = 0) -> Column:
    """A number in 0 .. MODULUS - 1 from an id, the number of the draw, and a seed."""
    return F.pmod(F.pmod(key, F.lit(MODULUS)) * 1_103_515_245 + 12_345 * k + seed, F.lit(MODULUS))


def uniform(key: Column, k: int, lo: Column | int, hi: Column | int, seed: int = 0) -> Column:
    """A whole number from lo to hi, both included."""
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return lo + F.pmod(F.expr("0L") + chance(key, k, seed), hi - lo + 1)


def negatives_per_call(calls: DataFrame, chromsizes: DataFrame, size: int, res: int, key: str = "call_id", seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """One negative for each call: a chromosome at random, a start clear of its ends, and an end size to 10 size bins on. keep: columns of calls that stay.

    Chromosomes too short for that are left out of the draw.
    """
    pad = size // 2 * res
    order = Window.orderBy("chrom_idx")
    fit = chromsizes.where(F.col("length") > 2 * pad + 1).select("chrom_idx", "length", (F.row_number().over(order) - 1).alias("_n"))
    n = fit.count()
    if not n:
        return calls.select(*keep, key, F.lit(None).cast("int").alias("chrom_idx"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit("negative").alias("label")).limit(0)
    drawn = calls.select(*keep, key, F.pmod(chance(F.col(key), 1, seed), F.lit(n)).cast("int").alias("_n")).join(bounded(fit), "_n")
    start = uniform(F.col(key), 2, F.lit(pad), F.col("length") - pad - 1, seed)
    return drawn.select(*keep, key, "chrom_idx", start.alias("start"), (start + uniform(F.col(key), 3, size * res, 10 * size * res, seed)).alias("end"), F.lit("negative").alias("label"))


def negatives_genome(calls: DataFrame, genome_length: int, key: str = "call_id", seed: int = 11) -> DataFrame:
    """One negative for each call with both ends anywhere on the genome."""
    return calls.select(key, uniform(F.col(key), 1, 0, genome_length - 1, seed).alias("bp_1"), uniform(F.col(key), 2, 0, genome_length - 1, seed).alias("bp_2"))


def jitter(df: DataFrame, pad: int, key: str = "call_id", seed: int = 3, shared: bool = False) -> DataFrame:
    """x and y moved by up to pad // 2 each, or both by the same up to pad // 4."""
    if shared:
        move = uniform(F.col(key), 1, -(pad // 4), pad // 4, seed)
        return df.withColumns({"x": F.col("x") + move, "y": F.col("y") + move})
    return df.withColumns({"x": F.col("x") + uniform(F.col(key), 1, -(pad // 2), pad // 2, seed), "y": F.col("y") + uniform(F.col(key), 2, -(pad // 2), pad // 2, seed)})


def diagonal_negatives(chromsizes: DataFrame, res: int, total: int, seed: int = 5) -> DataFrame:
    """Distinct diagonal positions, a tenth of each chromosome's bins at most, in chromosome order until `total` are met."""
    n = F.expr(f"length div {res}")
    quota = chromsizes.select("chrom_idx", n.alias("n"), F.expr(f"length div {res} div 10").alias("most"))
    before = F.coalesce(F.sum("most").over(Window.orderBy("chrom_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = quota.withColumn("take", F.greatest(F.lit(0), F.least("most", total - before)))
    bins = quota.where("take > 0").withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    ranked = bins.withColumn("r", F.row_number().over(Window.partitionBy("chrom_idx").orderBy(chance(F.col("x"), 1, seed), "x")))
    return ranked.where("r <= take").select("chrom_idx", "x")


def anti_existing(new: DataFrame, used: DataFrame, on: list[str]) -> DataFrame:
    """Distinct new positions that are not used yet."""
    return new.dropDuplicates(on).join(used.select(*on).distinct(), on, "left_anti")


def union_samples(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Both with is_sv, columns by name."""
    return positives.withColumn("is_sv", F.lit(True)).unionByName(negatives.withColumn("is_sv", F.lit(False)), allowMissingColumns=True)


def split(df: DataFrame, key: str, percent: int = 80, seed: int = 1) -> DataFrame:
    """df with split, train for about so many percent of the keys, else test."""
    return df.withColumn("split", F.when(F.pmod(chance(F.col(key), 1, seed), F.lit(100)) < percent, "train").otherwise("test"))


def genome_length(chromsizes: DataFrame) -> int:
    return chromsizes.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def call_bins(calls: DataFrame, chromsizes: DataFrame, res: int) -> DataFrame:
    """Calls as x and y on the genome's bins."""
    o = chrom_offsets(chromsizes).select("chrom_idx", F.col("start").alias("_o"))
    return calls.join(bounded(o), "chrom_idx").withColumns({"x": floor_div(F.col("start") + F.col("_o"), res), "y": floor_div(F.col("end") + F.col("_o"), res)}).drop("_o")
