"""Conversions between chromosome positions and positions on the whole genome.

chromsizes has chrom_idx, chrom and length. Lists of chromosomes are broadcast if a check finds them short; positions
find theirs by buckets of the genome. Two conventions for a position equal to a chromosome's end exist side by side:
`genome_to_chrom` counts it to the earlier chromosome, `bp_to_chrom_exclusive` to the later one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, floor_div


def bin_of(pos: Column, res: int) -> Column:
    return floor_div(pos, res)


def rescale(x: Column, from_res: int, to_res: int) -> Column:
    """A bin at one resolution as the bin at another that holds its start."""
    return floor_div(x * from_res, to_res)


def chrom_offsets(chromsizes: DataFrame) -> DataFrame:
    """chromsizes with start (exclusive running sum) and stop (inclusive) on the whole genome."""
    order = Window.orderBy("chrom_idx").rowsBetween(Window.unboundedPreceding, 0)
    return chromsizes.withColumn("stop", F.sum("length").over(order)).withColumn("start", F.col("stop") - F.col("length"))


def located(df: DataFrame, offsets: DataFrame, at: Column, hit: Column) -> DataFrame:
    """df with the columns of the chromosomes (offsets, with _start and _stop on the genome) for which hit holds at position at.

    Chromosomes are dealt out to buckets of the genome, about as many as there are chromosomes, and positions look only into theirs; so an
    assembly of very many contigs costs no more for a position than one of a few. Positions before the genome are looked up at its start.
    """
    n, end = offsets.agg(F.count(F.lit(1)), F.max("_stop")).first()
    width = max(1, -(-(end or 0) // max(1024, 2 * n)))
    spread = offsets.withColumn("_bucket", F.explode(F.sequence(floor_div(F.col("_start"), width), floor_div(F.col("_stop"), width))))
    return df.withColumn("_bucket", floor_div(F.greatest(at, F.lit(0)), width)).join(bounded(spread), "_bucket").where(hit).drop("_bucket")


def _axis(df: DataFrame, offsets: DataFrame, coord: str, res: int, chrom: str, local: str) -> DataFrame:
    o = offsets.select(F.col("chrom_idx").alias(chrom), F.col("start").alias("_start"), F.col("stop").alias("_stop"))
    p = F.col(coord) * res
    hit = (p <= F.col("_stop")) & ((p > F.col("_start")) | (F.col(chrom) == 0))
    value = F.when(F.col(chrom) == 0, F.col(coord)).otherwise(floor_div(p - F.col("_start"), res))
    return located(df, o, p, hit).withColumn(local, value.cast("long")).drop("_start", "_stop")


def genome_to_chrom(df: DataFrame, chromsizes: DataFrame, coord: str, res: int, chrom: str = "chrom_idx", local: str = "local_bin") -> DataFrame:
    """Genome bins to chromosome and local bin; rows beyond the last chromosome are dropped."""
    return _axis(df, chrom_offsets(chromsizes), coord, res, chrom, local)


def genome_to_chrom_pair(df: DataFrame, chromsizes: DataFrame, res: int, x: str = "x", y: str = "y") -> DataFrame:
    """Both axes; a row is dropped if either is out of range. Adds chrom1_idx, local_x, chrom2_idx, local_y."""
    o = chrom_offsets(chromsizes)
    return _axis(_axis(df, o, x, res, "chrom1_idx", "local_x"), o, y, res, "chrom2_idx", "local_y")


def chrom_to_genome(df: DataFrame, chromsizes: DataFrame, local: str, res: int, chrom: str = "chrom", out: str = "genome_bin") -> DataFrame:
    """Chromosome (by name or index, as the column is called) and local bin to the genome bin: floor of genome bp."""
    by = "chrom_idx" if chrom.startswith("chrom_idx") or chrom.endswith("_idx") else "chrom"
    o = chrom_offsets(chromsizes).select(F.col(by).alias(chrom), F.col("start").alias("_start"))
    return df.join(bounded(o), chrom).withColumn(out, floor_div(F.col(local) * res + F.col("_start"), res)).drop("_start")


def chrom_to_genome_pair(df: DataFrame, chromsizes: DataFrame, res: int, x: str = "x", y: str = "y") -> DataFrame:
    """Both axes, chromosomes given by chrom1_idx and chrom2_idx. Adds genome_x, genome_y."""
    one = chrom_to_genome(df, chromsizes, x, res, "chrom1_idx", "genome_x")
    return chrom_to_genome(one, chromsizes, y, res, "chrom2_idx", "genome_y")


def bp_to_chrom_exclusive(df: DataFrame, chromsizes: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Genome positions to chromosome names and positions; pairs: column to (name column, position column)."""
    o = chrom_offsets(chromsizes)
    for column, (name, pos) in pairs.items():
        side = o.select(F.col("chrom").alias(name), F.col("start").alias("_start"), F.col("stop").alias("_stop"))
        hit = (F.col(column) >= F.col("_start")) & (F.col(column) < F.col("_stop"))
        df = located(df, side, F.col(column), hit).withColumn(pos, F.col(column) - F.col("_start")).drop("_start", "_stop")
    return df


def chrom_margin_local(df: DataFrame, chromsizes: DataFrame, chrom: str, columns: tuple[str, ...] = ("bp_1", "bp_2")) -> DataFrame:
    """Rows with all given genome positions strictly inside one chromosome, as positions on it."""
    o = chrom_offsets(chromsizes).where(F.col("chrom") == chrom).select(F.col("start").alias("_start"), F.col("stop").alias("_stop"))
    inside = F.lit(True)
    for c in columns:
        inside &= (F.col(c) > F.col("_start")) & (F.col(c) < F.col("_stop"))
    return df.join(bounded(o), inside).withColumns({c: F.col(c) - F.col("_start") for c in columns}).drop("_start", "_stop")


def points_for_chrom_pair(results: DataFrame, chromsizes: DataFrame, chrom1: int, chrom2: int, res: int) -> DataFrame:
    """Calls (bp_1, bp_2) that lie in one pair of chromosomes, as local bins x and y; both axes are filtered together."""
    found = genome_to_chrom_pair(results, chromsizes, 1, "bp_1", "bp_2").where((F.col("chrom1_idx") == chrom1) & (F.col("chrom2_idx") == chrom2))
    return found.withColumn("x", floor_div(F.col("local_x"), res)).withColumn("y", floor_div(F.col("local_y"), res)).drop("local_x", "local_y")
