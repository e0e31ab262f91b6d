"""A store of contact maps for joins and windows: bucketed by cell, and within buckets in the order of tiles along a Z-curve.

Both samples' cells of one place are in buckets of the same number, so pairing samples moves nothing. Cells of a tile stand
together in each bucket, so a window reads the few row groups whose range of tile numbers meets its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import floor_div
from ..operators.maps import CELL

#: Bins a side of a tile.
TILE = 64
#: Tiles of windows that a read asks for by number; a read of more takes the chromosomes' pairs whole.
MOST_TILES = 5000


def z_order(a: Column, b: Column) -> Column:
    """The bits of two whole numbers of 31 bits in turns, as one long."""

    def spread(x: Column) -> Column:
        x = x.cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return x

    return spread(a).bitwiseOR(F.shiftleft(spread(b), 1))


def write_map_store(pixels: DataFrame, name: str, path: str, buckets: int, tile: int = TILE, by: tuple[str, ...] = ("sample",), **options) -> None:
    """pixels as the table `name` at path: partitioned by `by` (sample, or resolution and sample), bucketed by cell, sorted by pair of chromosomes and tile.

    The column tile_at holds the tile's place on the curve. options go to the parquet writer.
    """
    placed = pixels.withColumn("tile_at", z_order(floor_div(F.col("bin1"), tile), floor_div(F.col("bin2"), tile)))
    writer = placed.repartition(buckets, *CELL).write.mode("overwrite").options(path=path, **options)
    writer.partitionBy(*by).bucketBy(buckets, *CELL).sortBy("chrom1_idx", "chrom2_idx", "tile_at").saveAsTable(name)


def read_near(spark: SparkSession, name: str, corners: DataFrame, size: int, tile: int = TILE) -> DataFrame:
    """The store's cells in the tiles that windows (chrom1_idx, chrom2_idx, x, y: their corners) touch, and perhaps some more, with filters that reach the scan.

    Windows may lie in either triangle. Of over MOST_TILES tiles only the pairs of chromosomes are asked for.
    """
    turned = corners.select(F.col("chrom2_idx").alias("chrom1_idx"), F.col("chrom1_idx").alias("chrom2_idx"), F.col("y").alias("x"), F.col("x").alias("y"))
    both = corners.select("chrom1_idx", "chrom2_idx", "x", "y").union(turned)
    span = lambda c: F.explode(F.sequence(F.greatest(F.lit(0), floor_div(F.col(c), tile)), F.greatest(F.lit(0), floor_div(F.col(c) + size - 1, tile))))
    tiles = both.select("chrom1_idx", "chrom2_idx", span("x").alias("t"), "y").select("chrom1_idx", "chrom2_idx", "t", span("y").alias("u"))
    asked = tiles.select("chrom1_idx", "chrom2_idx", z_order(F.col("t"), F.col("u")).alias("at")).distinct().limit(MOST_TILES + 1).collect()
    store = spark.read.table(name)
    if len(asked) > MOST_TILES:
        pairs = both.select("chrom1_idx", "chrom2_idx").distinct()
        return store.join(pairs, ["chrom1_idx", "chrom2_idx"], "left_semi").select(store.columns)
    some = {c: sorted({r[c] for r in asked}) for c in ("chrom1_idx", "chrom2_idx", "at")}
    return store.where(F.col("chrom1_idx").isin(some["chrom1_idx"]) & F.col("chrom2_idx").isin(some["chrom2_idx"]) & F.col("tile_at").isin(some["at"]))
