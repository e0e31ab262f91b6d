"""Near-duplicates by 64-bit SimHash fingerprints that differ in few bits.

A fingerprint is cut into segments of two bits and mapped to the vector of the segments' bit counts. Each bit
that differs changes one count by one, so the Manhattan distance of two vectors is a lower bound of
the Hamming distance of the fingerprints. Vectors within two of each other have a grid point within
one of both; so each fingerprint joins the grid at its own point and those one step away, and equal
points give the candidates, which are then compared exactly. The counts of a random fingerprint hold 48
bits, so among a billion of them one in a hundred meets another that is not near.

Where very many fingerprints are near each other, they share grid points. Those of a shared point are not paired up: there
a fingerprint joins by itself and its 64 one-bit neighbours: two fingerprints within two bits have one of
these in common, and those that have one in common are within two bits. So nothing is lost, at most 65
fingerprints meet at one such point, and the work stays in proportion to the number of fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import few
from .common import giving_back, stored
from .components import components

SEGMENTS = 32
#: The lower bit of each segment.
LOWER = 0x5555555555555555
MAX_BITS = 2
#: Fingerprints at one grid point from which on they are joined by one-bit neighbours.
CROWDED = 24
SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The majority of each bit over the hashes of all word shingles, repeats included; 0 without a word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), "i8", len(words)) + 1
    ends = np.cumsum(sizes) - 1
    k = min(shingle, len(words))
    starts, ends = (ends - sizes + 1)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    count, total = np.zeros(64, "i8"), len(starts)
    for i in range(0, total, 100_000):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + 100_000], ends[i : i + 100_000], strict=True)], ">u8")
        count += np.unpackbits(h.view("u1")).reshape(-1, 64).sum(axis=0, dtype="i4")
    return int.from_bytes(np.packbits(2 * count > total).tobytes(), "big")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp, the fingerprint as a signed long."""
    schema = T.StructType([df.schema[key], T.StructField("fp", T.LongType(), False)])

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in few(whole, text):
                fps = np.array([fingerprint(t) for t in b[text].to_pylist()], "u8").view("i8")
                yield pa.RecordBatch.from_arrays([b[key], pa.array(fps)], names=[key, "fp"])

    return df.select(key, text).mapInArrow(run, schema)


def grid_points(fp: Column) -> Column:
    """The point of the bit counts and those one step away whose counts are 0, 1 or 2, each packed into a long, two bits a segment."""
    low = F.lit(LOWER)
    upper, lower = F.shiftrightunsigned(fp, 1).bitwiseAND(low), fp.bitwiseAND(low)
    own = upper.bitwiseXOR(lower).bitwiseOR(F.shiftleft(upper.bitwiseAND(lower), 1))  # counts the bits of all segments at once
    turns = [0, *((x << 2 * s) - (1 << 64 if x << 2 * s >> 63 else 0) for s in range(SEGMENTS) for x in (1, 3))]  # from 0 to 1 or 1 to 0, from 1 to 2 or 2 to 1
    points = F.transform(F.array(*(F.lit(x).cast("long") for x in turns)), lambda turn: own.bitwiseXOR(turn))
    return F.filter(points, lambda p: p.bitwiseAND(F.shiftrightunsigned(p, 1)).bitwiseAND(low) == 0)  # a count that a turn is not for becomes 3


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of fingerprints that connect all within MAX_BITS; fps has distinct fp.

    Joins are hinted: Spark takes a table for as short as it was before an explode, and would broadcast it.
    """
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))  # a short table that is about to grow
    cells = spread.select("fp", F.explode(grid_points(F.col("fp"))).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = stored(cells.join(sizes.hint("merge"), "cell"), "simhash-cells")
    left, right = met.where(F.col("n") <= CROWDED).alias("x"), met.where(F.col("n") <= CROWDED).alias("y")
    close = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= MAX_BITS
    pairs = left.join(right.hint("merge"), (F.col("x.cell") == F.col("y.cell")) & (F.col("x.fp") < F.col("y.fp")) & close).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    crowd = met.where(F.col("n") > CROWDED).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)))
    near = crowd.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    least = near.groupBy("point").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("point", "b")
    stars = near.join(least.hint("merge"), "point").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.union(stars).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp and component_id (the smallest key that is reachable over links) for each row.

    Null and blank texts have fingerprint 0 and link as any other. Fingerprints are the nodes, whatever the keys of their rows, so copies are never
    paired up, and rows of null keys link others and are linked as any; component_id is null only where no key is
    reachable. Repeated keys keep a row each. Other columns are not kept. An empty table gives no rows.
    """
    return grouped(stored(fingerprints(df, key, text), "simhash-prints"), key)


def grouped(prints: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same for given fingerprints: key and fp."""
    nodes = prints.groupBy("fp").agg(F.min(key).alias("node"))
    found = components(links(nodes.select("fp")))
    members = nodes.join(found.withColumnRenamed("node", "of"), F.col("fp") == F.col("of"), "left").select("fp", "node", F.coalesce("component", "fp").alias("component"))
    smallest = members.groupBy("component").agg(F.min("node").alias("component_id"))
    labels = members.select("fp", "component").join(smallest, "component").select("fp", "component_id")
    return prints.join(labels, "fp", "left").select(key, "fp", "component_id")
