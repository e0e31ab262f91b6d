"""Exact top-k search in binary codes by incremental multi-index hashing.

A code of 64 bits is cut into segments, about as wide as it takes to number the codes. The index has a row for each code and
segment, by the segment's value. Round r joins each open query with the codes that differ in exactly r bits in
some segment, and a pair is looked at in one round and segment only: that of the fewest differing bits, the
first of equals. A code not met by round r differs in at least r + 1 bits of every segment, so as soon as a query's k-th
distance is below (r + 1) times the number of segments, its k best are proven and it is closed. Open queries carry
their k-th distance into the next round, and pairs beyond it go before anything is shuffled.
"""

from __future__ import annotations

import functools
import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BITS = 64
#: The fewest bits of a segment.
NARROWEST = 8


def sign_code(vector: Column) -> Column:
    """The signs of the components as bits of a long; missing and null components are 0. Null for a null vector; one of over 64 components is an error."""
    bit = lambda i: F.coalesce((F.get(vector, F.lit(i)) > 0).cast("long"), F.lit(0).cast("long"))
    out = bit(0)
    for i in range(1, BITS):
        out = out.bitwiseOR(F.shiftleft(bit(i), i))
    return F.when(F.size(vector) > BITS, F.raise_error(F.lit(f"a vector of over {BITS} components"))).when(vector.isNotNull(), out)


def segments(codes: int) -> list[tuple[int, int]]:
    """First bit and width of each segment: at most as wide as the binary logarithm of the number of codes, so that most values have a code."""
    n = math.ceil(BITS / max(NARROWEST, math.log2(max(2, codes))))
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def part(code: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(code, start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def values(code: Column, cuts: list[tuple[int, int]], radius: int = 0) -> Column:
    """Array of (segment, value) of all values that differ from the code's own in `radius` bits."""

    def near(s: int, start: int, width: int) -> Column:
        masks = F.split(F.lit(",".join(str(sum(1 << b for b in bits)) for bits in combinations(range(width), radius))), ",").cast("array<bigint>")
        return F.transform(masks, lambda m: F.struct(F.lit(s).alias("segment"), part(code, start, width).bitwiseXOR(m).alias("value")))

    return F.concat(*(near(s, a, w) for s, (a, w) in enumerate(cuts) if w >= radius))


def best_of(rows: DataFrame, k: int) -> DataFrame:
    """(q, best, kth) from (q, distance, lacks, id): the k best of each query, and the k-th distance if there are k."""
    order = Window.partitionBy("q").orderBy(F.asc_nulls_last("distance"), "lacks", "id")
    kept = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    found = kept.groupBy("q").agg(F.sort_array(F.collect_list(F.when(F.col("distance").isNotNull(), F.struct("distance", "lacks", "id")))).alias("best"))
    return found.withColumn("kth", F.when(F.size("best") == k, F.get("best", F.lit(k - 1))["distance"]))


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", code: str = "code") -> DataFrame:
    """query_id, rank (from 1), neighbour_id, distance: the k nearest rows of each query by distance, then by key, null keys last.

    The query's own row counts, too. Rows without a code are no neighbours, queries without one have no
    result; equal codes and repeated rows are neighbours each on its own, and each row of queries gets a list of its own, whether
    its key is repeated or null. Fewer than k rows give fewer ranks. Of rows of equal codes only the k smallest keys can be
    among the k best, so no more are looked at, which is exact. Queries of one code are searched for once.
    """
    equal = Window.partitionBy("code").orderBy("lacks", "id")
    rows = codes.select(F.col(key).isNull().alias("lacks"), F.col(key).alias("id"), F.col(code).alias("code")).where("code is not null")
    rows = rows.withColumn("n", F.row_number().over(equal)).where(F.col("n") <= k)
    rows = stored(rows.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("lacks", "id"))).alias("ids")), "hamming-codes")  # at most k keys a code
    cuts = segments(rows.count())
    index = rows.select("code", "ids", F.inline(values(F.col("code"), cuts)))
    asked = queries.select(F.col(key).alias("query_id"), F.col(code).alias("q")).where("q is not null")
    ids = rows.schema["ids"].dataType.elementType["id"].dataType.simpleString()
    nothing = F.array().cast(f"array<struct<distance:int,lacks:boolean,id:{ids}>>")
    state = asked.select("q").distinct().select("q", nothing.alias("best"), F.lit(None).cast("int").alias("kth"))
    closed = []
    for radius in range(max(w for _, w in cuts) + 1):
        looked = state.select("q", "kth", F.inline(values(F.col("q"), cuts, radius)))
        apart = F.col("q").bitwiseXOR(F.col("code"))
        fewest = F.least(*(F.bit_count(part(apart, a, w)) for a, w in cuts)) if len(cuts) > 1 else F.bit_count(apart)
        where = F.coalesce(*(F.when(F.bit_count(part(apart, a, w)) == radius, s) for s, (a, w) in enumerate(cuts)))
        met = looked.join(index.hint("merge"), ["segment", "value"]).where((fewest == radius) & (where == F.col("segment")))
        met = met.select("q", "kth", F.bit_count(apart).cast("int").alias("distance"), "ids").where(F.col("kth").isNull() | (F.col("distance") <= F.col("kth")))
        met = met.select("q", "distance", F.inline("ids"))
        before = state.select("q", F.inline_outer("best"))
        state = stored(best_of(before.unionByName(met), k), f"hamming-{radius}")
        proven = F.col("kth").isNotNull() & (F.col("kth") < len(cuts) * (radius + 1))
        closed.append(state.where(proven))
        state = state.where(~proven)
        if state.isEmpty():
            break
    found = functools.reduce(DataFrame.unionByName, [*closed, state]).select("q", "best")
    ranked = asked.join(found, "q").select("query_id", F.posexplode("best").alias("place", "b"))
    return ranked.select("query_id", (F.col("place") + 1).cast("long").alias("rank"), F.col("b.id").alias("neighbour_id"), F.col("b.distance").cast("long").alias("distance"))


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: x > 0) as s from embeddings where embedding is not null),
d as (select q.vec_id as query_id, v.vec_id as neighbour_id,
        len(list_filter(range(1, 65), lambda i: coalesce(q.s[i], false) <> coalesce(v.s[i], false)))::bigint as distance
      from v q join v on q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by distance, neighbour_id) as rank from d)
select query_id, rank, neighbour_id, distance from r where rank <= 10
"""
