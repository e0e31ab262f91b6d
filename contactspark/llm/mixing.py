"""A mix of sources near target weights, by systematic sampling.

Sources share a number of words by weight; none gives more than so many times what it has, and what is too much for one is
shared by the others. A document's expected copies are its source's target over the source's size. Documents stand in a row within
their source, the largest first, and their expected copies are summed up; with one random offset added, a document is
taken once for each whole number that its sum crosses. As neighbours are alike in size, the words taken differ from
the target by no more than about the largest document; of a few offsets drawn, that of the least difference is used.

All of this is done by built-in functions on narrow rows (key, source, size); texts are read once, to count words, and not shuffled. The order
is a range sort over sizes and rows, so a source that holds most of them is many ranges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_order, stored, words

WEIGHTS = (5, 2, 1)
PERCENT = 150
MOST_COPIES = 2
OFFSETS = 16
SEED = 42
#: Expected copies and offsets are whole numbers of this part of a copy, so that sums are exact.
UNIT_BITS = 24
#: The golden section of 2 ** 32, as an odd number; multiples of it are spread evenly.
SPREAD = 2654435761


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST_COPIES) -> DataFrame:
    """source, docs, source_size, target, ordinal and first (how many documents stand before the source's) of each source; sizes has source and size.

    Sources are in the order of their code points, nulls last, which is that of the weights. Those that have the least for their weight
    are the first to give all they can; running sums in that order tell where this ends, so there is no loop over sources.
    """
    each = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").cast("long").alias("source_size"))
    ranked = in_order(each, [F.asc_nulls_last("source")], {"ordinal": None, "first": F.col("docs")})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("ordinal", F.lit(len(weights))) + 1).cast("int")).cast("long")
    fill = F.col("source_size") * F.expr(f"{math.lcm(*weights)} div weight")  # size for weight, as a whole number
    filled = in_order(ranked.withColumn("weight", weight).withColumn("fill", fill), [F.col("fill"), F.col("ordinal")], {"full": F.col("source_size"), "off": F.col("weight")})
    total = filled.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"))
    level = (F.col("words") * percent / 100.0 - most * F.col("full")) / (F.col("weights") - F.col("off"))
    open_ = filled.join(F.broadcast(total)).withColumn("level", level).where(F.col("level") * F.col("weight") <= most * F.col("source_size"))
    chosen = open_.agg(F.min(F.struct("fill", "ordinal", "level"))["level"].alias("level"))  # of one row, null where all give all they can
    target = F.least(F.col("level") * F.col("weight"), (most * F.col("source_size")).cast("double"))
    return filled.join(F.broadcast(chosen)).select("source", "docs", "source_size", F.coalesce(target, (most * F.col("source_size")).cast("double")).alias("target"), "ordinal", "first")


def copies(place: Column, rate: Column, offset: Column) -> Column:
    """The whole numbers that the sum of expected copies crosses at the document of that place."""
    return F.shiftright(offset + rate * (place + 1), UNIT_BITS) - F.shiftright(offset + rate * place, UNIT_BITS)


def mix(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST_COPIES, offsets: int = OFFSETS, seed: int = SEED
) -> DataFrame:
    """key, source, size (words of the text), source_size, target (of the source), copies and taken (words of all copies) of each row.

    Together the targets are `percent` of all words. Words are runs of anything but ASCII white space. Null and blank texts
    have none: they may be taken, but add nothing. A null source is one of its own. Repeated rows and keys count as rows of their own;
    rows alike in key, source and size may change places, which the result does not show. Runs on the same rows agree, however they are dealt out. Other columns are not
    kept; see emit() for the documents themselves. An empty table gives no rows.
    """
    sizes = stored(df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size")), "mix-sizes")
    unit = 1 << UNIT_BITS
    rate = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)) * unit + 0.5), F.lit(0)).cast("long")
    known = stored(targets(sizes, weights, percent, most).withColumn("rate", rate).withColumnRenamed("source", "of"), "mix-targets")
    rows = in_order(sizes, [F.asc_nulls_last("source"), F.desc("size"), F.asc_nulls_last("key")], {"row": None})
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("of"))).withColumn("place", F.col("row") - F.col("first"))
    drawn = [F.shiftrightunsigned(F.pmod((F.lit(seed) + F.col("ordinal") * offsets + j) * F.lit(SPREAD), F.lit(1 << 32)), 32 - UNIT_BITS) for j in range(offsets)]
    tried = rows.groupBy("ordinal").agg(F.first("target").alias("aim"), *(F.sum(F.col("size") * copies(F.col("place"), F.col("rate"), u)).alias(f"taken{j}") for j, u in enumerate(drawn)))
    best = F.array_min(F.array(*(F.struct(F.abs(F.col(f"taken{j}") - F.col("aim")).alias("off"), F.lit(j).alias("j")) for j in range(offsets))))["j"]
    chosen = stored(tried.select("ordinal", best.alias("j")), "mix-offsets")
    n = copies(F.col("place"), F.col("rate"), F.element_at(F.array(*drawn), F.col("j") + 1))
    out = rows.join(chosen, "ordinal").withColumn("copies", n)
    return out.select(F.col("key").alias(key), F.col("size"), F.col("source_size"), F.col("target"), (F.col("size") * F.col("copies")).alias("taken"), F.col("copies"), F.col("source").alias(source))


def emit(df: DataFrame, mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of df, each as often as mix() takes it; keys are to be unique and not null (see common.numbered)."""
    wanted = mixed.where("copies > 0").select(key, F.col("copies").cast("int").alias("_copies"))
    return df.join(wanted, key).withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies")


SQL = rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) - 1 as ordinal from s),
w as (select *, {list(WEIGHTS)}[ordinal % {len(WEIGHTS)} + 1] as weight from r),
f as (select *, source_size * ({math.lcm(*WEIGHTS)} // weight) as fill from w),
b as (select *, coalesce(sum(source_size) over o, 0) as full_, coalesce(sum(weight) over o, 0) as off_ from f window o as (order by fill, ordinal rows between unbounded preceding and 1 preceding)),
t as (select sum(source_size) as words, sum(weight) as weights from w),
l as (select *, (words * {PERCENT}::double / 100 - {MOST_COPIES} * full_) / (weights - off_) as level from b, t),
m as (select level from l where level * weight <= {MOST_COPIES} * source_size order by fill, ordinal limit 1),
g as (select *, coalesce(least((select level from m) * weight, {MOST_COPIES}.0::double * source_size), {MOST_COPIES}.0::double * source_size) as target from b),
h as (select *, coalesce(floor(target / nullif(source_size, 0) * {1 << UNIT_BITS} + 0.5), 0)::bigint as rate from g),
p as (select d.doc_id, d.source, d.size, h.source_size, h.target, h.ordinal, h.rate, row_number() over (partition by d.source order by d.size desc, d.doc_id nulls last) - 1 as place
      from d join h on d.source is not distinct from h.source),
u as (select ordinal, j, ((({SEED} + ordinal * {OFFSETS} + j) * {SPREAD}) % {1 << 32}) // {1 << (32 - UNIT_BITS)} as offset_ from w, range({OFFSETS}) as x(j)),
c as (select p.*, j, (offset_ + rate * (place + 1)) // {1 << UNIT_BITS} - (offset_ + rate * place) // {1 << UNIT_BITS} as copies from p join u on p.ordinal = u.ordinal),
e as (select ordinal, j, abs(sum(size * copies) - any_value(target)) as off_ from c group by ordinal, j),
k as (select ordinal, arg_min(j, (off_, j)) as j from e group by ordinal)
select c.doc_id, size, source_size::bigint as source_size, target, (size * copies)::bigint as taken, copies::bigint as copies, source from c join k on c.ordinal = k.ordinal and c.j = k.j
"""
