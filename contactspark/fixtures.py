"""The driver's tables in the shapes of contact maps and call lists, by whole-number arithmetic.

The same SQL serves Spark and DuckDB; only the sign for whole division differs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.common import scratch

CHROMSIZES = """
select 0 as chrom_idx, 'c0' as chrom, (q + 1) * 4 * 1000 - 137 as length from m union all
select 1, 'c1', (q + 1) * 3 * 1000 - 274 from m union all
select 2, 'c2', (q + 1) * 2 * 1000 - 411 from m union all
select 3, 'c3', (q + 1) * 1 * 1000 - 548 from m"""

#: Chromosome and bin of an order key.
PLACE = "case when {r} < 4 then 0 when {r} < 7 then 1 when {r} < 9 then 2 else 3 end as {c}, case when {r} < 4 then {q} * 4 + {r} when {r} < 7 then {q} * 3 + {r} - 4 when {r} < 9 then {q} * 2 + {r} - 7 else {q} end as {b}"

VIEWS = {
    "m": "select max(l_orderkey) // 10 as q from lineitem",
    "fx_chromsizes": CHROMSIZES,
    "fx_offsets": "select *, sum(length) over (order by chrom_idx) - length as start, sum(length) over (order by chrom_idx) as stop from fx_chromsizes",
    "fx_pairs": f"""
select case l_linestatus when 'F' then 'test' else 'clean' end as sample, c1, b1 * 1000 + l_partkey % 400 as p1,
       case when l_partkey % 10 = 0 then tc2 else c1 end as c2,
       (case when l_partkey % 10 = 0 then tb2 else least(b1 + (l_suppkey % 7) * (l_linenumber % 7), s.length // 1000) end) * 1000 + l_suppkey % 400 as p2
from (select *, {PLACE.format(r="r2", q="q2", c="tc2", b="tb2")} from (
        select *, k2 // 10 as q2, k2 % 10 as r2, {PLACE.format(r="r1", q="q1", c="c1", b="b1")} from (
          select *, l_orderkey // 10 as q1, l_orderkey % 10 as r1, (l_partkey * 7 + l_suppkey * 3) % (select max(l_orderkey) + 1 from lineitem) as k2 from lineitem) k) a) b
join fx_chromsizes s on s.chrom_idx = c1""",
    "fx_sides": """
select sample, case when f then c1 else c2 end as ca, case when f then p1 else p2 end as pa, case when f then c2 else c1 end as cb, case when f then p2 else p1 end as pb
from (select *, c1 < c2 or (c1 = c2 and p1 <= p2) as f from fx_pairs) t""",
    **{
        f"fx_pixels_{res}": f"select sample, ca as chrom1_idx, pa // {res} as bin1, cb as chrom2_idx, pb // {res} as bin2, count(*) as count from fx_sides group by sample, ca, pa // {res}, cb, pb // {res}"
        for res in (1000, 5000, 10000, 50000)
    },
    "fx_points": """
select l_orderkey * 10 + l_linenumber as id, (l_partkey * 37 + l_suppkey * 11 + l_orderkey) % (t // 1000 + 7) as x, (l_orderkey * 13 + l_partkey) % (t // 1000 + 7) as y
from lineitem cross join (select cast(sum(length) as bigint) as t from fx_chromsizes) g""",
    "fx_calls": f"""
select call_id, c as chrom_idx, 'c' || c as chr, case call_id % 6 when 0 then 'c' || c || '_hap1' else 'c' || c end as hap, start, least(start + (1 + o_custkey % 60) * 1000, s.length) as end_,
       label, o_custkey
from (select o_orderkey as call_id, o_custkey, c, b * 1000 as start,
             case o_orderpriority when '1-URGENT' then '++' when '2-HIGH' then '+-' when '3-MEDIUM' then '-+' when '4-NOT SPECIFIED' then '--' else 'negative' end as label
      from (select *, {PLACE.format(r="r", q="q", c="c", b="b")} from (select *, o_orderkey // 10 as q, o_orderkey % 10 as r from orders) x) y) z
join fx_chromsizes s on s.chrom_idx = c""",
    "fx_results": "select call_id as result_id, f.start + o.start + (o_custkey % 13 - 6) * 1000 as bp_1, f.end_ + o.start + (o_custkey % 13 - 6) * 1000 as bp_2, label from fx_calls f join fx_offsets o on o.chrom_idx = f.chrom_idx",
    "fx_vcf": "select event_type as chrom, user_id * 7000 + event_id % 900 as pos, cast(length(props) + event_id % 97 as bigint) as alt_len from events",
    "fx_wide": """
select l_orderkey * 10 + l_linenumber as id, 'c' || (l_orderkey % 3) as chrom1, l_partkey * 100 as pos1, 'c' || (l_suppkey % 3) as chrom2, l_suppkey * 1000 as pos2,
       cast(l_partkey * 7 % 101 as double) / 100 as pp, cast(l_suppkey * 11 % 101 as double) / 100 as pm, cast(l_orderkey * 13 % 101 as double) / 100 as mp, cast(l_linenumber * 17 % 101 as double) / 100 as mm from lineitem""",
    "fx_alignment": "select case o_orderstatus when 'F' then 'SYN' else 'INV' end as type, o_orderkey as id, o_custkey * 100 as astart, o_custkey * 100 + (o_orderkey % 1000) * 100 as aend, o_orderkey * 10 as bstart, o_orderkey * 10 + (o_custkey % 1000) * 100 as bend from orders",
    "fx_expected": "select sample, bin2 - bin1 as dist, cast(sum(count) as double) as balanced_sum, count(*) as n_valid from fx_pixels_10000 where chrom1_idx = chrom2_idx group by sample, bin2 - bin1",
    "fx_bins": "select chrom_idx, local_bin, case when bin_id % 37 = 0 then null else 1 + cast(bin_id % 5 as double) / 10 end as weight from (select c.chrom_idx, b.local_bin, b.local_bin + coalesce((select cast(sum(d.length // 10000 + 1) as bigint) from fx_chromsizes d where d.chrom_idx < c.chrom_idx), 0) as bin_id from fx_chromsizes c cross join {bins} b where b.local_bin <= c.length // 10000) t",
    "fx_predictions": "select vec_id as patch_id, label as y_class, (label * 7 + vec_id) % 10 as p_class, label % 2 as y_true, case when (vec_id * 37 + label * 11) % 100 >= 50 then 1 else 0 end as y_pred, cast((vec_id * 37 + label * 11) % 100 as double) / 100 as score from embeddings",
}
DUCK_BINS = "(select unnest(range(0, (select max(length) // 10000 + 1 from fx_chromsizes))) as local_bin)"
SPARK_BINS = "(select explode(sequence(0L, (select max(length) // 10000 from fx_chromsizes))) as local_bin)"


def duckdb_sql(body: str) -> str:
    """A query over the views for DuckDB."""
    views = ",\n".join(f"{n} as ({v.replace('{bins}', DUCK_BINS)})" for n, v in VIEWS.items())
    return f"with {views}\n{body}"


#: Views that many queries start from: written once a session and table folder, so that queries do their own work.
KEPT = ("fx_sides", "fx_calls", "fx_results", *(f"fx_pixels_{res}" for res in (1000, 5000, 10000, 50000)))
_kept: dict[tuple[str, str, str], str] = {}


def kept(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The path of a view in the shared folder."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _kept:
        path = scratch(spark, name)
        _build(spark, sf_dir, name).write.parquet(path)
        _kept[at] = path
    return _kept[at]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    return spark.read.parquet(kept(spark, sf_dir, name)) if name in KEPT else _build(spark, sf_dir, name)


def _build(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view from its SQL. Its common table expressions are only those that it needs."""
    texts: dict[str, str] = {}

    def visit(n: str) -> None:
        if n in KEPT and n != name:
            texts[n] = f"select * from parquet.`{kept(spark, sf_dir, n)}`"
            return
        text = VIEWS[n].replace("{bins}", SPARK_BINS)
        for other in VIEWS:
            if other != n and other not in texts and re.search(rf"\b{other}\b", text):
                visit(other)
        text = text.replace("//", " div ")
        for table in ("lineitem", "orders", "events", "embeddings"):
            text = re.sub(rf"\b(from|join) {table}\b", rf"\1 parquet.`{sf_dir}/{table}.parquet`", text)
        texts[n] = text

    visit(name)
    return spark.sql("with " + ", ".join(f"{n} as ({text})" for n, text in texts.items()) + f" select * from {name}")


def chromsizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chromosome list, read once: four rows."""
    rows = view(spark, sf_dir, "fx_chromsizes").collect()
    return spark.createDataFrame([tuple(r) for r in rows], "chrom_idx int, chrom string, length long")


def pixels(spark: SparkSession, sf_dir: str, res: int) -> DataFrame:
    return view(spark, sf_dir, f"fx_pixels_{res}")


def cells(spark: SparkSession, sf_dir: str, res: int) -> DataFrame:
    """Cells of the test sample in both triangles, with value."""
    from .operators.maps import symmetric

    return symmetric(pixels(spark, sf_dir, res)).where("sample = 'test'").withColumn("value", F.col("count").cast("double")).drop("count")
