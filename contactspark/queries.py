"""The registered queries of the map and call operators, each with its SQL twin for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import cells, chromsizes, duckdb_sql, pixels, view
from .functions import coords, values
from .functions.common import floor_div, scratch
from .operators import calls, cluster, evaluate, expected, maps, normalize, sampling, scoring, windows
from .sources import readers, store, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SIZE, STEP = 8, 4


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its own name, with SQL over the views."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = duckdb_sql(sql)
        return f

    return put


def fx_calls(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_calls").withColumnRenamed("end_", "end")


# --- sources ---------------------------------------------------------------------------------------


@query("select distinct 10000 as resolution, sample from fx_pixels_10000")
def src2_resolutions(spark, sf):
    p = pixels(spark, sf, 10000).withColumn("resolution", F.lit(10000))
    maps.check_resolutions(p, [10000])
    return p.select("resolution", "sample").distinct()


@query("select sample, chrom1_idx, bin1 // 5 as bin1, chrom2_idx, bin2 // 5 as bin2, sum(count)::bigint as count from fx_pixels_1000 group by all")
def src3_coarsen(spark, sf):
    return maps.coarsen(pixels(spark, sf, 1000), 5)


@query("select chrom1_idx, bin1, chrom2_idx, bin2, count from fx_pixels_10000 where sample = 'test'")
def src1_read_contact_map(spark, sf):
    """The map is written as tables of two resolutions first."""
    path = scratch(spark, "map")
    both = [pixels(spark, sf, res).withColumn("resolution", F.lit(res)) for res in (10000, 50000)]
    both[0].unionByName(both[1]).select("sample", "resolution", *maps.CELL, "count").write.partitionBy("resolution").parquet(f"{path}/pixels")
    chromsizes(spark, sf).write.parquet(f"{path}/chromsizes")
    view(spark, sf, "fx_bins").select(F.lit(10000).alias("resolution"), "chrom_idx", "local_bin", "weight").write.parquet(f"{path}/bins")
    return readers.read_contact_map(spark, path, 10000, "test")["pixels"].select(*maps.CELL, "count")


@query("select chr, label, start, end_ as \"end\" from fx_calls")
def src4_read_sv_calls(spark, sf):
    path = scratch(spark, "calls")
    writers.write_calls(fx_calls(spark, sf), path, sep=";")
    return readers.read_sv_calls(spark, path, ";")


@query("select chrom1, pos1, chrom2, pos2, pp, pm, mp, mm from fx_wide")
def src5_read_wide_calls(spark, sf):
    path = scratch(spark, "wide")
    writers.write_calls(wide(spark, sf), path, ("chrom1", "pos1", "chrom2", "pos2", "`++`", "`+-`", "`-+`", "`--`"), "\t")
    return readers.read_wide_calls(spark, path).select("chrom1", "pos1", "chrom2", "pos2", F.col("++").alias("pp"), F.col("+-").alias("pm"), F.col("-+").alias("mp"), F.col("--").alias("mm"))


@query("select chrom, pos, alt_len from fx_vcf")
def src6_read_vcf(spark, sf):
    path = scratch(spark, "vcf")
    lines = view(spark, sf, "fx_vcf").select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), F.lit("A"), F.expr("repeat('T', cast(alt_len as int))")).alias("value"))
    lines.union(spark.range(1).select(F.lit("##fileformat=VCF\n#CHROM\tPOS\tID\tREF\tALT"))).write.text(path)
    return readers.read_vcf(spark, path).select("chrom", "pos", "alt_len")


@query("select dist, n_valid, balanced_sum from fx_expected")
def src7_read_expected(spark, sf):
    path = scratch(spark, "expected")
    writers.write_calls(view(spark, sf, "fx_expected"), path, ("dist", "n_valid", "balanced_sum"), "\t")
    return readers.read_expected(spark, path)


@query("select 'p' || p_partkey as chrom, (p_size * 4)::bigint as length from part")
def src8_read_fasta_lengths(spark, sf):
    path = scratch(spark, "fasta")
    p = spark.read.parquet(f"{sf}/part.parquet")
    p.select(F.concat(F.lit(">p"), F.col("p_partkey").cast("string"), F.lit(" x\n"), F.expr("repeat('AC\\nGT\\n', p_size)"))).write.text(path)
    return readers.read_fasta_lengths(spark, path)


@query(" union all ".join(f"select {f} as factor, sample, chrom1_idx, bin1 // {f} as bin1, chrom2_idx, bin2 // {f} as bin2, sum(count)::bigint as count from fx_pixels_1000 group by all" for f in (5, 10, 50)))
def src3_coarsen_all(spark, sf):
    return maps.coarsen_all(pixels(spark, sf, 1000), [5, 10, 50])


@query("select chrom1_idx, bin1, chrom2_idx, bin2, t.count as a, k.count as b from (select * from fx_pixels_10000 where sample = 'test') t join (select * from fx_pixels_10000 where sample = 'clean') k using (chrom1_idx, bin1, chrom2_idx, bin2)")
def snk1_map_store(spark, sf):
    """Maps written by buckets of cells, and the samples paired from there."""
    path = scratch(spark, "map-store")
    name = path.rpartition("/")[2].replace("-", "_")
    store.write_map_store(pixels(spark, sf, 10000), name, path, 8)
    return maps.pair_samples(spark.read.table(name))


@query("select distinct chrom1_idx, bin1 as x from fx_pixels_50000 where sample = 'test'")
def snk1_stage(spark, sf):
    path = scratch(spark, "stages")
    writers.write_stage(pixels(spark, sf, 50000).where("sample = 'test'").select("chrom1_idx", F.col("bin1").alias("x")).distinct(), path, "one")
    return writers.read_stage(spark, path, "one")


@query("select bp_1, bp_2, label from fx_results")
def snk2_results(spark, sf):
    path = scratch(spark, "results")
    writers.write_results(view(spark, sf, "fx_results"), path)
    return spark.read.csv(path, schema="bp_1 long, bp_2 long, label string", header=True)


@query("select chrom_x as chr, coord_x as start, coord_y as \"end\" from ({co7})")
def snk3_calls(spark, sf):
    from .plans.jobs import results_to_chrom

    path = scratch(spark, "exports")
    found = results_to_chrom(view(spark, sf, "fx_results"), chromsizes(spark, sf))
    writers.write_calls(found.select(F.col("chrom_x").alias("chr"), F.col("coord_x").alias("start"), F.col("coord_y").alias("end")), path, ("chr", "start", "end"))
    return spark.read.csv(path, schema="chr string, start long, end long", header=True)


# --- coordinates -----------------------------------------------------------------------------------


@query("select call_id, start // 5000 as start_bin, end_ // 5000 as end_bin from fx_calls")
def co1_bin_of(spark, sf):
    return fx_calls(spark, sf).select("call_id", coords.bin_of(F.col("start"), 5000).alias("start_bin"), coords.bin_of(F.col("end"), 5000).alias("end_bin"))


@query("select chrom_idx, chrom, length, start::bigint as start, stop::bigint as stop from fx_offsets")
def co2_chrom_offsets(spark, sf):
    return coords.chrom_offsets(chromsizes(spark, sf)).select("chrom_idx", "chrom", "length", "start", "stop")


TO_CHROM = "case when {o}.chrom_idx = 0 then {c} else ({c} * 1000 - {o}.start) // 1000 end::bigint"


@query(f"select id, o.chrom_idx, {TO_CHROM.format(o='o', c='x')} as local_bin from fx_points join fx_offsets o on x * 1000 <= o.stop and (x * 1000 > o.start or o.chrom_idx = 0)")
def co3_genome_to_chrom(spark, sf):
    return coords.genome_to_chrom(view(spark, sf, "fx_points"), chromsizes(spark, sf), "x", 1000).select("id", "chrom_idx", "local_bin")


PAIR = f"""select id, o.chrom_idx as chrom1_idx, {TO_CHROM.format(o="o", c="x")} as local_x, p.chrom_idx as chrom2_idx, {TO_CHROM.format(o="p", c="y")} as local_y
from fx_points join fx_offsets o on x * 1000 <= o.stop and (x * 1000 > o.start or o.chrom_idx = 0) join fx_offsets p on y * 1000 <= p.stop and (y * 1000 > p.start or p.chrom_idx = 0)"""


@query(PAIR)
def co4_genome_to_chrom_pair(spark, sf):
    return coords.genome_to_chrom_pair(view(spark, sf, "fx_points"), chromsizes(spark, sf), 1000).select("id", "chrom1_idx", "local_x", "chrom2_idx", "local_y")


@query("select sample, p.chrom1_idx, bin1, p.chrom2_idx, bin2, ((bin1 * 10000 + o.start) // 10000)::bigint as genome_x, ((bin2 * 10000 + q.start) // 10000)::bigint as genome_y from fx_pixels_10000 p join fx_offsets o on o.chrom_idx = p.chrom1_idx join fx_offsets q on q.chrom_idx = p.chrom2_idx")
def co5_chrom_to_genome_pair(spark, sf):
    return coords.chrom_to_genome_pair(pixels(spark, sf, 10000), chromsizes(spark, sf), 10000, "bin1", "bin2").select("sample", "chrom1_idx", "bin1", "chrom2_idx", "bin2", "genome_x", "genome_y")


@query("select call_id, ((c.start // 5000 * 5000 + o.start) // 5000)::bigint as genome_bin from fx_calls c join fx_offsets o on o.chrom = c.chr")
def co6_chrom_to_genome(spark, sf):
    c = fx_calls(spark, sf).select("call_id", F.col("chr").alias("chrom"), floor_div(F.col("start"), 5000).alias("b"))
    return coords.chrom_to_genome(c, chromsizes(spark, sf), "b", 5000).select("call_id", "genome_bin")


CO7 = """select result_id, o.chrom as chrom_x, (bp_1 - o.start)::bigint as coord_x, p.chrom as chrom_y, (bp_2 - p.start)::bigint as coord_y from fx_results
join fx_offsets o on bp_1 >= o.start and bp_1 < o.stop join fx_offsets p on bp_2 >= p.start and bp_2 < p.stop"""


SQL["snk3_calls"] = SQL["snk3_calls"].replace("{co7}", CO7)


@query(CO7)
def co7_bp_to_chrom_exclusive(spark, sf):
    r = view(spark, sf, "fx_results")
    return coords.bp_to_chrom_exclusive(r, chromsizes(spark, sf), {"bp_1": ("chrom_x", "coord_x"), "bp_2": ("chrom_y", "coord_y")}).select("result_id", "chrom_x", "coord_x", "chrom_y", "coord_y")


@query("select sample, chrom1_idx, bin1, bin2, bin1 * 10000 // 50000 as coarse1, bin2 * 10000 // 1000 as fine2 from fx_pixels_10000")
def co8_rescale(spark, sf):
    return pixels(spark, sf, 10000).select("sample", "chrom1_idx", "bin1", "bin2", coords.rescale(F.col("bin1"), 10000, 50000).alias("coarse1"), coords.rescale(F.col("bin2"), 10000, 1000).alias("fine2")).distinct()


SQL["co8_rescale"] = SQL["co8_rescale"].replace("select sample, chrom1_idx, bin1, bin2, bin1 * 10000", "select distinct sample, chrom1_idx, bin1, bin2, bin1 * 10000")


@query("select result_id, (bp_1 - o.start)::bigint as bp_1, (bp_2 - o.start)::bigint as bp_2 from fx_results join fx_offsets o on o.chrom = 'c1' and bp_1 > o.start and bp_1 < o.stop and bp_2 > o.start and bp_2 < o.stop")
def co9_chrom_margin_local(spark, sf):
    return coords.chrom_margin_local(view(spark, sf, "fx_results"), chromsizes(spark, sf), "c1").select("result_id", "bp_1", "bp_2")


CO10 = """select result_id, ((bp_1 - o.start) // 5000)::bigint as x, ((bp_2 - p.start) // 5000)::bigint as y from fx_results
join fx_offsets o on o.chrom_idx = 1 and bp_1 > o.start and bp_1 <= o.stop join fx_offsets p on p.chrom_idx = 1 and bp_2 > p.start and bp_2 <= p.stop"""


@query(CO10)
def co10_points_for_chrom_pair(spark, sf):
    return coords.points_for_chrom_pair(view(spark, sf, "fx_results"), chromsizes(spark, sf), 1, 1, 5000).select("result_id", "x", "y")


# --- values, labels, names -------------------------------------------------------------------------

KEY = "chrom1_idx, bin1, chrom2_idx, bin2"
BOTH = f"(select * exclude (sample, count), count as a from fx_pixels_10000 where sample = 'test') t {{how}} join (select * exclude (sample, count), count as b from fx_pixels_10000 where sample = 'clean') c using ({KEY})"


def pairs(spark, sf, how="inner", res=10000):
    return maps.pair_samples(pixels(spark, sf, res), how=how)


@query(f"select {KEY}, sample, round(log10(count), 6) as l10, round(log2(count + 1), 6) as l2, round(ln(count + 0.5) / ln(3), 6) as l3 from fx_pixels_10000")
def sc1_log_value(spark, sf):
    v = F.col("count")
    return pixels(spark, sf, 10000).select(*maps.CELL, "sample", F.round(values.log_value(v), 6).alias("l10"), F.round(values.log_value(v, 2, 1), 6).alias("l2"), F.round(values.log_value(v, 3, 0.5), 6).alias("l3"))


@query(f"select {KEY}, case when a is null then 0.0 when b is null then 2.0 when a = b then 0.0 else round(log10(a) - log10(b), 6) end::double as v from {BOTH.format(how='full')}")
def sc2_clean_non_finite(spark, sf):
    p = pairs(spark, sf, "full")
    raw = F.when(F.col("a").isNull(), F.lit(values.NEG_INF)).when(F.col("b").isNull(), F.lit(values.POS_INF)).otherwise(F.log10("a") - F.log10("b"))
    return p.select(*maps.CELL, F.round(values.clean_non_finite(raw, 0.0, 2.0), 6).alias("v"))


@query(f"select {KEY}, round(log10(a) - log10(b) + 1e-6, 6) as v from {BOTH.format(how='')}")
def sc3_log_ratio_masked(spark, sf):
    return pairs(spark, sf).select(*maps.CELL, F.round(values.log_ratio_masked(F.col("a"), F.col("b")), 6).alias("v"))


@query(f"select {KEY}, round(log10(coalesce(a, 0) + 1e-6) - log10(coalesce(b, 0) + 1e-6), 6) as v from {BOTH.format(how='full')}")
def sc4_log_ratio_pseudo(spark, sf):
    return pairs(spark, sf, "full").select(*maps.CELL, F.round(values.log_ratio_pseudo(F.col("a"), F.col("b")), 6).alias("v"))


BALANCED = f"""select chrom1_idx, bin1, chrom2_idx, bin2, round(log10(case when w is null then 0 else coalesce(a * w, 0) + 1e-6 end + 1e-6) - log10(case when w is null then 0 else coalesce(b * w, 0) + 1e-6 end + 1e-6), 6) as v
from (select p.*, x.weight * y.weight as w from (select * from {BOTH.format(how="full")}) p join fx_bins x on x.chrom_idx = chrom1_idx and x.local_bin = bin1 join fx_bins y on y.chrom_idx = chrom2_idx and y.local_bin = bin2)"""


@query(BALANCED)
def sc5_log_ratio_balanced(spark, sf):
    p = maps.apply_balance(pairs(spark, sf, "full").withColumn("count", F.lit(1)), view(spark, sf, "fx_bins")).withColumn("w", F.col("value"))
    masked = F.col("w").isNull()
    return p.select(*maps.CELL, F.round(values.log_ratio_balanced(F.col("a") * F.col("w"), masked, F.col("b") * F.col("w"), masked), 6).alias("v"))


@query(f"select {KEY}, round(log10(a) - log10(b), 6) as v from {BOTH.format(how='')}")
def sc6_log_ratio_raw(spark, sf):
    return calls.call_log_ratios(pairs(spark, sf)).select(*maps.CELL, F.round("value", 6).alias("v"))


@query("select call_id, label, list_position(['negative', '--', '-+', '+-', '++'], label) - 1 as idx, list_transform(range(0, 5), lambda i: (i = list_position(['negative', '--', '-+', '+-', '++'], label) - 1)::int) as hot from fx_calls")
def sc7_labels(spark, sf):
    i = values.label_to_index(F.col("label"))
    return fx_calls(spark, sf).select("call_id", values.index_to_label(i).alias("label"), i.alias("idx"), values.one_hot(i).alias("hot"))


LARGEST = "case greatest(pp, pm, mp, mm) when pp then '++' when pm then '+-' when mp then '-+' else '--' end"


def wide(spark, sf):
    return view(spark, sf, "fx_wide").withColumnsRenamed({"pp": "++", "pm": "+-", "mp": "-+", "mm": "--"})


@query(f"select id, {LARGEST} as label from fx_wide")
def sc8_wide_to_label(spark, sf):
    return wide(spark, sf).select("id", values.wide_to_label().alias("label"))


@query("select patch_id, score > 0.5 as rounded, score >= 0.95 as sure from fx_predictions")
def sc9_threshold(spark, sf):
    return view(spark, sf, "fx_predictions").select("patch_id", values.threshold(F.col("score")).alias("rounded"), values.threshold(F.col("score"), "cutoff").alias("sure"))


def patches(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("patch_id"), F.col("embedding").cast("array<double>").alias("values"), "label")


@query("select vec_id as patch_id, (list_position(embedding, list_max(embedding)) - 1)::int as class_idx, ['negative', '--', '-+', '+-', '++'][list_position(embedding, list_max(embedding))] as label from embeddings")
def sc10_class_argmax(spark, sf):
    i = values.class_argmax(F.col("values"))
    return patches(spark, sf).select("patch_id", i.alias("class_idx"), values.index_to_label(i).alias("label"))


@query("select patch_id, list_transform(e, lambda x: round(x / list_sum(e), 6)) as p from (select vec_id as patch_id, list_transform(embedding::double[], lambda x: exp(x)) as e from embeddings)")
def sc11_softmax(spark, sf):
    return patches(spark, sf).select("patch_id", F.transform(values.softmax(F.col("values")), lambda x: F.round(x, 6)).alias("p"))


@query("select call_id, regexp_replace(hap, '_hap[12]$', '') as chrom from fx_calls")
def sc12_strip_haplotype(spark, sf):
    return fx_calls(spark, sf).select("call_id", values.strip_haplotype(F.col("hap")).alias("chrom"))


@query("select call_id, hap as chrom, start as x, end_ as y from fx_calls")
def sc13_parse_patch_key(spark, sf):
    named = fx_calls(spark, sf).withColumn("key", F.concat_ws("_", "hap", F.col("start").cast("string"), F.concat(F.col("end").cast("string"), F.lit(".png"))))
    return named.select("call_id", values.parse_patch_key(F.col("key")).alias("k")).select("call_id", "k.*")


@query("select event_id, length(props)::int as alt_len, (user_id * 7000 + event_id % 900) // 5000 as pos_res from events")
def sc14_alt_length(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", values.alt_length(F.col("props")).alias("alt_len"), floor_div(F.col("user_id") * 7000 + F.col("event_id") % 900, 5000).alias("pos_res"))


# --- filters ---------------------------------------------------------------------------------------


@query("select call_id, chr, label from fx_calls where chr = 'c1' and label not in ('negative', '+-')")
def fi1_filters(spark, sf):
    return calls.filter_labels(calls.filter_chrom(fx_calls(spark, sf), "c1"), drop=["negative", "+-"]).select("call_id", "chr", "label")


@query("select * from fx_alignment where type <> 'SYN' and abs(aend - astart) > 50000 and abs(bend - bstart) > 50000")
def fi2_alignment_svs(spark, sf):
    return calls.filter_alignment_svs(view(spark, sf, "fx_alignment"))


@query(f"select chrom1 as chr, {LARGEST} as label, pos1 as start, pos2 as \"end\" from fx_wide where chrom1 = chrom2")
def fi3_filter_cis(spark, sf):
    return calls.filter_cis(wide(spark, sf).withColumn("label", values.wide_to_label()))


@query("select result_id, bp_2 as bp_1, bp_1 as bp_2 from fx_results where greatest(bp_1, bp_2) < (select stop from fx_offsets where chrom_idx = 2) and bp_2 - bp_1 > 10000")
def fi4_eval_results(spark, sf):
    r = view(spark, sf, "fx_results").select("result_id", F.col("bp_2").alias("bp_1"), F.col("bp_1").alias("bp_2"))
    return calls.filter_eval_results(r, coords.chrom_offsets(chromsizes(spark, sf))).select("result_id", "bp_1", "bp_2")


DETECTIONS = "(select distinct chrom1_idx, chrom2_idx, bin1 as x, bin2 as y from fx_pixels_50000 where sample = 'test' and count > 1)"


def detections(spark, sf):
    return pixels(spark, sf, 50000).where("sample = 'test' and count > 1").select("chrom1_idx", "chrom2_idx", F.col("bin1").alias("x"), F.col("bin2").alias("y"))


@query(f"select d.* from {DETECTIONS} d join fx_chromsizes a on a.chrom_idx = chrom1_idx join fx_chromsizes b on b.chrom_idx = chrom2_idx where x >= 4 and y >= 4 and x + 4 <= a.length // 50000 and y + 4 <= b.length // 50000")
def fi5_inside(spark, sf):
    return windows.filter_inside(detections(spark, sf), chromsizes(spark, sf), SIZE, 50000)


@query(f"select * from {DETECTIONS} where x > 4 and y > 4")
def fi6_margin(spark, sf):
    return windows.filter_margin(detections(spark, sf), SIZE)


@query("select call_id, start // 5000 as start_bin, end_ // 5000 as end_bin from fx_calls where abs(start // 5000 - end_ // 5000) >= 5")
def fi7_span(spark, sf):
    return calls.filter_span(co1_bin_of(spark, sf))


@query(f"select * from {DETECTIONS} where x <= y and y + 8 <= 100")
def fi9_upper(spark, sf):
    return windows.filter_upper_in_bounds(detections(spark, sf), 100, SIZE)


# --- joins -----------------------------------------------------------------------------------------


@query(f"select {KEY}, a, b from {BOTH.format(how='full')}")
def jn1_pair_samples(spark, sf):
    return pairs(spark, sf, "full").select(*maps.CELL, "a", "b")


ANCHORS = "(select distinct chrom1_idx as chrom_idx, bin1 * 10 as x from fx_pixels_50000 where sample = 'test')"


@query(f"select a.chrom_idx as chrom1_idx, a.x, b.chrom_idx as chrom2_idx, b.x as y from {ANCHORS} a, {ANCHORS} b where a.x >= b.x and not (a.chrom_idx = b.chrom_idx and abs(a.x - b.x) < 48)")
def jn3_cross_anchors(spark, sf):
    a = pixels(spark, sf, 50000).where("sample = 'test'").select(F.col("chrom1_idx").alias("chrom_idx"), (F.col("bin1") * 10).alias("x")).distinct()
    return windows.cross_anchors(a, 48)


TEST_CELLS = "(select chrom1_idx, bin1, chrom2_idx, bin2, count::double as value from fx_pixels_{res} where sample = 'test' union all select chrom2_idx, bin2, chrom1_idx, bin1, count::double from fx_pixels_{res} where sample = 'test' and (chrom1_idx <> chrom2_idx or bin1 <> bin2))"
WINDOWS = f"(select distinct chrom1_idx, chrom2_idx, x - 4 as x, y - 4 as y, chrom1_idx || '-' || chrom2_idx || '-' || x || '-' || y as patch_id from {DETECTIONS})"
CUT = f"(select patch_id, bin1 - x as dx, bin2 - y as dy, value from {WINDOWS} w join {TEST_CELLS.format(res=10000)} c using (chrom1_idx, chrom2_idx) where bin1 >= x and bin1 < x + 8 and bin2 >= y and bin2 < y + 8)"


def cut(spark, sf):
    w = detections(spark, sf).withColumn("patch_id", F.concat_ws("-", *(F.col(c).cast("string") for c in ("chrom1_idx", "chrom2_idx", "x", "y"))))
    return windows.cut_windows(cells(spark, sf, 10000), windows.centre_to_corner(w, SIZE), SIZE)


@query(f"select * from {CUT}")
def jn4_cut_windows(spark, sf):
    return cut(spark, sf)


def bins5(spark, sf):
    r = view(spark, sf, "fx_results").withColumns({"bp_1": F.expr("bp_1 div 5000"), "bp_2": F.expr("bp_2 div 5000")})
    a = sampling.call_bins(fx_calls(spark, sf).where("label <> 'negative'"), chromsizes(spark, sf), 5000).select(F.col("x").alias("bp_1"), F.col("y").alias("bp_2"))
    return r, a


MATCHED = """(select result_id, exists (select 1 from a where abs(a.bp_1 - r.bp_1) <= 1) as found_x, exists (select 1 from a where abs(a.bp_2 - r.bp_2) <= 1) as found_y from r)"""
BINS5 = "(select result_id, bp_1 // 5000 as bp_1, bp_2 // 5000 as bp_2 from fx_results)"
ANSWERS = "(select ((c.start + o.start) // 5000)::bigint as bp_1, ((c.end_ + o.start) // 5000)::bigint as bp_2 from fx_calls c join fx_offsets o on o.chrom_idx = c.chrom_idx where label <> 'negative')"
WITH_MATCHED = f"select {{what}} from (with r as {BINS5}, a as (select * from {ANSWERS}), ax as (select distinct bp_1 from a), ay as (select distinct bp_2 from a), x as (select distinct result_id from r join (select bp_1 + unnest([-1, 0, 1]) as v from ax) z on v = r.bp_1), y as (select distinct result_id from r join (select bp_2 + unnest([-1, 0, 1]) as v from ay) z on v = r.bp_2) select r.result_id, x.result_id is not null as found_x, y.result_id is not null as found_y from r left join x on x.result_id = r.result_id left join y on y.result_id = r.result_id) m"


@query(WITH_MATCHED.format(what="*"))
def jn5_match_calls(spark, sf):
    r, a = bins5(spark, sf)
    return evaluate.match_calls(r, a, tol=1, crossed=False).select("result_id", "found_x", "found_y")


@query("select p.sample, chrom1_idx, bin1, chrom2_idx, bin2, round(count * x.weight * y.weight, 6) as value from fx_pixels_10000 p join fx_bins x on x.chrom_idx = chrom1_idx and x.local_bin = bin1 join fx_bins y on y.chrom_idx = chrom2_idx and y.local_bin = bin2")
def jn7_apply_balance(spark, sf):
    return maps.apply_balance(pixels(spark, sf, 10000), view(spark, sf, "fx_bins")).select("sample", *maps.CELL, F.round("value", 6).alias("value"))


@query("select p.sample, chrom1_idx, bin1, bin2, count, round(expected, 6) as expected from fx_pixels_10000 p join (select dist, sum(balanced_sum) / sum(n_valid) as expected from fx_expected group by dist) e on e.dist = bin2 - bin1 where chrom1_idx = chrom2_idx")
def jn8_attach_expected(spark, sf):
    e = expected.expected_by_distance(view(spark, sf, "fx_expected"), []).select("dist", F.col("avg").alias("expected"))
    return maps.attach_expected(pixels(spark, sf, 10000), e).select("sample", "chrom1_idx", "bin1", "bin2", "count", F.round("expected", 6).alias("expected"))


@query("select sample as sample_id, 'clean' as clean_id, 'truth-' || sample as truth_id, case sample when 'test' then 'train' else 'test' end as split, count(*)::bigint as n from fx_pixels_10000 group by sample")
def jn9_attach_manifest(spark, sf):
    m = spark.createDataFrame([("test", "clean", "truth-test", "train"), ("clean", "clean", "truth-clean", "test")], "sample_id string, clean_id string, truth_id string, split string")
    return maps.attach_manifest(pixels(spark, sf, 10000).withColumnRenamed("sample", "sample_id"), m).groupBy(*m.columns).agg(F.count(F.lit(1)).alias("n"))


@query(f"select distinct chrom1_idx, chrom2_idx, bin1 as x, bin2 as y from fx_pixels_50000 where sample = 'clean' except select * from {DETECTIONS}")
def jn10_anti_existing(spark, sf):
    new = pixels(spark, sf, 50000).where("sample = 'clean'").select("chrom1_idx", "chrom2_idx", F.col("bin1").alias("x"), F.col("bin2").alias("y"))
    return sampling.anti_existing(new, detections(spark, sf), ["chrom1_idx", "chrom2_idx", "x", "y"])


@query("select id, case when x is not null then '++' end as label from (select l_orderkey * 10 + l_linenumber as id from lineitem) left join (select distinct l_orderkey * 10 + l_linenumber as x from lineitem where l_returnflag <> 'N') on x = id")
def jn6_attach_labels(spark, sf):
    from .plans.jobs import attach_labels

    det = view(spark, sf, "fx_points").select("id")
    classes = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_returnflag <> 'N'").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit("++").alias("label")).distinct()
    return attach_labels(det, classes, "id")


# --- aggregations ----------------------------------------------------------------------------------

N_BINS = "(select chrom_idx, length // 10000 + 1 as n from fx_chromsizes)"
EXPECTED = f"(select sample, chrom1_idx as chrom_idx, bin2 - bin1 as d, sum(count)::double / (any_value(n) - (bin2 - bin1)) as expected from fx_pixels_10000 join {N_BINS} b on b.chrom_idx = chrom1_idx where chrom1_idx = chrom2_idx group by sample, chrom1_idx, bin2 - bin1)"


def diagonals(spark, sf):
    n = chromsizes(spark, sf).select("chrom_idx", F.expr("length div 10000 + 1").alias("n"))
    return normalize.diagonal_expected(pixels(spark, sf, 10000), n)


@query(f"select sample, chrom_idx, d, round(expected, 6) as expected from {EXPECTED}")
def ag1_diagonal_expected(spark, sf):
    return diagonals(spark, sf).select("sample", "chrom_idx", "d", F.round("expected", 6).alias("expected"))


@query(f"select p.sample, chrom_idx, bin1, bin2, round(expected / count, 6) as ratio from fx_pixels_10000 p join {EXPECTED} e on e.sample = p.sample and chrom_idx = chrom1_idx and d = bin2 - bin1 where chrom1_idx = chrom2_idx")
def ag2_observed_expected(spark, sf):
    return normalize.observed_expected(pixels(spark, sf, 10000), diagonals(spark, sf)).select("sample", "chrom_idx", "bin1", "bin2", F.round("ratio", 6).alias("ratio"))


@query("select dist, round(sum(balanced_sum) / sum(n_valid), 6) as avg, round(ln(sum(balanced_sum) / sum(n_valid)), 6) as log_avg from fx_expected group by dist")
def ag3_expected_by_distance(spark, sf):
    e = expected.expected_by_distance(view(spark, sf, "fx_expected"), [])
    return e.select("dist", F.round("avg", 6).alias("avg"), F.round("log_avg", 6).alias("log_avg"))


@query("select sample, round(ln(sum(balanced_sum) / sum(n_valid)), 6) as log_avg from fx_expected group by sample")
def ag4_expected_trans(spark, sf):
    return expected.expected_trans(view(spark, sf, "fx_expected"), ["sample"]).select("sample", F.round("log_avg", 6).alias("log_avg"))


MINMAX = f"""select {KEY}, round(2 * (v - lo) / nullif(hi - lo, 0) - 1, 6) as scaled from (select *, ln(a / b) / ln(10) + 1e-6 as v from {BOTH.format(how="")})
join (select chrom1_idx, chrom2_idx, least(min(ln(a / b) / ln(10) + 1e-6), case when count(*) < any_value(x.n * y.n) then 0 else 1e9 end) as lo, greatest(max(ln(a / b) / ln(10) + 1e-6), case when count(*) < any_value(x.n * y.n) then 0 else -1e9 end) as hi
      from {BOTH.format(how="")} join {N_BINS} x on x.chrom_idx = chrom1_idx join {N_BINS} y on y.chrom_idx = chrom2_idx group by chrom1_idx, chrom2_idx) using (chrom1_idx, chrom2_idx)"""


@query(MINMAX)
def ag5_minmax_scale(spark, sf):
    n = chromsizes(spark, sf).select("chrom_idx", F.expr("length div 10000 + 1").alias("n"))
    n1, n2 = n.withColumnsRenamed({"chrom_idx": "chrom1_idx", "n": "n1"}), n.withColumnsRenamed({"chrom_idx": "chrom2_idx", "n": "n2"})
    v = pairs(spark, sf).withColumn("value", values.log_ratio_masked(F.col("a"), F.col("b"))).join(F.broadcast(n1), "chrom1_idx").join(F.broadcast(n2), "chrom2_idx").withColumn("cells", F.col("n1") * F.col("n2"))
    return normalize.minmax_scale(v, ["chrom1_idx", "chrom2_idx"], "cells").select(*maps.CELL, F.round("scaled", 6).alias("scaled"))


@query("select sample, chrom1_idx, min(count)::double as least, max(count)::double as most, round(avg(count), 6) as mean from fx_pixels_10000 group by sample, chrom1_idx")
def ag6_matrix_range(spark, sf):
    r = normalize.matrix_range(pixels(spark, sf, 10000).withColumn("value", F.col("count").cast("double")), ["sample", "chrom1_idx"])
    return r.select("sample", "chrom1_idx", "least", "most", F.round("mean", 6).alias("mean"))


SIGNAL = f"""(select patch_id, count(*) filter (where coalesce(a, 0) <> coalesce(b, 0)) / 64.0 as whole, count(*) filter (where coalesce(a, 0) <> coalesce(b, 0) and dx between 2 and 5 and dy between 2 and 5) / 16.0 as centre from
(select coalesce(t.patch_id, c.patch_id) as patch_id, coalesce(t.dx, c.dx) as dx, coalesce(t.dy, c.dy) as dy, t.value as a, c.value as b from {CUT} t full join {CUT.replace("sample = 'test' union", "sample = 'clean' union").replace("where sample = 'test' and (chrom1_idx <>", "where sample = 'clean' and (chrom1_idx <>")} c on t.patch_id = c.patch_id and t.dx = c.dx and t.dy = c.dy) group by patch_id)"""


def signal_pairs(spark, sf):
    w = detections(spark, sf).withColumn("patch_id", F.concat_ws("-", *(F.col(c).cast("string") for c in ("chrom1_idx", "chrom2_idx", "x", "y"))))
    w = windows.centre_to_corner(w, SIZE)
    clean = maps.symmetric(pixels(spark, sf, 10000).where("sample = 'clean'")).withColumn("value", F.col("count").cast("double"))
    a = windows.cut_windows(cells(spark, sf, 10000), w, SIZE).withColumnRenamed("value", "a")
    b = windows.cut_windows(clean, w, SIZE).withColumnRenamed("value", "b")
    return a.join(b, ["patch_id", "dx", "dy"], "full")


@query(f"select patch_id, whole::double as whole, centre::double as centre from {SIGNAL} where whole >= 0.2 and centre >= 0.4")
def fi8_signal(spark, sf):
    return calls.filter_signal(signal_pairs(spark, sf), SIZE, (2, 6))


@query(f"select patch_id, whole::double as whole, centre::double as centre from {SIGNAL}")
def ag7_nonzero_fraction(spark, sf):
    return calls.signal_measures(signal_pairs(spark, sf), SIZE, (2, 6), ["patch_id"])


VCF_SUMS = "(select chrom, pos // 5000 * 5000 as pos, sum(alt_len)::bigint as sv_len from fx_vcf group by chrom, pos // 5000)"


@query(f"select * from {VCF_SUMS}")
def ag8_vcf_bin_sums(spark, sf):
    return calls.vcf_bin_sums(view(spark, sf, "fx_vcf"))


@query(f"select patch_id, arg_max({{'dx': dx, 'dy': dy}}, value * 10000 - dx * 8 - dy).dx as dx, arg_max({{'dx': dx, 'dy': dy}}, value * 10000 - dx * 8 - dy).dy as dy, max(value) as most from {CUT} group by patch_id")
def ag9_patch_argmax(spark, sf):
    return cluster.patch_argmax(cut(spark, sf), ["patch_id"])


RECENTRE = f"""select patch_id, case when move then dx - 4 else 0 end as move_x, case when move then dy - 4 else 0 end as move_y from (select patch_id, mid is null or log2(most) - log2(mid) > floor(log2(most) / 4) as move, p.dx as dx, p.dy as dy from
(select patch_id, max(value) filter (where dx = 4 and dy = 4) as mid, max(value) as most, arg_max({{'dx': dx, 'dy': dy}}, value * 10000 - dx * 8 - dy) as p from {CUT} group by patch_id))"""


@query(RECENTRE)
def ag10_recentre(spark, sf):
    return cluster.recentre(cut(spark, sf), SIZE, ["patch_id"])


@query("select chrom1_idx, chrom2_idx, b.bin1 as x, b.bin2 as y, c as score from (select chrom1_idx, chrom2_idx, arg_max({'bin1': bin1, 'bin2': bin2}, [count, -bin1, -bin2]) as b, max(count) as c from fx_pixels_10000 where sample = 'test' group by chrom1_idx, chrom2_idx)")
def ag11_best_in_group(spark, sf):
    d = pixels(spark, sf, 10000).where("sample = 'test'").select("chrom1_idx", "chrom2_idx", F.col("bin1").alias("x"), F.col("bin2").alias("y"), F.col("count").alias("score"))
    return cluster.best_in_group(d, ["chrom1_idx", "chrom2_idx"])


def predictions(spark, sf):
    return view(spark, sf, "fx_predictions")


@query("select count(*) filter (where y_true = 1 and y_pred = 1) as tp, count(*) filter (where y_true = 0 and y_pred = 0) as tn, count(*) filter (where y_true = 0 and y_pred = 1) as fp, count(*) filter (where y_true = 1 and y_pred = 0) as fn, round(avg((y_true = y_pred)::int), 6) as accuracy from fx_predictions")
def ag12_confusion(spark, sf):
    return evaluate.confusion(predictions(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


@query("select round(avg(1.25 * hit / (0.25 * r + s)), 6) as macro_f from (select k, count(*) filter (where y_class = k) as r, count(*) filter (where p_class = k) as s, count(*) filter (where y_class = k and p_class = k) as hit from fx_predictions, (select distinct unnest([y_class, p_class]) as k from fx_predictions) group by k)")
def ag13_macro_scores(spark, sf):
    p = predictions(spark, sf).select(F.col("y_class").cast("long").alias("y_true"), F.col("p_class").alias("y_pred"))
    return evaluate.macro_scores(p, 0.5).withColumn("macro_f", F.round("macro_f", 6))


@query("select tp::bigint as tp, fn::bigint as fn, round(p, 6) as precision, round(r, 6) as recall, round(2 * p * r / nullif(p + r, 0), 6) as f1 from (select *, tp / nullif(2 * n, 0) as p, tp / nullif(tp + fn, 0) as r from (select tp, n, 2 * m - tp as fn from (" + WITH_MATCHED.format(what="sum(found_x::int + found_y::int) as tp, count(*) as n") + f") cross join (select count(*) as m from {ANSWERS})))")
def ag14_call_scores(spark, sf):
    r, a = bins5(spark, sf)
    out = evaluate.call_scores(evaluate.match_calls(r, a, tol=1, crossed=False), a)
    return out.select("tp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


#: The same list of results and answers, each answer met by one result at most: runs of near positions, swept once each.
ONE_TO_ONE = f"""select tp::bigint as tp, fn::bigint as fn, round(p, 6) as precision, round(r, 6) as recall, round(2 * p * r / nullif(p + r, 0), 6) as f1 from (select *, tp / nullif(2 * n, 0) as p, tp / nullif(tp + fn, 0) as r from (
with recursive pts as (select 'x' as side, bp_1 as x, 0 as kind from {BINS5} union all select 'y', bp_2, 0 from {BINS5} union all select 'x', bp_1, 1 from {ANSWERS} union all select 'y', bp_2, 1 from {ANSWERS}),
runs as (select *, sum(cut) over (partition by side order by x) as run from (select *, case when x - lag(x) over (partition by side order by x) <= 1 then 0 else 1 end as cut from pts)),
lists as (select side, run, list(x order by x) filter (where kind = 0) as a, list(x order by x) filter (where kind = 1) as b from runs group by side, run having count(*) filter (where kind = 0) > 0 and count(*) filter (where kind = 1) > 0),
sweep as (select a, b, 1 as i, 1 as j, 0 as hit from lists union all
  select a, b, i + (abs(a[i] - b[j]) <= 1 or a[i] < b[j])::int, j + (abs(a[i] - b[j]) <= 1 or a[i] > b[j])::int, (abs(a[i] - b[j]) <= 1)::int from sweep where i <= len(a) and j <= len(b))
select tp, n, 2 * m - tp as fn from (select coalesce(sum(hit), 0) as tp from sweep), (select count(*) as n from {BINS5}), (select count(*) as m from {ANSWERS})))"""


@query(ONE_TO_ONE)
def ag14_one_to_one(spark, sf):
    r, a = bins5(spark, sf)
    out = evaluate.call_scores(evaluate.matched_one_to_one(r, a, tol=1, crossed=False), a)
    return out.select("tp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("select round(avg(-case when y_true = 1 then ln(p) else ln(1 - p) end), 6) as loss from (select y_true, greatest(1e-7, least(1 - 1e-7, score)) as p from fx_predictions)")
def ag15_log_loss(spark, sf):
    return evaluate.log_loss(predictions(spark, sf)).withColumn("loss", F.round("loss", 6))


@query("select chrom1, pos1 from fx_wide group by chrom1, pos1 having count(*) = 1")
def ag16_drop_all_duplicates(spark, sf):
    return calls.drop_all_duplicates(wide(spark, sf).select("chrom1", "pos1"))


@query("select g as patch_id, list_transform(s, lambda v: round(v, 6)) as scores from (select g, list(v order by i) as s from (select vec_id // 4 as g, i, avg(embedding[i]::double) as v from embeddings, range(1, 65) t(i) group by vec_id // 4, i) group by g)")
def ag17_ensemble_average(spark, sf):
    e = patches(spark, sf).select(F.expr("patch_id div 4").alias("patch_id"), F.col("values").alias("scores"))
    return scoring.ensemble_average(e).select("patch_id", F.transform("scores", lambda x: values.rounded(x, 6)).alias("scores"))


@query("select (i - 1)::int as i, (j - 1)::int as j, round(corr(embedding[i]::double, embedding[j]::double), 6) as corr from embeddings, range(1, 65) a(i), range(1, 65) b(j) where i <= j group by i, j")
def ag18_feature_correlation(spark, sf):
    return evaluate.full_feature_correlation(patches(spark, sf)).withColumn("corr", F.round("corr", 6))


@query("select chr, count(*) as n_calls, count(distinct label) as n_labels from fx_calls group by chr")
def ag19_sample_counts(spark, sf):
    return evaluate.sample_counts(fx_calls(spark, sf), ["chr"])


@query("select bucket::bigint as bucket, count(*) as n from (select case when v < 0.1 then 0 when v >= 0.9 then 9 else floor((v - 0.1) / ((0.9 - 0.1) / 8)) + 1 end as bucket from (select score as v from fx_predictions)) group by bucket")
def ag20_value_histogram(spark, sf):
    return evaluate.value_histogram(predictions(spark, sf).withColumnRenamed("score", "value"), 0.1, 0.9, 8)


# --- windows and clustering ------------------------------------------------------------------------

CHAIN = f"(select *, sum(cut) over (partition by chrom1_idx, chrom2_idx order by x + y, x, y) as chain from (select *, case when {{apart}} then 1 else 0 end as cut from (select *, (x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2 as g from {DETECTIONS} window w as (partition by chrom1_idx, chrom2_idx order by x + y, x, y))))"
WN1 = f"""select chrom1_idx, chrom2_idx, chain::bigint as chain, least(a.x, b.x) - 1 as x0, least(a.y, b.y) - 1 as y0, abs(b.x - a.x) + 2 as width, abs(b.y - a.y) + 2 as height, n as members from
(select chrom1_idx, chrom2_idx, chain, arg_min({{{{'x': x, 'y': y}}}}, [x + y, x, y]) as a, arg_max({{{{'x': x, 'y': y}}}}, [x + y, x, y]) as b, count(*) as n from {CHAIN.format(apart="g > 8")} group by chrom1_idx, chrom2_idx, chain)""".replace("{{", "{").replace("}}", "}")


@query(WN1)
def wn1_chain_groups(spark, sf):
    return cluster.chain_groups(detections(spark, sf), 2, ["chrom1_idx", "chrom2_idx"])


WN2 = f"""select chrom_idx, x from (with recursive p as (select distinct chrom_idx, x from (select chrom1_idx as chrom_idx, bin1 as x from fx_pixels_10000 where sample = 'test')),
t as (select chrom_idx, min(x) as x from p group by chrom_idx union all select t.chrom_idx, (select min(p.x) from p where p.chrom_idx = t.chrom_idx and p.x - 4 > t.x) from t where t.x is not null)
select * from t where x is not null)"""


@query(WN2)
def wn2_thin_anchors(spark, sf):
    p = pixels(spark, sf, 10000).where("sample = 'test'").select(F.col("chrom1_idx").alias("chrom_idx"), F.col("bin1").alias("x"))
    return cluster.thin_anchors(p, SIZE, ["chrom_idx"])


WN3 = f"""select chrom, s as start, e as "end", e - s as sv_len from (select chrom, c, min(pos) as s, max(pos + sv_len) as e from (
select *, sum(case when reach + 4500 >= pos then 0 else 1 end) over (partition by chrom order by pos) as c from (
select *, max(pos + sv_len) over (partition by chrom order by pos rows between unbounded preceding and 1 preceding) as reach from {VCF_SUMS})) group by chrom, c) where e - s > 600"""


@query(WN3)
def wn3_merge_vcf(spark, sf):
    return calls.merge_vcf(calls.vcf_bin_sums(view(spark, sf, "fx_vcf")), 4500, 600)


@query(f"select chrom1_idx, chrom2_idx, chain::bigint as chain, (sum(x) // count(*))::bigint as x, (sum(y) // count(*))::bigint as y, count(*) as members from {CHAIN.format(apart='g >= 9')} group by chrom1_idx, chrom2_idx, chain")
def wn4_merge_near_points(spark, sf):
    return cluster.merge_near_points(detections(spark, sf), 3, ["chrom1_idx", "chrom2_idx"])


CURVE = "(select sample, dist, ln(sum(balanced_sum) / sum(n_valid)) as v from fx_expected group by sample, dist)"


def curve(spark, sf):
    return expected.expected_by_distance(view(spark, sf, "fx_expected"), ["sample"])


@query(f"select sample, dist, round(min(v) over (partition by sample order by dist), 6) as log_avg from {CURVE}")
def wn5_running_min(spark, sf):
    return expected.running_min(curve(spark, sf), ["sample"]).select("sample", "dist", F.round("log_avg", 6).alias("log_avg"))


@query(f"select sample, dist, round(v, 6) as log_avg from (select *, max((v <= 0)::int) over (partition by sample order by dist) as bad from {CURVE}) where bad = 0")
def wn6_truncate(spark, sf):
    c = curve(spark, sf).withColumn("log_avg", F.when(F.col("log_avg") > 0, F.col("log_avg")))
    return expected.truncate_at_first_bad(c, ["sample"]).select("sample", "dist", F.round("log_avg", 6).alias("log_avg"))


def smooth_sql(head: int = 8, near: int = 40, fracs: tuple[float, float] = (0.1, 0.3)) -> str:
    """Lines through the nearest points of each, by tricube weights, over the logarithm of the distance; the first few points as they are."""

    def fitted(frac: float) -> str:
        k = f"least(m, greatest(2, ceil({frac}::double * m)))"
        met = f"select a.sample, a.i, a.x as x0, b.x, b.y, abs(b.x - a.x) as d from t a join t b using (sample) qualify row_number() over (partition by a.sample, a.i order by abs(b.x - a.x), b.x) <= (select {k} from (select count(*) as m from t z where z.sample = a.sample))"
        weighed = f"select *, power(1 - power(least(d / greatest(max(d) over (partition by sample, i), 1e-12), 1), 3), 3) + 1e-12 as w from ({met})"
        means = f"select *, sum(w * x) over p / sum(w) over p as mx, sum(w * y) over p / sum(w) over p as my from ({weighed}) window p as (partition by sample, i)"
        line = f"select sample, i, any_value(my) as my, any_value(x0 - mx) as dx, sum(w * (x - mx) ** 2) / sum(w) as var, sum(w * (x - mx) * (y - my)) / sum(w) as cov from ({means}) group by sample, i"
        return f"(select sample, i, my + case when var > 1e-12 then cov / var * dx else 0 end as v from ({line}))"

    return f"""(with c as (select sample, dist, v as y, ln(dist + 1) as x, row_number() over (partition by sample order by dist) - 1 as i from {CURVE} where v is not null),
t as (select * from c where i >= {head})
select c.sample, c.dist, case when c.i < {head} then c.y when c.i < {near} then f.v else g.v end as smooth from c left join {fitted(fracs[0])} f on f.sample = c.sample and f.i = c.i left join {fitted(fracs[1])} g on g.sample = c.sample and g.i = c.i)"""


@query(f"select sample, dist, round(smooth, 6) as smooth from {smooth_sql()}")
def wn7_smooth_expected(spark, sf):
    return expected.smooth_expected(curve(spark, sf), ["sample"], head=8, near=40, near_frac=0.1, far_frac=0.3).withColumn("smooth", F.round("smooth", 6))


# --- set operations --------------------------------------------------------------------------------


@query("select call_id, chr, label <> 'negative' as is_sv from fx_calls")
def st1_union_samples(spark, sf):
    c = fx_calls(spark, sf).select("call_id", "chr", "label")
    return sampling.union_samples(c.where("label <> 'negative'"), c.where("label = 'negative'")).drop("label")


@query("select distinct chrom1_idx, chrom2_idx, bin1 as x, bin2 as y from fx_pixels_50000")
def st2_distinct_coords(spark, sf):
    return windows.distinct_coords(pixels(spark, sf, 50000).select("chrom1_idx", "chrom2_idx", F.col("bin1").alias("x"), F.col("bin2").alias("y")))


# --- patches ---------------------------------------------------------------------------------------

GENOME_CELLS = "(select sample, ((bin1 * 10000 + o.start) // 10000)::bigint as g1, ((bin2 * 10000 + q.start) // 10000)::bigint as g2, count from fx_pixels_10000 p join fx_offsets o on o.chrom_idx = p.chrom1_idx join fx_offsets q on q.chrom_idx = p.chrom2_idx)"
N_GENOME = "(select (max(stop) // 10000)::bigint from fx_offsets)"
DIAGONAL = f"select sample, g1, g2, count, i as \"window\", least(i * 4, {N_GENOME} - 8) as start from {GENOME_CELLS} c, range(0, (select {N_GENOME} // 4)) w(i) where least(i * 4, {N_GENOME} - 8) <= g1 and g2 < least(i * 4, {N_GENOME} - 8) + 8"


def genome_cells(spark, sf):
    """Cells by genome bins, low before high."""
    c = coords.chrom_to_genome_pair(pixels(spark, sf, 10000), chromsizes(spark, sf), 10000, "bin1", "bin2")
    return c.select("sample", F.col("genome_x").alias("g1"), F.col("genome_y").alias("g2"), "count")


@query(DIAGONAL)
def pa1_diagonal_windows(spark, sf):
    n = sampling.genome_length(chromsizes(spark, sf)) // 10000
    return windows.diagonal_windows(genome_cells(spark, sf), n, SIZE, STEP, "g1", "g2")


@query("select chrom_idx, x, y from (select chrom_idx, length // 50000 - 8 as most from fx_chromsizes), lateral (select unnest(range(0, most + 1, 4)) as x), lateral (select unnest(range(x, most + 1, 4)) as y)")
def pa2_full_map_windows(spark, sf):
    return windows.full_map_windows(chromsizes(spark, sf), 50000, SIZE, STEP)


DENSE = f"(select patch_id, list_transform(range(0, 64), lambda i: coalesce(m[i], 0.0)) as a from (select patch_id, map(list(dx * 8 + dy), list(value)) as m from {CUT} group by patch_id))"


@query(f"select patch_id, a as values from {DENSE}")
def pa4_densify(spark, sf):
    return scoring.densify(cut(spark, sf), SIZE)


@query("select chrom1_idx, x * 5 + s as sub_start, s as sub from (select distinct chrom1_idx, bin1 as x from fx_pixels_50000 where sample = 'test'), range(0, 7, 4) t(s)")
def pa5_sub_windows(spark, sf):
    w = pixels(spark, sf, 50000).where("sample = 'test'").select("chrom1_idx", F.col("bin1").alias("start")).distinct()
    return windows.sub_windows(w, 16, SIZE, STEP, 5).select("chrom1_idx", F.col("sub_start"), F.col("sub").cast("long").alias("sub"))


SQL["pa5_sub_windows"] = SQL["pa5_sub_windows"].replace("range(0, 7, 4)", "range(0, 8, 4)")


@query(f"select distinct chrom1_idx, chrom2_idx, (x - 4 + i) * 5 as x, (y - 4 + j) * 5 as y from {DETECTIONS}, range(0, 8, 2) a(i), range(0, 8, 2) b(j)")
def pa6_refine_grid(spark, sf):
    return windows.refine_grid(detections(spark, sf), 8, 50000, 10, 10000)


BOXES = f"(select chrom1_idx || '-' || chrom2_idx || '-' || chain as box_id, * from ({WN1.replace('- 1 as', '- 5 as').replace('+ 2 as', '+ 10 as')}))"


def boxes(spark, sf):
    b = cluster.chain_groups(detections(spark, sf), 2, ["chrom1_idx", "chrom2_idx"])
    b = b.withColumns({"x0": F.col("x0") - 4, "y0": F.col("y0") - 4, "width": F.col("width") + 8, "height": F.col("height") + 8})
    return b.withColumn("box_id", F.concat_ws("-", *(F.col(c).cast("string") for c in ("chrom1_idx", "chrom2_idx", "chain"))))


@query(f"select box_id, x0 + i as x, y0 + j as y, x0 + i + 4 as cx, y0 + j + 4 as cy from {BOXES}, lateral (select unnest(range(0, width - 7)) as i), lateral (select unnest(range(0, height - 7)) as j)")
def pa7_box_windows(spark, sf):
    return windows.box_windows(boxes(spark, sf), SIZE)


@query(f"select box_id, bin1, bin2, value from {BOXES} b join {TEST_CELLS.format(res=50000)} c on c.chrom1_idx = b.chrom1_idx and c.chrom2_idx = b.chrom2_idx and bin1 >= x0 and bin1 < x0 + width and bin2 >= y0 and bin2 < y0 + height")
def pa8_box_cells(spark, sf):
    return windows.box_cells(cells(spark, sf, 50000), boxes(spark, sf))


@query(f"select patch_id, dx, dy, round(log2(value + 1), 6) as value from {CUT}")
def pa9_centre_windows(spark, sf):
    return cut(spark, sf).select("patch_id", "dx", "dy", F.round(values.log_value(F.col("value"), 2, 1), 6).alias("value"))


@query("select call_id, least(s + greatest(0, 4 - least(s, e)), n - 5) as x, least(e + greatest(0, 4 - least(s, e)), n - 5) as y from (select call_id, start // 10000 as s, end_ // 10000 as e, length // 10000 + 1 as n from fx_calls c join fx_chromsizes z on z.chrom_idx = c.chrom_idx)")
def pa10_clamp_to_map(spark, sf):
    n = chromsizes(spark, sf).select("chrom_idx", F.expr("length div 10000 + 1").alias("n"))
    c = fx_calls(spark, sf).join(F.broadcast(n), "chrom_idx")
    return c.select("call_id", windows.clamp_to_map(floor_div(F.col("start"), 10000), floor_div(F.col("end"), 10000), 4, F.col("n")).alias("p")).select("call_id", "p.*")


REFLECT = "(case when {v} < 0 then -{v} when {v} > 7 then 14 - {v} else {v} end)"
BLUR = f"select patch_id, list(round(v, 5) order by i, j) as blurred from (select vec_id as patch_id, i, j, sum(w[di + 2] * w[dj + 2] * embedding[({REFLECT.format(v='(i + di)')} * 8 + {REFLECT.format(v='(j + dj)')} + 1)::int]::double) as v from embeddings, (select [{', '.join(map(str, scoring.GAUSS3))}] as w), range(0, 8) a(i), range(0, 8) b(j), range(-1, 2) c(di), range(-1, 2) d(dj) group by vec_id, i, j) group by patch_id"


@query(BLUR)
def pa11_gaussian_blur3(spark, sf):
    return scoring.gaussian_blur3(patches(spark, sf), SIZE).select("patch_id", F.transform("blurred", lambda x: values.rounded(x, 5)).alias("blurred"))


@query("select sample, chrom1_idx, bin1, bin2, round(ln(count + 1e-6 + 0.01) - ln(expected + 0.01), 6) as normalised from fx_pixels_10000 p join (select dist, sum(balanced_sum) / sum(n_valid) as expected from fx_expected group by dist) e on e.dist = bin2 - bin1 where chrom1_idx = chrom2_idx")
def pa12_normalise_by_expected(spark, sf):
    e = expected.expected_by_distance(view(spark, sf, "fx_expected"), []).select("dist", F.col("avg").alias("expected"))
    c = maps.attach_expected(pixels(spark, sf, 10000), e).withColumns({"value": F.col("count").cast("double"), "norm": F.col("expected"), "eps": F.lit(0.01)})
    return normalize.normalise_by_expected(c).select("sample", "chrom1_idx", "bin1", "bin2", F.round("normalised", 6).alias("normalised"))


@query(f"select patch_id, dx // 2 as bx, dy // 2 as by, round(avg(value), 6) as mean from {CUT} group by patch_id, dx // 2, dy // 2")
def pa13_block_mean(spark, sf):
    return normalize.block_mean(cut(spark, sf), 2, ["patch_id"]).withColumn("mean", F.round("mean", 6))


@query("select call_id, which::int as which, case which when 0 then start else end_ end as x, case which when 0 then start else end_ end as y from fx_calls, range(0, 2) t(which)")
def pa14_endpoint_windows(spark, sf):
    return windows.endpoint_windows(fx_calls(spark, sf).select("call_id", "start", "end")).select("call_id", "which", "x", "y")


# --- sampling --------------------------------------------------------------------------------------

LCG = "((((call_id % 2147483647) * 1103515245 + 12345 * {k} + {s}) % 2147483647))"


def negatives_sql(size: int) -> str:
    """One negative for each call, clear of its chromosome's ends by half a window of 10-kb bins."""
    pad, wide = size // 2 * 10000, size * 10000
    start = f"{pad} + {LCG.format(k=2, s=7)} % (length - {2 * pad})"
    return f"""select call_id, chrom_idx, {start} as start, {start} + {wide} + {LCG.format(k=3, s=7)} % {9 * wide + 1} as "end", 'negative' as label
from (select call_id, {LCG.format(k=1, s=7)} % (select count(*) from fx_chromsizes where length > {2 * pad + 1}) as n from fx_calls) c
join (select chrom_idx, length, row_number() over (order by chrom_idx) - 1 as n from fx_chromsizes where length > {2 * pad + 1}) z using (n)"""


SA1 = negatives_sql(SIZE)


@query(SA1)
def sa1_negatives_per_call(spark, sf):
    return sampling.negatives_per_call(fx_calls(spark, sf), chromsizes(spark, sf), SIZE, 10000)


@query(f"select call_id, {LCG.format(k=1, s=11)} % g as bp_1, {LCG.format(k=2, s=11)} % g as bp_2 from fx_calls, (select sum(length)::bigint as g from fx_chromsizes)")
def sa2_negatives_genome(spark, sf):
    return sampling.negatives_genome(fx_calls(spark, sf), sampling.genome_length(chromsizes(spark, sf)))


@query(f"select call_id, start - 2 + {LCG.format(k=1, s=3)} % 5 as x, end_ - 2 + {LCG.format(k=2, s=3)} % 5 as y from fx_calls")
def sa3_jitter(spark, sf):
    return sampling.jitter(fx_calls(spark, sf).select("call_id", F.col("start").alias("x"), F.col("end").alias("y")), 4)


SA4 = """select chrom_idx, x from (select chrom_idx, x, take, row_number() over (partition by chrom_idx order by (x * 1103515245 + 12345 + 5) % 2147483647, x) as r from (
select chrom_idx, n, greatest(0, least(most, 40 - coalesce(sum(most) over (order by chrom_idx rows between unbounded preceding and 1 preceding), 0))) as take from (
select chrom_idx, length // 5000 as n, length // 5000 // 10 as most from fx_chromsizes)), lateral (select unnest(range(0, n)) as x)) where r <= take"""


@query(SA4)
def sa4_diagonal_negatives(spark, sf):
    return sampling.diagonal_negatives(chromsizes(spark, sf), 5000, 40)


@query(f"select call_id, case when {LCG.format(k=1, s=1)} % 100 < 80 then 'train' else 'test' end as split from fx_calls")
def sa5_split(spark, sf):
    return sampling.split(fx_calls(spark, sf).select("call_id"), "call_id")


# --- scoring ---------------------------------------------------------------------------------------

MEAN = "list_sum({a}) / len({a})"
CENTRE = "list_sum(list_transform([2, 3, 4, 5], lambda i: list_sum({a}[i * 8 + 3:i * 8 + 6]))) / 16"


@query(f"select vec_id as patch_id, round(1 / (1 + exp(-(({CENTRE.format(a='e')}) - ({MEAN.format(a='e')})))), 6) as score from (select vec_id, embedding::double[] as e from embeddings)")
def ud1_score_patches(spark, sf):
    return scoring.score_patches(patches(spark, sf), scoring.contrast, SIZE).select("patch_id", F.round("score", 6).alias("score"))


@query("select vec_id as patch_id, (list_position(e, list_max(e)) - 1)::int as class_idx from (select vec_id, list_transform(range(0, 8), lambda k: list_sum(embedding[k * 8 + 1:k * 8 + 8]::double[])) as e from embeddings)")
def ud2_classify_patches(spark, sf):
    return scoring.classify_patches(patches(spark, sf), _row_sums, SIZE).select("patch_id", "class_idx")


def _row_sums(stack):
    return stack.sum(axis=2)


CONTRAST = f"""select patch_id, round(1 / (1 + exp(-2 * (m / 16 - s / 64) / nullif(hi - lo, 0))), 6) as score from (select patch_id, sum(value) as s, coalesce(sum(value) filter (where dx between 2 and 5 and dy between 2 and 5), 0) as m,
least(min(value), case when count(*) < 64 then 0 else 1e9 end) as lo, greatest(max(value), case when count(*) < 64 then 0 else -1e9 end) as hi from {CUT} group by patch_id)"""


@query(CONTRAST)
def ud4_contrast_scorer(spark, sf):
    return scoring.contrast_of_windows(cut(spark, sf), SIZE, 4, ("patch_id",)).withColumn("score", F.round("score", 6))


# --- more of joins, order, sets and patches ---------------------------------------------------------


@query(f"select id, o.chrom_idx, x * 1000 - o.start as pos from fx_points join fx_offsets o on x * 1000 >= o.start and x * 1000 < o.stop")
def jn2_point_in_interval(spark, sf):
    p = view(spark, sf, "fx_points").select("id", (F.col("x") * 1000).alias("bp"))
    return coords.bp_to_chrom_exclusive(p, chromsizes(spark, sf), {"bp": ("chrom", "pos")}).join(chromsizes(spark, sf), "chrom").select("id", "chrom_idx", "pos")


@query(f"select chrom1_idx, chrom2_idx, x, y, row_number() over (order by chrom1_idx, chrom2_idx, x, y) - 1 as place from {DETECTIONS}")
def wn8_order_detections(spark, sf):
    return cluster.order_detections(detections(spark, sf).distinct())


@query("select r as resolution, r in (10000, 5000) as available from (values (50000), (10000), (5000)) t(r) where exists (select 1 from fx_pixels_10000) and exists (select 1 from fx_pixels_5000)")
def st3_required_resolutions(spark, sf):
    p = pixels(spark, sf, 10000).withColumn("resolution", F.lit(10000)).unionByName(pixels(spark, sf, 5000).withColumn("resolution", F.lit(5000)))
    return maps.available_resolutions(p, [50000, 10000, 5000])


WIDE_CUT = CUT.replace("from " + WINDOWS, "from " + WINDOWS.replace("x - 4", "x - 24").replace("y - 4", "y - 24")).replace("x + 8", "x + 48").replace("y + 8", "y + 48")


@query(f"select patch_id, 2304 as n, sum(value) as total, sum(value * (dx * 48 + dy)) as moment from {WIDE_CUT} group by patch_id")
def pa4_densify_48(spark, sf):
    """Windows of the full 48 bins; where the values stand is told by the sum of value times place."""
    w = detections(spark, sf).distinct().withColumn("patch_id", F.concat_ws("-", *(F.col(c).cast("string") for c in ("chrom1_idx", "chrom2_idx", "x", "y"))))
    dense = scoring.densify(windows.cut_windows(cells(spark, sf, 10000), windows.centre_to_corner(w, 48), 48), 48)
    add = lambda a, x: a + x
    total, moment = F.aggregate("values", F.lit(0.0), add), F.aggregate(F.transform("values", lambda v, i: v * i), F.lit(0.0), add)
    return dense.select("patch_id", F.size("values").alias("n"), total.alias("total"), moment.alias("moment"))


def _fixed_weights():
    """Weights that follow from a formula, for a small ensemble: two blocks of one layer of two channels, and one dense layer."""
    import numpy as np

    blocks = [[("conv", np.sin(np.arange(18.0) + b).reshape(2, 1, 3, 3), np.array([0.1, -0.1])), ("norm", np.ones(2), np.zeros(2)), ("relu",), ("pool",)] for b in range(2)]
    return scoring.ConvScorer(blocks, [(np.cos(np.arange(64.0)).reshape(1, 64) / 16, np.array([0.2]))])


def _network_sql() -> str:
    """The same network in SQL: convolutions at each place of a padded patch, largest values of two by two, and a weighted sum."""
    at = lambda i, j: f"coalesce(case when r + {i} between 0 and 7 and c + {j} between 0 and 7 then v[(r + {i}) * 8 + c + {j} + 1]::double end, 0)"
    around = ", ".join(at(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1))
    return f"""select vec_id as patch_id, round(1 / (1 + exp(-(sum(most * cos(b * 32 + o * 16 + k)) / 16 + 0.2))), 6) as score from (
select vec_id, b, o, (r // 2) * 4 + c // 2 as k, max(greatest(0, s)) as most from (
select vec_id, b, o, r, c, list_sum(list_transform(range(0, 9), lambda i: near[i + 1] * sin(o * 9 + i + b))) + case o when 0 then 0.1 else -0.1 end as s from (
select vec_id, r, c, [{around}] as near from (select vec_id, embedding as v, unnest(range(0, 64)) // 8 as r, unnest(range(0, 64)) % 8 as c from embeddings)), range(0, 2) x(b), range(0, 2) y(o))
group by vec_id, b, o, k) group by vec_id"""


@query(_network_sql())
def ud3_conv_scorer(spark, sf):
    """Weights go to a file and come back from it, as those of a user do, and are sent to the executors once."""
    import os
    import tempfile

    path = os.path.join(tempfile.mkdtemp(), "weights.npz")
    _fixed_weights().save(path)
    return scoring.score_patches(patches(spark, sf), scoring.ConvScorer.load(path).shared(spark), SIZE).select("patch_id", F.round("score", 6).alias("score"))


@query()
def pa15_adaptive_coarsegrain(spark, sf):
    """Balanced values with the raw counts of the same windows."""
    w = detections(spark, sf).distinct().withColumn("patch_id", F.concat_ws("-", *(F.col(c).cast("string") for c in ("chrom1_idx", "chrom2_idx", "x", "y"))))
    corner = windows.centre_to_corner(w, SIZE)
    raw = pixels(spark, sf, 10000).where("sample = 'test'")
    balanced = maps.apply_balance(raw, view(spark, sf, "fx_bins")).select(*maps.CELL, F.col("value"))
    dense = lambda c, name: scoring.densify(windows.cut_windows(maps.symmetric(c), corner, SIZE), SIZE).withColumnRenamed("values", name)
    both = dense(raw.select(*maps.CELL, F.col("count").cast("double").alias("value")), "counts").join(dense(balanced, "values"), "patch_id")
    return expected.adaptive_coarsegrain(both, SIZE).select("patch_id", F.transform("coarse", lambda x: F.round(x, 6)).alias("coarse"))


from .plans import queries as _plans  # noqa: E402, F401  registers the jobs
