"""The registered queries of the jobs."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import queries as Q
from ..fixtures import cells, chromsizes, pixels, view
from ..functions.common import scratch
from ..operators import maps, scoring, windows
from ..queries import query
from ..sources.readers import read_sv_calls
from ..sources.writers import write_calls
from . import jobs

SLICE = f"""select w as "window", o.chrom_idx, case when o.chrom_idx = 0 then x else (x * 10000 - o.start) // 10000 end::bigint as local_bin, score from (
select w, start + 4 as x, round(1 / (1 + exp(-2 * (m / 16 - s / 64) / nullif(hi - lo, 0))), 6) as score from (
select w, start, sum(v) as s, coalesce(sum(v) filter (where dx between 2 and 5 and dy between 2 and 5), 0) as m, least(min(v), case when count(*) < 64 then 0 else 1e9 end) as lo, greatest(max(v), case when count(*) < 64 then 0 else -1e9 end) as hi from (
with gc as (select sample, least(g1, g2) as g1, greatest(g1, g2) as g2, sum(count) as c from {Q.GENOME_CELLS} group by 1, 2, 3),
p as (select g1, g2, log10(t.c) - log10(k.c) + 1e-6 as v from (select * from gc where sample = 'test') t join (select * from gc where sample = 'clean') k using (g1, g2) where g2 - g1 < 8),
d as (select i as w, least(i * 4, {Q.N_GENOME} - 8) as start, g1, g2, v from p, range(0, (select {Q.N_GENOME} // 4)) z(i) where least(i * 4, {Q.N_GENOME} - 8) <= g1 and g2 < least(i * 4, {Q.N_GENOME} - 8) + 8)
select w, start, g1 - start as dx, g2 - start as dy, v from d union all select w, start, g2 - start, g1 - start, v from d where g1 <> g2)
group by w, start)) join fx_offsets o on x * 10000 <= o.stop and (x * 10000 > o.start or o.chrom_idx = 0) where score > 0.5"""


PIXELS = "(select sample, ca as chrom1_idx, pa // {res} as bin1, cb as chrom2_idx, pb // {res} as bin2, count(*) as count from fx_sides group by all)"
SCANS = (50000, 25000, 10000)


def _scan(res: int) -> str:
    """SLICE for another resolution, a quarter of a window at a time."""
    quarter = SLICE.replace("i * 4", "i * 2").replace("// 4)", "// 2)").replace("fx_pixels_10000", PIXELS.format(res="{res}"))
    return quarter.replace("10000", str(res)).replace("{res}", str(res))


def _scanned(spark, sf) -> dict[int, DataFrame]:
    """The maps of a scan; 25 kb is made from 5 kb."""
    return {res: maps.coarsen(pixels(spark, sf, 5000), 5) if res == 25000 else pixels(spark, sf, res) for res in SCANS}


@query(" union all ".join(f"select {res} as resolution, * from ({_scan(res)})" for res in SCANS))
def job2_scan_resolutions(spark, sf):
    found = jobs.scan_resolutions(_scanned(spark, sf), chromsizes(spark, sf), 8)
    return found.withColumn("score", F.round("score", 6)).where("score > 0.5")


def _scored_scan(res: int, size: int = 48) -> str:
    """Contrasts of all windows of a scan by quarters, on log-ratios with pseudocounts, each scaled by itself."""
    n, step, mid, places = Q.N_GENOME, size // 4, size // 2, size * size
    start = f"least(i * {step}, {n} - {size})"
    out = f"""select w as "window", o.chrom_idx, case when o.chrom_idx = 0 then x else (x * 10000 - o.start) // 10000 end::bigint as local_bin, round(raw, 6) as score from (
select w, start + {mid} as x, 1 / (1 + exp(-2 * (m / 16 - s / {places}) / nullif(hi - lo, 0))) as raw from (
select w, start, sum(v) as s, coalesce(sum(v) filter (where dx between {mid - 2} and {mid + 1} and dy between {mid - 2} and {mid + 1}), 0) as m, least(min(v), case when count(*) < {places} then 0 else 1e9 end) as lo, greatest(max(v), case when count(*) < {places} then 0 else -1e9 end) as hi from (
with gc as (select sample, least(g1, g2) as g1, greatest(g1, g2) as g2, sum(count) as c from {Q.GENOME_CELLS} group by 1, 2, 3),
p as (select g1, g2, log10(coalesce(t.c, 0) + 1e-6) - log10(coalesce(k.c, 0) + 1e-6) as v from (select * from gc where sample = 'test') t full join (select * from gc where sample = 'clean') k using (g1, g2) where g2 - g1 < {size}),
d as (select i as w, {start} as start, g1, g2, v from p, range(0, (select {n} // {step})) z(i) where {n} >= {size} and {start} <= g1 and g2 < {start} + {size})
select w, start, g1 - start as dx, g2 - start as dy, v from d union all select w, start, g2 - start, g1 - start, v from d where g1 <> g2)
group by w, start)) join fx_offsets o on x * 10000 <= o.stop and (x * 10000 > o.start or o.chrom_idx = 0) where raw > 0.5"""
    return out.replace("fx_pixels_10000", PIXELS).replace("{res}", str(res)).replace("10000", str(res))


@query(" union all ".join(f"select {res} as resolution, * from ({_scored_scan(res)})" for res in SCANS))
def job2_scan_scored(spark, sf):
    """Every window, by a scorer that takes dense patches of 48 bins, on the log-ratio with pseudocounts."""
    found = jobs.scan_resolutions(_scanned(spark, sf), chromsizes(spark, sf), 48, scorer=scoring.contrast, ratio="pseudo")
    return found.withColumn("score", F.round("score", 6))


def _training_windows(size: int) -> str:
    """Window corners of calls and negatives on a 10-kb map, moved by up to an eighth of a window each way and clamped."""
    half, move = size // 2, size // 4 // 2
    negatives = Q.negatives_sql(size).replace("from fx_calls) c", "from fx_calls where label <> 'negative') c")
    calls = f"""(select call_id, chrom_idx, start, end_ as e, case label when '--' then 1 when '-+' then 2 when '+-' then 3 when '++' then 4 end as label_idx, true as is_sv from fx_calls where label <> 'negative'
union all select call_id, chrom_idx, start, "end", 0, false from ({negatives}) g)"""
    moved = ", ".join(f"p // 10000 - {move} + {Q.LCG.format(k=k, s=3)} % {2 * move + 1} as {c}" for k, c in ((1, "x"), (2, "y")))
    return f"""(select call_id, is_sv, which, label_idx, chrom_idx, least(x + shift, n - {half + 1}) - {half} as x, least(y + shift, n - {half + 1}) - {half} as y from (
select *, greatest(0, {half} - least(x, y)) as shift from (select call_id, is_sv, which, label_idx, c.chrom_idx, length // 10000 + 1 as n, {moved}
from (select call_id, is_sv, label_idx, chrom_idx, unnest([0, 1]) as which, unnest([start, e]) as p from {calls} b) c join fx_chromsizes z on z.chrom_idx = c.chrom_idx)))"""


AT3 = _training_windows(8)
#: Kinds of values as SQL over a pair of cells a (test) and b (clean), and how the two sides are joined.
RATIOS = {"masked": ("log10(a) - log10(b) + 1e-6", ""), "pseudo": ("log10(coalesce(a, 0) + 1e-6) - log10(coalesce(b, 0) + 1e-6)", "full")}


def _job3(norm: str, size: int = 8) -> str:
    """SQL for the training set: windows, their cells scaled over the chromosome, as arrays."""
    ratio, how = RATIOS[norm]
    fill = f"list_transform(range(0, {size * size}), lambda k: round(coalesce(2 * (coalesce(m[k], 0) - lo) / nullif(hi - lo, 0) - 1, 0), 6))"
    side = "(select chrom1_idx, bin1, chrom2_idx, bin2, count as {c} from fx_pixels_10000 where sample = '{s}')"
    v = f"(select *, {ratio} as v from {side.format(c='a', s='test')} t {how} join {side.format(c='b', s='clean')} k using (chrom1_idx, bin1, chrom2_idx, bin2))"
    return f"""select * from (with v as (select * from {v} where chrom1_idx = chrom2_idx),
ends as (select chrom1_idx as chrom_idx, case when count(*) < n * n then least(min(v), 0) else min(v) end as lo, case when count(*) < n * n then greatest(max(v), 0) else max(v) end as hi
  from v join (select chrom_idx as z, length // 10000 + 1 as n from fx_chromsizes) on z = chrom1_idx group by chrom1_idx, n),
c as (select chrom1_idx as chrom_idx, bin1, bin2, v from v union all select chrom1_idx, bin2, bin1, v from v where bin1 <> bin2),
spot as (select * from {_training_windows(size)}),
m as (select call_id, is_sv, which, map(list((bin1 - x) * {size} + bin2 - y), list(v)) as m from spot join c using (chrom_idx) where bin1 >= x and bin1 < x + {size} and bin2 >= y and bin2 < y + {size} group by all)
select call_id, is_sv, which::int as which, label_idx::int as label_idx, {fill} as values
from spot left join m using (call_id, is_sv, which) left join ends using (chrom_idx))"""


def _rounded(df):
    return df.withColumn("values", F.transform("values", lambda v: F.round(v, 6)))


@query(_job3("masked"))
def job3_training_set(spark, sf):
    c = Q.fx_calls(spark, sf).where("label <> 'negative'")
    return _rounded(jobs.build_training_set(c, pixels(spark, sf, 10000), chromsizes(spark, sf), 10000, 8))


def _sums(patches):
    """Of patches rounded to six digits: the sum, added up from the first value on, how many values differ from the first, and the first."""
    v = np.trunc(patches * 1e6 + np.copysign(0.5, patches)) / 1e6
    return {"total": v.cumsum(axis=1)[:, -1], "others": (v != v[:, :1]).sum(axis=1), "first_value": v[:, 0]}


@query(f"select call_id, is_sv, which, label_idx, round(list_sum(values), 4) as total, len(list_filter(values, lambda v: v <> values[1])) as others, values[1] as first_value from ({_job3('masked', 48)})")
def job3_training_48(spark, sf):
    """Patches of 48 bins, by their sums: patches as they are would be half a gigabyte on the largest tables."""
    c = Q.fx_calls(spark, sf).where("label <> 'negative'")
    out = jobs.build_training_set(c, pixels(spark, sf, 10000), chromsizes(spark, sf), 10000, 48, measure=_sums)
    return out.select("call_id", "is_sv", "which", "label_idx", F.round("total", 4).alias("total"), F.col("others").cast("long").alias("others"), "first_value")


@query(_job3("pseudo"))
def job3_training_pseudo(spark, sf):
    c = Q.fx_calls(spark, sf).where("label <> 'negative'")
    return _rounded(jobs.build_training_set(c, pixels(spark, sf, 10000), chromsizes(spark, sf), 10000, 8, norm="pseudo"))


NORMED = {
    "raw_log": "select chrom1_idx, bin1, chrom2_idx, bin2, log10(a) - log10(b) as v from (select * exclude (sample, count), count as a from fx_pixels_10000 where sample = 'test') join (select * exclude (sample, count), count as b from fx_pixels_10000 where sample = 'clean') using (chrom1_idx, bin1, chrom2_idx, bin2)",
    "log10_only": "select chrom1_idx, bin1, chrom2_idx, bin2, log10(count) as v from fx_pixels_10000 where sample = 'test'",
    "exp/obs": f"select chrom1_idx, bin1, chrom2_idx, bin2, expected / count as v from fx_pixels_10000 p join {Q.EXPECTED} e on e.sample = p.sample and e.chrom_idx = chrom1_idx and e.d = bin2 - bin1 where chrom1_idx = chrom2_idx and p.sample = 'test'",
    "expected": f"select chrom1_idx, bin1, chrom2_idx, bin2, ln(count + 1e-6 + eps) - ln(expected + eps) as v from (select *, min(expected) over (partition by chrom1_idx) as eps from fx_pixels_10000 p join {Q.EXPECTED} e on e.sample = p.sample and e.chrom_idx = chrom1_idx and e.d = bin2 - bin1 where chrom1_idx = chrom2_idx and p.sample = 'test')",
    "balanced": """select chrom1_idx, bin1, chrom2_idx, bin2, log10(a + 1e-6) - log10(b + 1e-6) as v from (select chrom1_idx, bin1, chrom2_idx, bin2,
coalesce(sum(case when sample = 'test' and w is null then 0 when sample = 'test' then w + 1e-6 end), 1e-6) as a, coalesce(sum(case when sample = 'clean' and w is null then 0 when sample = 'clean' then w + 1e-6 end), 1e-6) as b
from (select p.*, count * x.weight * y.weight as w from fx_pixels_10000 p join fx_bins x on x.chrom_idx = chrom1_idx and x.local_bin = bin1 join fx_bins y on y.chrom_idx = chrom2_idx and y.local_bin = bin2) group by all)""",
}


@query(" union all ".join(f"select '{n}' as norm, chrom1_idx, bin1, chrom2_idx, bin2, round(v, 6) as value from ({sql}) t{k}" for k, (n, sql) in enumerate(NORMED.items())))
def job3_norms(spark, sf):
    """The cells of the other ways to normalise."""
    p, sizes = pixels(spark, sf, 10000), chromsizes(spark, sf)
    parts = [jobs.training_cells(p, sizes, 10000, n, view(spark, sf, "fx_bins"))[0].select(F.lit(n).alias("norm"), *maps.CELL, F.round("value", 6).alias("value")) for n in NORMED]
    return functools.reduce(DataFrame.unionByName, parts)


@query(f"""select split, sample_id, count(*)::bigint as n, sum(label_idx)::bigint as labels from (select 'train' as split, 'test' as sample_id, * from {AT3} union all select 'test', 'clean', * from {AT3}) group by split, sample_id""")
def job3_manifest(spark, sf):
    """Both samples against each other, written by split and sample and read again."""
    m = spark.createDataFrame([("test", "clean", "all", "train"), ("clean", "test", "all", "test")], "sample_id string, clean_id string, truth_id string, split string")
    truth = Q.fx_calls(spark, sf).where("label <> 'negative'").withColumn("truth_id", F.lit("all"))
    path = scratch(spark, "training")
    jobs.write_training_sets(m, pixels(spark, sf, 10000), truth, chromsizes(spark, sf), 10000, 8, path)
    return spark.read.parquet(path).groupBy("split", "sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum("label_idx").alias("labels"))


JOB4 = f"""select tp::bigint as tp, fn::bigint as fn, round(p, 6) as precision, round(r, 6) as recall, round(2 * p * r / nullif(p + r, 0), 6) as f1 from (
select *, tp / nullif(2 * n, 0) as p, tp / nullif(tp + fn, 0) as r from (select tp, n, 2 * m - tp as fn from (
select coalesce(sum((x.v is not null)::int + (y.v is not null)::int), 0) as tp, count(*) as n from (
  select bp_2 // 5000 as b1, bp_1 // 5000 as b2 from (select bp_1, bp_2, count(*) as k from fx_results where greatest(bp_1, bp_2) < (select stop from fx_offsets where chrom_idx = 2) and bp_2 - bp_1 > 10000 group by 1, 2) where k = 1) q
  left join (select distinct bp_2 + unnest(range(-2, 3)) as v from (select distinct bp_2 from {Q.ANSWERS})) x on x.v = b1
  left join (select distinct bp_1 + unnest(range(-2, 3)) as v from (select distinct bp_1 from {Q.ANSWERS})) y on y.v = b2)
cross join (select count(*) as m from {Q.ANSWERS})))"""


@query(JOB4)
def job4_evaluate(spark, sf):
    r = view(spark, sf, "fx_results").select("result_id", F.col("bp_2").alias("bp_1"), F.col("bp_1").alias("bp_2"))
    out = jobs.evaluate_calls(r, Q.fx_calls(spark, sf).where("label <> 'negative'"), chromsizes(spark, sf), 5000, tol=2)
    return out.select("tp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


JOB5 = """select call_id, chrom, start, end_ as "end", w / 64 as whole, m / 16 as centre from (
select call_id, chrom, start, end_, count(*) filter (where a <> b) as w, count(*) filter (where a <> b and dx between 2 and 5 and dy between 2 and 5) as m from (
select call_id, chrom, start, end_, bin1 - sb + 4 as dx, bin2 - eb + 4 as dy, coalesce(sum(count) filter (where sample = 'test'), 0) as a, coalesce(sum(count) filter (where sample = 'clean'), 0) as b
from (select call_id, regexp_replace(hap, '_hap[12]$', '') as chrom, chrom_idx, start, end_, start // 5000 as sb, end_ // 5000 as eb from fx_calls where abs(start // 5000 - end_ // 5000) >= 5) c
join (select sample, chrom1_idx, bin1, chrom2_idx, bin2, count from fx_pixels_5000 union all select sample, chrom2_idx, bin2, chrom1_idx, bin1, count from fx_pixels_5000 where chrom1_idx <> chrom2_idx or bin1 <> bin2) p
on chrom1_idx = chrom_idx and chrom2_idx = chrom_idx and bin1 >= sb - 4 and bin1 < sb + 4 and bin2 >= eb - 4 and bin2 < eb + 4
group by all) group by all) where w / 64 >= 0.05 and m / 16 >= 0.05"""


@query(JOB5)
def job5_filter_real(spark, sf):
    return jobs.filter_real_svs(Q.fx_calls(spark, sf), pixels(spark, sf, 5000), 5000, 8, (2, 6), 0.05, 0.05)


@query(Q.WN3)
def job6_merge_vcf(spark, sf):
    return jobs.merge_vcf_svs(view(spark, sf, "fx_vcf"), 5000, 4500, 600)


@query(f"select chrom1 as chr, {Q.LARGEST} as label, pos1 as start, pos2 as \"end\" from fx_wide where chrom1 = chrom2")
def job7_convert_wide(spark, sf):
    from ..operators.calls import convert_wide_calls

    return convert_wide_calls(Q.wide(spark, sf))


@query(f"select chrom1 as chr, {Q.LARGEST} as label, pos1 as start, pos2 as \"end\" from fx_wide where chrom1 = chrom2")
def job7_convert_folder(spark, sf):
    """From files to files, and read again."""
    source, out = scratch(spark, "wide"), scratch(spark, "converted")
    write_calls(Q.wide(spark, sf), source, ("chrom1", "pos1", "chrom2", "pos2", "`++`", "`+-`", "`-+`", "`--`"), "\t")
    jobs.convert_wide_folder(spark, source, out)
    return read_sv_calls(spark, out)


@query(Q.CO7)
def job8_results_to_chrom(spark, sf):
    return jobs.results_to_chrom(view(spark, sf, "fx_results"), chromsizes(spark, sf)).select("result_id", "chrom_x", "coord_x", "chrom_y", "coord_y")


def _contrast_weights(size: int = 8, centre: int = 4) -> str:
    """The contrast of a blurred patch before it is squashed is linear in its cells: SQL for the sum of values times weights."""
    rows = scoring.blur3(np.eye(size)[:, :, None] * np.ones((1, 1, size)))[:, :, 0]  # row i: what cell i gives to each place of its axis
    a = (size - centre) // 2
    mid, all_ = (", ".join(f"{x:.12f}" for x in w) for w in (rows[:, a : a + centre].sum(axis=1) / centre, rows.sum(axis=1) / size))
    return f"sum(value * ([{mid}][dx + 1] * [{mid}][dy + 1] - [{all_}][dx + 1] * [{all_}][dy + 1]))"


LOGS = "(select chrom1_idx, bin1, chrom2_idx, bin2, log10(value) as value from " + Q.TEST_CELLS + " t)"


def _scored(points: str, cells: str, size: int, least: str = "1e-12") -> str:
    """Windows around points whose contrast, before it is squashed, is above a bound."""
    h = size // 2
    return f"""(select chrom1_idx, chrom2_idx, x, y from (select p.chrom1_idx, p.chrom2_idx, x, y, bin1 - x + {h} as dx, bin2 - y + {h} as dy, value from {points} p
join {cells} c on c.chrom1_idx = p.chrom1_idx and c.chrom2_idx = p.chrom2_idx and bin1 >= x - {h} and bin1 < x + {h} and bin2 >= y - {h} and bin2 < y + {h}) group by all having {_contrast_weights(size)} > {least})"""


def _job9(size: int) -> str:
    """Every position of the diagonals on the 50-kb map, pairs of those found, and near ones merged."""
    h, logs = size // 2, LOGS.format(res=50000)
    every = f"(select chrom_idx as chrom1_idx, chrom_idx as chrom2_idx, unnest(range({h}, length // 50000 - {h} + 1)) as x, x as y from fx_chromsizes where length // 50000 >= {size})"
    pairs = f"(select a.c as chrom1_idx, b.c as chrom2_idx, a.p as x, b.p as y from spots a join spots b on a.p >= b.p and not (a.c = b.c and abs(a.p - b.p) < {size}))"
    return f"""select * from (with spots as (select chrom1_idx as c, x as p from {_scored(every, logs, size)}),
found as (select * from {_scored(pairs, logs, size)})
select chrom1_idx, chrom2_idx, (sum(x) // count(*))::bigint as x, (sum(y) // count(*))::bigint as y, count(*) as members from {Q.CHAIN.format(apart='g >= 9').replace(Q.DETECTIONS, "found")} group by chrom1_idx, chrom2_idx, chain)"""


@query(_job9(8))
def job9_two_step(spark, sf):
    return jobs.two_step_scan(pixels(spark, sf, 50000), chromsizes(spark, sf), 50000, 8, 3, scoring.contrast)


@query(_job9(48))
def job9_two_step_48(spark, sf):
    return jobs.two_step_scan(pixels(spark, sf, 50000), chromsizes(spark, sf), 50000, 48, 3, scoring.contrast)


def _corner_classes(stack):
    """Five numbers for a patch: its mean, and the means of its four corners, so rounded that equal ones are equal."""
    h = stack.shape[1] // 2
    parts = [stack] + [stack[:, a : a + h, b : b + h] for a in (0, h) for b in (0, h)]
    return np.round(np.stack([p.mean(axis=(1, 2)) for p in parts], axis=1), 9)


def _corner_sql(size: int) -> str:
    """The same for a blurred patch, as sums over its cells: a list of five."""
    rows = scoring.blur3(np.eye(size)[:, :, None] * np.ones((1, 1, size)))[:, :, 0]
    every, low, high = ("[" + ", ".join(f"{x:.12f}" for x in w.mean(axis=1)) + "]" for w in (rows, rows[:, : size // 2], rows[:, size // 2 :]))
    pairs = ((every, every), (low, low), (low, high), (high, low), (high, high))
    return "[" + ", ".join(f"round(sum(value * {a}[dx + 1] * {b}[dy + 1]), 9)" for a, b in pairs) + "]"


def _boxes(points: str, size: int) -> str:
    """Chains of points as boxes of windows."""
    ends = {c: (f"arg_min({c}, [x + y, x, y])", f"arg_max({c}, [x + y, x, y])") for c in "xy"}
    sides = ", ".join(f"least({a}, {z}) - {size // 2} as {c}0, abs({z} - {a}) + {size} as {w}" for (c, (a, z)), w in zip(ends.items(), ("width", "height"), strict=True))
    return f"(select chrom1_idx, chrom2_idx, chain, {sides} from {Q.CHAIN.format(apart=f'g > {2 * size * size}').replace(Q.DETECTIONS, points)} group by chrom1_idx, chrom2_idx, chain)"


def _grid(points: str, size: int, factor: int) -> str:
    """Candidates on a map `factor` times finer around points, those whose window lies inside the 5-kb map."""
    h, moves = size // 2, f"range(0, {size}, {max(1, size // factor)})"
    near = f"(select distinct chrom1_idx, chrom2_idx, (x - {h} + i) * {factor} as x, (y - {h} + j) * {factor} as y from {points}, unnest({moves}) a(i), unnest({moves}) b(j))"
    return f"(select g.* from {near} g join fx_chromsizes a on a.chrom_idx = chrom1_idx join fx_chromsizes b on b.chrom_idx = chrom2_idx where x >= {h} and y >= {h} and x + {h} <= a.length // 5000 and y + {h} <= b.length // 5000)"


RATIO_CELLS = "(select chrom1_idx, bin1, chrom2_idx, bin2, v as value from r50 union all select chrom2_idx, bin2, chrom1_idx, bin1, v from r50 where chrom1_idx <> chrom2_idx or bin1 <> bin2)"


def _job1(size: int, class_size: int, fine: bool = False) -> str:
    """The whole detection as one query: windows of `size` bins, classes by windows of class_size; fine: detections move on the 1-kb map at the end."""
    h, g, places = size // 2, class_size // 2, size * size
    start = f"least(i * {h}, {Q.N_GENOME} - {size})"
    middle = f"dx between {h - 2} and {h + 1} and dy between {h - 2} and {h + 1}"
    sides = lambda res: f"join fx_chromsizes a on a.chrom_idx = chrom1_idx join fx_chromsizes b on b.chrom_idx = chrom2_idx where x >= {h} and y >= {h} and x + {h} <= a.length // {res} and y + {h} <= b.length // {res}"
    sample = lambda s, c: f"(select * exclude (sample, count), count as {c} from fx_pixels_50000 where sample = '{s}')"
    held = lambda box, cells: f"{box} b join {cells} c on c.chrom1_idx = b.chrom1_idx and c.chrom2_idx = b.chrom2_idx and bin1 >= x0 and bin1 < x0 + width and bin2 >= y0 and bin2 < y0 + height"
    res, at = (1000, "fixed") if fine else (5000, "det")
    # the largest of 120 by 120 bins around a detection on the 1-kb map, if its logarithm is above that of the centre by more than a quarter of it
    moved = f""",
up as (select *, x * 5 as u, y * 5 as v from det),
around as (select d.chrom1_idx, d.chrom2_idx, x, y, bin1 - u + 60 as dx, bin2 - v + 60 as dy, value from up d join {Q.TEST_CELLS.format(res=1000)} c on c.chrom1_idx = d.chrom1_idx and c.chrom2_idx = d.chrom2_idx
  and bin1 >= u - 60 and bin1 < u + 60 and bin2 >= v - 60 and bin2 < v + 60),
top as (select chrom1_idx, chrom2_idx, x, y, arg_min([dx, dy], [-value, dx, dy]) as p, log2(max(value)) as hi, log2(max(value) filter (where dx = 60 and dy = 60)) as mid from around group by 1, 2, 3, 4),
fixed as (select chrom1_idx, chrom2_idx, x, y, u + case when p is not null and (mid is null or hi - mid > floor(hi / 4)) then p[1] - 60 else 0 end as fx, v + case when p is not null and (mid is null or hi - mid > floor(hi / 4)) then p[2] - 60 else 0 end as fy
  from up left join top using (chrom1_idx, chrom2_idx, x, y))""" if fine else ""
    fx, fy = ("fx", "fy") if fine else ("x", "y")
    return f"""select * from (with recursive gc as (select sample, least(g1, g2) as g1, greatest(g1, g2) as g2, sum(count) as c from {Q.GENOME_CELLS} group by 1, 2, 3),
near as (select g1, g2, log10(t.c) - log10(k.c) + 1e-6 as v from (select * from gc where sample = 'test') t join (select * from gc where sample = 'clean') k using (g1, g2) where g2 - g1 < {size}),
w as (select {start} as start, g1, g2, v from near, range(0, (select {Q.N_GENOME} // {h})) z(i) where {start} <= g1 and g2 < {start} + {size}),
hit as (select distinct start + {h} as p from (select start, g1 - start as dx, g2 - start as dy, v from w union all select start, g2 - start, g1 - start, v from w where g1 <> g2)
  group by start having coalesce(sum(v) filter (where {middle}), 0) / 16 - sum(v) / {places} > 1e-12),
spots as (select distinct o.chrom_idx, case when o.chrom_idx = 0 then p else (p * 10000 - o.start) // 10000 end::bigint as x from hit join fx_offsets o on p * 10000 <= o.stop and (p * 10000 > o.start or o.chrom_idx = 0)),
thin as (select chrom_idx, min(x) as x from spots group by chrom_idx union all select t.chrom_idx, (select min(p.x) from spots p where p.chrom_idx = t.chrom_idx and p.x - {h} > t.x) from thin t where t.x is not null),
anchors as (select * from thin where x is not null),
pairs as (select distinct a.chrom_idx as chrom1_idx, b.chrom_idx as chrom2_idx, a.x // 5 as x, b.x // 5 as y from anchors a join anchors b on a.x >= b.x and not (a.chrom_idx = b.chrom_idx and abs(a.x - b.x) < {size})),
r50 as (select chrom1_idx, bin1, chrom2_idx, bin2, log10(a) - log10(b) + 1e-6 as v from {sample('test', 'a')} join {sample('clean', 'b')} using (chrom1_idx, bin1, chrom2_idx, bin2)),
inside as (select p.* from pairs p {sides(50000)}),
coarse as (select * from {_scored("inside", RATIO_CELLS, size)}),
c5 as (select * from {LOGS.format(res=5000)}),
c10 as (select * from {LOGS.format(res=10000)}),
refined as (select * from {_scored(_grid("coarse", size, 10), "c5", size)}),
points as (select distinct chrom1_idx, chrom2_idx, x // 2 as x, y // 2 as y from refined),
spread as (select distinct chrom1_idx, chrom2_idx, x, unnest(range(y0 + {h}, y0 + height - {h} + 1)) as y from (select *, unnest(range(x0 + {h}, x0 + width - {h} + 1)) as x from {_boxes("points", size)})),
sure as (select * from {_scored("spread", "c10", size, "ln(0.55 / 0.45)")}),
final as (select * from {_scored(_grid("sure", size, 2), "c5", size)}),
best as (select chrom1_idx, chrom2_idx, chain, arg_min([bin1, bin2], [-value, bin1, bin2]) as p from (select b.*, bin1, bin2, value from {held(_boxes("final", class_size), Q.TEST_CELLS.format(res=5000))}) group by 1, 2, 3),
det as (select distinct chrom1_idx, chrom2_idx, p[1] as x, p[2] as y from best union select chrom1_idx, chrom2_idx, x * 10, y * 10 from coarse where not exists (select 1 from refined)),
scores as (select chrom1_idx, chrom2_idx, x, y, {_corner_sql(class_size)} as s from (select d.*, bin1 - x // 2 + {g} as dx, bin2 - y // 2 + {g} as dy, log2(value) as value from det d join {Q.TEST_CELLS.format(res=10000)} c on c.chrom1_idx = d.chrom1_idx and c.chrom2_idx = d.chrom2_idx and x // 2 > {g} and y // 2 > {g}
  and bin1 >= x // 2 - {g} and bin1 < x // 2 + {g} and bin2 >= y // 2 - {g} and bin2 < y // 2 + {g}) group by 1, 2, 3, 4){moved}
select ({fx} * {res} + a.start)::bigint as bp_1, ({fy} * {res} + b.start)::bigint as bp_2, ['negative', '--', '-+', '+-', '++'][list_position(s, list_max(s))] as label
from {at} left join scores using (chrom1_idx, chrom2_idx, x, y) join fx_offsets a on a.chrom_idx = chrom1_idx join fx_offsets b on b.chrom_idx = chrom2_idx)"""


def _detect(spark, sf, **how):
    maps_ = {res: pixels(spark, sf, res) for res in (50000, 10000, 5000, 1000)}
    return jobs.detect_svs(maps_, chromsizes(spark, sf), scoring.contrast, _corner_classes, cutoff=0.55, **how)


@query(_job1(8, 8))
def job1_detect(spark, sf):
    return _detect(spark, sf, size=8, class_size=8)


@query(_job1(8, 8, fine=True))
def job1_detect_fine(spark, sf):
    """As above, and each detection moves to the largest count near it on the 1-kb map."""
    return _detect(spark, sf, size=8, class_size=8, fine=1000)


@query(_job1(48, 24))
def job1_detect_48(spark, sf):
    return _detect(spark, sf, size=48, class_size=24)


@query(f"select sample, dist, round(min(smooth) over (partition by sample order by dist), 6) as smooth from {Q.smooth_sql()}")
def job10_expected_curve(spark, sf):
    return jobs.expected_curve(view(spark, sf, "fx_expected"), ["sample"], head=8, near=40, near_frac=0.1, far_frac=0.3).withColumn("smooth", F.round("smooth", 6))


CROPS = f"""select result_id, bin1 - x as dx, bin2 - y as dy, round(log2(value + 1), 6) as value from (select result_id, x - 4 as x, y - 4 as y from ({Q.CO10})) p
join {Q.TEST_CELLS.format(res=5000)} c on c.chrom1_idx = 1 and c.chrom2_idx = 1 and bin1 >= x and bin1 < x + 8 and bin2 >= y and bin2 < y + 8"""


@query(CROPS)
def job11_crops(spark, sf):
    out = jobs.crops_for_calls(view(spark, sf, "fx_results"), pixels(spark, sf, 5000), chromsizes(spark, sf), 1, 5000, 8)
    return out.withColumn("value", F.round("value", 6))


CONFUSION = Q.SQL["ag12_confusion"].rpartition("\nselect")[2]
LOSS = Q.SQL["ag15_log_loss"].rpartition("\nselect round(avg(-case")[2]
JOB12 = f"""select c.*, f.macro_f1, f.macro_f05, l.loss from (select{CONFUSION}) c, (select round(avg(2 * hit / (r + s)), 6) as macro_f1, round(avg(1.25 * hit / (0.25 * r + s)), 6) as macro_f05
from (select k, count(*) filter (where y_true = k) as r, count(*) filter (where y_pred = k) as s, count(*) filter (where y_true = k and y_pred = k) as hit from fx_predictions, (values (0), (1)) v(k) group by k)) f, (select round(avg(-case{LOSS}) l"""


@query(JOB12)
def job12_score_model(spark, sf):
    out = jobs.score_model(view(spark, sf, "fx_predictions").select("y_true", "y_pred", "score"))
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "macro_f1", "macro_f05", "loss")})


INSIDE = "x >= 0 and y >= 0 and x + 8 <= a.length // {res} and y + 8 <= b.length // {res}"
BOTH_SIZES = "join fx_chromsizes a on a.chrom_idx = chrom1_idx join fx_chromsizes b on b.chrom_idx = chrom2_idx"
PA3_MAPS = f"""select z.patch_id, case when {INSIDE.format(res=10000)} and d.a is not null then d.a else list_transform(range(0, 64), lambda i: 0.0) end as values
from {Q.WINDOWS} z {BOTH_SIZES} left join {Q.DENSE} d on d.patch_id = z.patch_id"""


@query(PA3_MAPS)
def pa3_windows_or_zero(spark, sf):
    w = Q.detections(spark, sf).withColumn("patch_id", F.concat_ws("-", *(F.col(c).cast("string") for c in ("chrom1_idx", "chrom2_idx", "x", "y"))))
    return jobs.windows_of_maps_or_zero(cells(spark, sf, 10000), windows.centre_to_corner(w, 8), chromsizes(spark, sf), 10000, 8)


@query(f"select d.* from {Q.DETECTIONS} d {BOTH_SIZES} where x <= y and {INSIDE.format(res=50000)}")
def fi9_upper(spark, sf):
    return windows.filter_corners_inside(Q.detections(spark, sf), chromsizes(spark, sf), 8, 50000, upper=True)
