"""Lists of structural variations: filters, conversion and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import carried, dealt, total
from ..functions.values import WIDE, log_ratio_raw, wide_to_label


def filter_chrom(calls: DataFrame, chrom: str) -> DataFrame:
    return calls.where(F.col("chr") == chrom)


def filter_labels(calls: DataFrame, keep: list[str] | None = None, drop: list[str] | None = None) -> DataFrame:
    out = calls.where(F.col("label").isin(keep)) if keep else calls
    return out.where(~F.col("label").isin(drop)) if drop else out


def filter_alignment_svs(df: DataFrame, least: int = 50_000) -> DataFrame:
    """Differences of two assemblies that are not syntenic and long on both sides."""
    return df.where((F.col("type") != "SYN") & (F.abs(F.col("aend") - F.col("astart")) > least) & (F.abs(F.col("bend") - F.col("bstart")) > least))


def filter_cis(df: DataFrame) -> DataFrame:
    """Foreign calls within one chromosome as chr, label, start, end."""
    return df.where("chrom1 = chrom2").select(F.col("chrom1").alias("chr"), "label", F.col("pos1").alias("start"), F.col("pos2").alias("end"))


def filter_eval_results(results: DataFrame, offsets: DataFrame, chroms: int = 3, least: int = 10_000) -> DataFrame:
    """Results with both positions in the first chromosomes and bp_1 - bp_2 above a least distance. offsets: see chrom_offsets."""
    limit = offsets.where(F.col("chrom_idx") < chroms).agg(F.max("stop").alias("_limit"))
    return results.join(F.broadcast(limit), (F.col("bp_1") < F.col("_limit")) & (F.col("bp_2") < F.col("_limit"))).drop("_limit").where(F.col("bp_1") - F.col("bp_2") > least)


def filter_span(calls: DataFrame, min_bins: int = 5, start: str = "start_bin", end: str = "end_bin") -> DataFrame:
    return calls.dropna(subset=[start, end]).where(F.abs(F.col(start) - F.col(end)) >= min_bins)


def signal_measures(pairs: DataFrame, size: int, block: tuple[int, int], keys: list[str]) -> DataFrame:
    """keys, whole, centre: shares of a window's cells, and of a block's on its diagonal, where the samples' counts differ.

    pairs: a full join of both samples' cells as dx, dy, a, b; equal counts and cells in neither sample are zeros.
    """
    differs = F.coalesce("a", F.lit(0)) != F.coalesce("b", F.lit(0))
    lo, hi = block
    inside = (F.col("dx") >= lo) & (F.col("dx") < hi) & (F.col("dy") >= lo) & (F.col("dy") < hi)
    return pairs.groupBy(*keys).agg((F.count_if(differs) / (size * size)).alias("whole"), (F.count_if(differs & inside) / ((hi - lo) ** 2)).alias("centre"))


def filter_signal(pairs: DataFrame, size: int = 96, block: tuple[int, int] = (22, 26), whole: float = 0.2, centre: float = 0.4, keys: tuple[str, ...] = ("patch_id",)) -> DataFrame:
    return signal_measures(pairs, size, block, list(keys)).where((F.col("whole") >= whole) & (F.col("centre") >= centre))


def drop_all_duplicates(df: DataFrame) -> DataFrame:
    """Rows that occur once; of rows that occur more often none stays."""
    return df.groupBy(*df.columns).count().where("count = 1").drop("count")


def vcf_bin_sums(vcf: DataFrame, bin_size: int = 5000) -> DataFrame:
    """Sum of variation lengths by chromosome and bin: chrom, pos (the bin's start), sv_len."""
    return vcf.groupBy("chrom", F.expr(f"pos div {bin_size}").alias("b")).agg(F.sum("alt_len").alias("sv_len")).select("chrom", (F.col("b") * bin_size).alias("pos"), "sv_len")


def merge_vcf(sums: DataFrame, gap: int = 50_000, least: int = 5000) -> DataFrame:
    """Neighbours merged while the reach so far plus gap meets the next position: chrom, start, end, sv_len above least.

    The reach is the running maximum of pos + sv_len within the chromosome, the first length counts, and the
    last cluster is given out. Positions are dealt out in ranges, so a chromosome needs no single task; rows without one go.
    """
    order = [F.col("pos")]
    placed = dealt(sums.where("chrom is not null"), ["chrom"], order)
    reached = carried(placed, ["chrom"], order, "reach", F.col("pos") + F.col("sv_len"), F.max, F.greatest, inclusive=False)
    cut = reached.withColumn("cut", F.when(F.col("reach") + gap >= F.col("pos"), 0).otherwise(1))
    marked = carried(cut, ["chrom"], order, "cluster", F.col("cut"), F.sum, total)
    out = marked.groupBy("chrom", "cluster").agg(F.min("pos").alias("start"), F.max(F.col("pos") + F.col("sv_len")).alias("end"))
    return out.select("chrom", "start", "end", (F.col("end") - F.col("start")).alias("sv_len")).where(F.col("sv_len") > least)


def convert_wide_calls(df: DataFrame, columns: tuple[str, ...] = WIDE) -> DataFrame:
    """Foreign callers' wide probabilities to calls within chromosomes."""
    return filter_cis(df.withColumn("label", wide_to_label(columns)))


def call_log_ratios(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("value", log_ratio_raw(F.col("a"), F.col("b")))
