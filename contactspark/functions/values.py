"""Expressions on map values, labels, scores and names."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Class names by index.
LABELS = ("negative", "--", "-+", "+-", "++")
#: Names of the second vocabulary, in the order of the classes that they fold to.
FOLDED = {"inversion": 4, "translocation+": 3, "translocation-": 2, "translocation_reversed+": 3, "translocation_reversed-": 2, "negative": 0}
#: The vocabulary of three classes.
THREE = ("copy_loss", "inversion", "negative")
#: Score columns of foreign callers; the first of equals wins.
WIDE = ("++", "+-", "-+", "--")

NEG_INF, POS_INF = float("-inf"), float("inf")


def log_value(v: Column, base: float = 10, addition: float = 0.0, zero_to_null: bool = False) -> Column:
    """Logarithm of v + addition. Zero gives -inf, or null if asked for; negative values and null give null."""
    x = v.cast("double") + addition
    log = {10: F.log10, 2: F.log2}.get(base, lambda c: F.ln(c) / F.ln(F.lit(float(base))))
    out = F.when(x > 0, log(x)).when(x == 0, F.lit(NEG_INF))
    return F.when(v == 0, F.lit(None).cast("double")).otherwise(out) if zero_to_null else out


@F.pandas_udf(T.DoubleType())
def log2_exact(v: pd.Series) -> pd.Series:
    """log2 of positive numbers as the C library rounds it. Java's quotient of two logarithms may be a last digit off, which tells where two logarithms
    are held against a whole number."""
    return v.map(math.log2, na_action="ignore").astype("f8")


def rounded(v: Column, digits: int) -> Column:
    """v rounded, where a negative number that becomes zero keeps its sign, as in SQL; F.round drops it."""
    r = F.round(v, digits)
    return F.when((r == 0) & (v < 0), F.lit(-0.0)).otherwise(r)


def clean_non_finite(v: Column, neginf: float = 0.0, posinf: float = 0.0, nan: float = 0.0) -> Column:
    """Numbers in place of NaN, null and the infinities."""
    return F.when(v.isNull() | F.isnan(v), F.lit(nan)).when(v == POS_INF, F.lit(posinf)).when(v == NEG_INF, F.lit(neginf)).otherwise(v)


def log_ratio_masked(a: Column, b: Column, eps: float = 1e-6) -> Column:
    """log10(a) - log10(b) + eps; 0 where either side is 0, null or NaN."""
    good = (F.coalesce(a, F.lit(0)) > 0) & (F.coalesce(b, F.lit(0)) > 0) & ~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double"))
    return F.when(good, F.log10(a) - F.log10(b) + eps).otherwise(0.0)


def log_ratio_pseudo(a: Column, b: Column, eps: float = 1e-6) -> Column:
    """log10(a + eps) - log10(b + eps), a missing cell as 0."""
    return F.log10(F.coalesce(a, F.lit(0)) + eps) - F.log10(F.coalesce(b, F.lit(0)) + eps)


def log_ratio_balanced(a: Column, a_masked: Column, b: Column, b_masked: Column, eps: float = 1e-6) -> Column:
    """log_ratio_pseudo of balanced values + eps, where a masked cell counts as 0 after that addition."""
    side = lambda v, masked: F.when(masked, 0.0).otherwise(F.coalesce(v, F.lit(0.0)) + eps)
    return log_ratio_pseudo(side(a, a_masked), side(b, b_masked), eps)


def log_ratio_raw(a: Column, b: Column) -> Column:
    """log10(a) - log10(b); 0 where that is not finite."""
    return F.when((a > 0) & (b > 0), F.log10(a) - F.log10(b)).otherwise(0.0)


def label_to_index(label: Column) -> Column:
    """Class index of a name of the first or second vocabulary; null for other names."""
    known = {**{n: i for i, n in enumerate(LABELS)}, **FOLDED}
    out = F.lit(None).cast("int")
    for name, i in known.items():
        out = F.when(label == name, F.lit(i)).otherwise(out)
    return out


def index_to_label(index: Column, names: tuple[str, ...] = LABELS) -> Column:
    return F.get(F.array(*map(F.lit, names)), index)


def one_hot(index: Column, size: int = 5) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == index).cast("int"))


def wide_to_label(columns: tuple[str, ...] = WIDE) -> Column:
    """The name of the largest column, the first of equals."""
    most = F.greatest(*(F.col(f"`{c}`") for c in columns))
    out = F.lit(None).cast("string")
    for c in reversed(columns):
        out = F.when(F.col(f"`{c}`") == most, F.lit(c)).otherwise(out)
    return out


def threshold(score: Column, mode: str = "round", cutoff: float = 0.95) -> Column:
    """round: above a half, which itself rounds to even, so not; cutoff: the cutoff or more. A null score is not detected."""
    return F.coalesce(score > 0.5 if mode == "round" else score >= cutoff, F.lit(False))


def class_argmax(scores: Column) -> Column:
    """The index of the first largest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def softmax(scores: Column) -> Column:
    e = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def strip_haplotype(name: Column) -> Column:
    return F.regexp_replace(name, "_hap[12]$", "")


def parse_patch_key(name: Column) -> Column:
    """chr_x_y with an extension, as a struct of chrom, x and y; the chromosome's name may hold underscores."""
    part = lambda i: F.regexp_extract(name, r"^(.*)_(-?\d+)_(-?\d+)(\.[^.]*)?$", i)
    return F.struct(part(1).alias("chrom"), part(2).try_cast("long").alias("x"), part(3).try_cast("long").alias("y"))


def alt_length(alt: Column) -> Column:
    return F.length(alt)
