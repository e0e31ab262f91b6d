"""Curves of the expected value by distance. A curve has a row for each distance of a sample, so it is short."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import bounded
from ..functions.ranges import carried, dealt


def expected_by_distance(expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, dist, avg and log_avg from n_valid and balanced_sum; null where there is nothing valid."""
    sums = expected.groupBy(*keys, "dist").agg(F.sum("n_valid").alias("n"), F.sum("balanced_sum").alias("s"))
    avg = F.try_divide("s", "n")
    return sums.select(*keys, "dist", avg.alias("avg"), F.when(avg > 0, F.ln(avg)).alias("log_avg"))


def expected_trans(expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, log_avg over all rows."""
    ratio = F.try_divide(F.sum("balanced_sum"), F.sum("n_valid"))
    return expected.groupBy(*keys).agg(F.when(ratio > 0, F.ln(ratio)).alias("log_avg"))


def running_min(curve: DataFrame, keys: list[str], value: str = "log_avg") -> DataFrame:
    """curve with value replaced by its least so far. Distances are dealt out in ranges, so curves need no single task; keys are not null."""
    order = [F.col("dist")]
    found = carried(dealt(curve, keys, order), keys, order, "_least", F.col(value), F.min, F.least)
    return found.withColumn(value, F.col("_least")).select(curve.columns)


def truncate_at_first_bad(curve: DataFrame, keys: list[str], value: str = "log_avg") -> DataFrame:
    """The curve up to the first distance without a finite value, which is found by sums alone."""
    bad = F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    first = curve.groupBy(*keys).agg(F.min(F.when(bad, F.col("dist"))).alias("_first"))
    return curve.join(bounded(first), keys).where("_first is null or dist < _first").select(curve.columns)


#: Fits between two neighbours of a window's width; between them the curve goes by line.
FITS = 256


def lowess(x: np.ndarray, y: np.ndarray, frac: float, fits: int = FITS) -> np.ndarray:
    """Locally weighted lines with tricube weights over the nearest frac of the points, without robust rounds; x ascending.

    A window of k points moves by k / fits points at a time, and points between two fits lie on the line between them; windows of less than twice
    `fits` points have a fit at each. So the work is n * fits, whatever frac is.
    """
    n = len(x)
    k = min(n, max(2, int(np.ceil(frac * n))))
    at = np.unique(np.r_[np.arange(0, n, max(1, k // fits)), n - 1])
    found, lo = np.empty(len(at)), 0
    for i, p in enumerate(at.tolist()):
        while lo + k < n and x[lo + k] - x[p] < x[p] - x[lo]:
            lo += 1
        xs, ys = x[lo : lo + k], y[lo : lo + k]
        d = np.abs(xs - x[p])
        u = np.minimum(d / max(d[0], d[-1], 1e-12), 1)
        w = 1 - u * u * u
        w = w * w * w + 1e-12
        w /= w.sum()
        mx, my = w @ xs, w @ ys
        dx = xs - mx
        var = w @ (dx * dx)
        found[i] = my + (w @ (dx * (ys - my)) / var * (x[p] - mx) if var > 1e-12 else 0)
    return np.interp(x, x[at], found) if len(at) < n else found


def smooth_expected(curve: DataFrame, keys: list[str], head: int = 48, near: int = 10_000, near_frac: float = 0.01, far_frac: float = 0.1) -> DataFrame:
    """keys, dist, smooth: the first `head` values as they are, then lines over ln(dist + 1), finer up to `near` points on. A curve has no more points than
    a chromosome has bins, and is smoothed by one task; curves are dealt out."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("dist")
        x, y = np.log(f["dist"].to_numpy("f8") + 1), f["log_avg"].to_numpy("f8")
        out = y.copy()
        if len(y) > head:
            out[head:] = lowess(x[head:], y[head:], near_frac)
            if len(y) > near:
                out[near:] = lowess(x[head:], y[head:], far_frac)[near - head :]
        return f[[*keys, "dist"]].assign(smooth=out)

    good = curve.where("log_avg is not null")
    schema = good.select(*keys, "dist").schema.add("smooth", "double")
    return good.groupBy(*keys).applyInPandas(run, schema)


def coarsegrain(balanced: np.ndarray, counts: np.ndarray, cutoff: int = 3, levels: int = 8) -> np.ndarray:
    """A small patch in which each cell of fewer raw counts than cutoff takes the mean of the smallest block around it, of
    2, 4, 8 ... cells a side, that has enough. NaN cells are left out of means and stay NaN."""
    out = np.array(balanced, "f8")
    good = ~np.isnan(out)
    value, n, m = np.nan_to_num(out), np.where(good, counts, 0).astype("f8"), good.astype("f8")
    poor, block = good & (n < cutoff), 1
    for _ in range(levels):
        if not poor.any():
            break
        h, w = (s + s % 2 for s in value.shape)
        pads = [(0, h - value.shape[0]), (0, w - value.shape[1])]
        value, n, m = (np.pad(a, pads).reshape(h // 2, 2, w // 2, 2).sum(axis=(1, 3)) for a in (value, n, m))
        block *= 2
        wide = [np.kron(a, np.ones((block, block)))[: out.shape[0], : out.shape[1]] for a in (value / np.maximum(m, 1), n)]
        out[poor] = wide[0][poor]
        poor &= wide[1] < cutoff
        if value.size == 1:
            break
    return out


def adaptive_coarsegrain(patches: DataFrame, size: int, cutoff: int = 3, levels: int = 8, values: str = "values", counts: str = "counts", out: str = "coarse") -> DataFrame:
    """patches (arrays of size * size balanced values and raw counts, by row) with `out`: each patch coarse-grained as by coarsegrain().

    Null values are masked: left out of means, and null in the result. A null patch, or one without counts, gives null.
    """
    keep = [c for c in patches.columns if c != out]
    schema = patches.select(keep).schema.add(out, T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for v, n in zip(b[values].to_pylist(), b[counts].to_pylist(), strict=True):
                if v is None or n is None:
                    found.append(None)
                    continue
                whole = coarsegrain(np.array(v, "f8").reshape(size, size), np.array([x or 0 for x in n], "f8").reshape(size, size), cutoff, levels)
                found.append([None if np.isnan(x) else x for x in whole.reshape(-1).tolist()])
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(found, pa.list_(pa.float64()))], names=[*keep, out])

    return patches.select(keep).mapInArrow(run, schema)
