"""Scores of calls and of classifiers."""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import floor_div

SUMS = ("n", "x", "y", "xx", "yy", "xy")


def near_any(results: DataFrame, answers: DataFrame, left: str, right: str, tol: int, flag: str, key: str = "result_id") -> DataFrame:
    """results with a Boolean: does any answer's `right` lie within tol of `left`? By buckets of tol + 1, of which three are probed."""
    width = tol + 1
    spots = answers.select(F.col(right).alias("_at"), floor_div(F.col(right), width).alias("_bucket")).where(F.col(right).isNotNull()).distinct()
    probes = results.select(key, F.col(left).alias("_from"), F.explode(F.array(*(floor_div(F.col(left), width) + d for d in (-1, 0, 1)))).alias("_bucket"))
    found = probes.join(spots, "_bucket").where(F.abs(F.col("_from") - F.col("_at")) <= tol).select(key).distinct()
    return results.join(found.withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def match_calls(results: DataFrame, answers: DataFrame, tol: int = 100, crossed: bool = True, key: str = "result_id") -> DataFrame:
    """results with found_x and found_y. crossed: the first position is held against answers' second and the other way round."""
    a, b = ("bp_2", "bp_1") if crossed else ("bp_1", "bp_2")
    return near_any(near_any(results, answers, "bp_1", a, tol, "found_x", key), answers, "bp_2", b, tol, "found_y", key)


def matched_one_to_one(results: DataFrame, answers: DataFrame, tol: int = 100, crossed: bool = True, key: str = "result_id") -> DataFrame:
    """results with found_x and found_y, where each answer's side is met by one result at most; as many as can be are.

    Both lists lie on a line for each side, sorted, and are swept once: the foremost result and answer are a pair if they are near enough, else the one behind
    is left. Of equal positions the result of the least key comes first. What is swept is a row a position, with the numbers of results and answers there, in
    order and as a stream: a task for each side, which holds only the positions within tol of where it is. So it gets no more rows than a genome has bins,
    however many results. Results then look up how many of their position are met. Keys and positions of results are not null.
    """
    at = lambda df, c, mine: df.where(F.col(c).isNotNull()).select(F.col(c).cast("long").alias("x"), F.lit(int(mine)).alias("r"), F.lit(int(not mine)).alias("a"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, theirs = deque(), deque()  # positions with results, and with answers, that are not met yet
        for batch in batches:
            spots, hits = [], []
            for x, *counts in zip(*(batch[c].to_pylist() for c in ("x", "r", "a")), strict=True):
                for waiting, n in zip((mine, theirs), counts, strict=True):
                    while waiting and waiting[0][0] < x - tol:
                        waiting.popleft()
                    if n:
                        waiting.append([x, n])
                while mine and theirs:
                    met = min(mine[0][1], theirs[0][1])
                    spots.append(mine[0][0])
                    hits.append(met)
                    for waiting in (mine, theirs):
                        waiting[0][1] -= met
                        if not waiting[0][1]:
                            waiting.popleft()
            yield pa.RecordBatch.from_arrays([pa.array(spots, pa.int64()), pa.array(hits, pa.int64())], names=["_x", "hits"])

    out = results
    for side, c, other in (("x", "bp_1", "bp_2" if crossed else "bp_1"), ("y", "bp_2", "bp_1" if crossed else "bp_2")):
        points = at(results, c, True).unionByName(at(answers, other, False)).groupBy("x").agg(F.sum("r").alias("r"), F.sum("a").alias("a"))
        met = points.repartition(1).sortWithinPartitions("x").mapInArrow(sweep, "_x long, hits long").groupBy("_x").agg(F.sum("hits").alias("_hits"))
        ranked = out.withColumns({"_x": F.col(c).cast("long"), "_rank": F.row_number().over(Window.partitionBy(F.col(c).cast("long")).orderBy(key))})
        out = ranked.join(met, "_x", "left").withColumn(f"found_{side}", F.coalesce(F.col("_rank") <= F.col("_hits"), F.lit(False))).drop("_x", "_rank", "_hits")
    return out


def call_scores(matched: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: tp, fn, precision, recall, f1, a side of a call counting as one. Recall may exceed 1 after match_calls, as several results may hit one
    answer; it does not after matched_one_to_one."""
    hits = matched.agg(F.coalesce(F.sum(F.col("found_x").cast("long") + F.col("found_y").cast("long")), F.lit(0)).alias("tp"), F.count(F.lit(1)).alias("n"))
    both = hits.crossJoin(F.broadcast(answers.agg(F.count(F.lit(1)).alias("m"))))  # one row each
    fn = 2 * F.col("m") - F.col("tp")
    out = both.select("tp", fn.alias("fn"), F.try_divide(F.col("tp"), 2 * F.col("n")).alias("precision"), F.try_divide(F.col("tp"), F.col("tp") + fn).alias("recall"))
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion(pred: DataFrame) -> DataFrame:
    """One row from y_true and y_pred (0 or 1): tp, tn, fp, fn, accuracy."""
    case = lambda t, p: F.count_if((F.col("y_true") == t) & (F.col("y_pred") == p))
    return pred.agg(case(1, 1).alias("tp"), case(0, 0).alias("tn"), case(0, 1).alias("fp"), case(1, 0).alias("fn"), F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("accuracy"))


def macro_scores(pred: DataFrame, beta: float = 1.0) -> DataFrame:
    """One row, macro_f: the mean over all classes met of F-beta of class y_true against y_pred; a class without hits has 0."""
    cells = pred.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(F.col("y_true").alias("k")).agg(F.sum("n").alias("real"), F.sum(F.expr("if(y_true = y_pred, n, 0)")).alias("hit"))
    columns = cells.groupBy(F.col("y_pred").alias("k")).agg(F.sum("n").alias("said"))
    b = beta * beta
    both = rows.join(columns, "k", "full").select(F.try_divide((1 + b) * F.coalesce("hit", F.lit(0)), b * F.coalesce("real", F.lit(0)) + F.coalesce("said", F.lit(0))).alias("f"))
    return both.agg(F.avg("f").alias("macro_f"))


def log_loss(pred: DataFrame, eps: float = 1e-7) -> DataFrame:
    """One row, loss: mean binary cross entropy of score against y_true."""
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("score")))
    return pred.agg(F.avg(-F.when(F.col("y_true") == 1, F.ln(p)).otherwise(F.ln(1 - p))).alias("loss"))


def full_feature_correlation(features: DataFrame, values: str = "values") -> DataFrame:
    """Pearson correlation of all components: i, j, corr for i <= j over the rows that have both; null where one does not vary.

    Each task sends its sums and cross products, so what is shuffled follows the square of the vectors' length alone.
    """
    means = {r["i"]: r["m"] for r in features.select(F.posexplode(values).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).collect()}
    size = max(means, default=-1) + 1
    shift = np.array([means.get(i) or 0.0 for i in range(size)])  # keeps the sums small
    i, j = np.triu_indices(size)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, size, size))
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                x = np.full((min(4096, b.num_rows - at), size), np.nan)
                for k, v in enumerate(b.slice(at, 4096)[values].to_pylist()):
                    x[k, : len(v or ())] = np.array(v or (), "f8")
                here = ~np.isnan(x)
                x, m = np.where(here, x - shift, 0.0), here.astype("f8")
                total += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(t[i, j]) for t in total)], names=["i", "j", *SUMS])

    parts = features.select(F.col(values).cast("array<double>").alias(values)).mapInArrow(sums, "i int, j int, " + ", ".join(f"{c} double" for c in SUMS))
    t = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in SUMS))
    return t.select("i", "j", F.expr("try_divide(n * xy - x * y, sqrt(greatest(n * xx - x * x, 0D) * greatest(n * yy - y * y, 0D)))").alias("corr"))


def sample_counts(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls and distinct labels of each sample."""
    return calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_calls"), F.count_distinct("label").alias("n_labels"))


def value_histogram(df: DataFrame, lo: float, hi: float, buckets: int, value: str = "value") -> DataFrame:
    """Counts by bucket: 0 below lo, 1 to buckets, buckets + 1 from hi on."""
    width = (hi - lo) / buckets
    b = F.when(F.col(value) < lo, 0).when(F.col(value) >= hi, buckets + 1).otherwise(F.floor((F.col(value) - lo) / width) + 1)
    return df.where(F.col(value).isNotNull()).groupBy(b.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
