"""Dense patches and their scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import class_argmax, index_to_label

#: The weights of a Gaussian of sigma 1 at -1, 0 and 1, as they add up to one.
GAUSS3 = (0.27406862, 0.45186276, 0.27406862)
#: Numbers in the shifted copies that a convolution multiplies at a time.
COPIES = 1 << 24


def densify(cells: DataFrame, size: int, keys: tuple[str, ...] = ("patch_id",)) -> DataFrame:
    """keys + values: the window's cells by row, missing ones 0. A window has size * size cells, so groups are bounded.

    Cells are sorted by place and the gaps between them filled, so the work follows the number of places. Of several cells at one
    place the largest counts; a cell without a value counts as missing.
    """
    place = (F.col("dx") * size + F.col("dy")).cast("int")
    packed = cells.where("value is not null").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(place.alias("k"), F.col("value").cast("double").alias("v")))).alias("m"))
    packed = packed.withColumn("m", F.filter("m", lambda x, i: F.coalesce(F.get("m", i + 1)["k"] != x["k"], F.lit(True))))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    filled = F.transform("m", lambda x, i: F.concat(zeros(x["k"] - 1 - F.coalesce(F.get("m", i - 1)["k"], F.lit(-1))), F.array(x["v"])))
    tail = zeros(size * size - 1 - F.get("m", F.size("m") - 1)["k"])
    return packed.select(*keys, F.concat(F.flatten(filled), tail).alias("values"))


def blur3(patches: np.ndarray) -> np.ndarray:
    """Separable 3 by 3 Gaussian on a stack of patches, borders reflected without the edge itself."""
    a, b, c = GAUSS3
    p = np.pad(patches, ((0, 0), (1, 1), (1, 1)), mode="reflect")
    p = a * p[:, :-2] + b * p[:, 1:-1] + c * p[:, 2:]
    return a * p[:, :, :-2] + b * p[:, :, 1:-1] + c * p[:, :, 2:]


def mapped(patches: DataFrame, fn: Callable[[np.ndarray], np.ndarray], size: int, out: str, kind: str, values: str = "values", batch: int = 512) -> DataFrame:
    """patches with the results of fn on stacks of at most `batch` patches; a null patch gives null."""
    keep = [c for c in patches.columns if c != out]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for i in range(0, len(whole), batch):
                f = whole.iloc[i : i + batch].copy()
                good = f[values].notna().to_numpy()
                found = np.empty(len(f), dtype=object)
                if good.any():
                    result = fn(np.stack(f.loc[good, values].to_list()).astype("f8").reshape(-1, size, size))
                    for k, r in zip(np.flatnonzero(good), result.reshape(len(result), -1) if result.ndim > 1 else result, strict=True):
                        found[k] = r
                f[out] = found
                yield f[[*keep, out]]

    return patches.select(keep).mapInPandas(run, patches.select(keep).schema.add(out, _type(kind)))


def _type(kind: str):
    from pyspark.sql import types as T

    return T.ArrayType(T.DoubleType()) if kind == "array" else T.DoubleType()


def gaussian_blur3(patches: DataFrame, size: int) -> DataFrame:
    return mapped(patches, blur3, size, "blurred", "array")


def contrast(stack: np.ndarray, centre: int = 4) -> np.ndarray:
    """A plain scorer: the mean of the centre block less the mean of the patch, squashed to 0..1."""
    a = (stack.shape[1] - centre) // 2
    return 1 / (1 + np.exp(-(stack[:, a : a + centre, a : a + centre].mean(axis=(1, 2)) - stack.mean(axis=(1, 2)))))


def score_patches(patches: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], size: int, batch: int = 512) -> DataFrame:
    """patches with score; scorer takes a stack of patches and gives a number for each. It is pickled with the job; for large weights see ConvScorer.shared."""
    return mapped(patches, scorer, size, "score", "double", batch=batch)


def classify_patches(patches: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], size: int) -> DataFrame:
    """patches with scores (a number for each class), class_idx and label."""
    scored = mapped(patches, scorer, size, "scores", "array")
    return scored.withColumn("class_idx", class_argmax(F.col("scores"))).withColumn("label", index_to_label(F.col("class_idx")))


def contrast_of_windows(cells: DataFrame, size: int, centre: int, keys: tuple[str, ...], value: str = "value") -> DataFrame:
    """The contrast of windows scaled to -1..1, straight from their stored cells (dx, dy): keys + score.

    The scaled contrast is 2 (centre mean - mean) / (max - min), where cells that are not stored count as 0. Constant
    windows have a null score.
    """
    a = (size - centre) // 2
    middle = F.expr(f"dx >= {a} and dx < {a + centre} and dy >= {a} and dy < {a + centre}")
    sums = cells.groupBy(*keys).agg(
        F.sum(value).alias("s"), F.sum(F.when(middle, F.col(value)).otherwise(0.0)).alias("m"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("n")
    )
    some = F.col("n") < size * size
    lo, hi = F.when(some, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")), F.when(some, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi"))
    gap = 2 * F.try_divide(F.col("m") / (centre * centre) - F.col("s") / (size * size), hi - lo)
    return sums.select(*keys, (1 / (1 + F.exp(-gap))).alias("score"))


def ensemble_average(scores: DataFrame, keys: tuple[str, ...] = ("patch_id",), values: str = "scores") -> DataFrame:
    """Mean score vector over a patch's models."""
    flat = scores.select(*keys, F.posexplode(values).alias("i", "v")).groupBy(*keys, "i").agg(F.avg("v").alias("v"))
    return flat.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("scores"))


class ConvScorer:
    """Forward pass of an ensemble of convolution blocks on stacks of patches.

    Each block is a list of layers: ("conv", weight, bias) 3 by 3 with padding 1, ("norm", scale, shift), ("relu",),
    ("pool",) 2 by 2 maxima. The blocks' outputs are flattened and joined, then go through dense layers with ReLU
    between them; a single output ends in a sigmoid, several in a softmax.
    """

    def __init__(self, blocks: list[list[tuple]], dense: list[tuple[np.ndarray, np.ndarray]], dtype: str = "f8"):
        """dtype: of the arithmetic; f4 halves memory and time at an error of about 1e-6."""
        cast = lambda w: np.ascontiguousarray(w, dtype)
        self.blocks, self.dense, self.dtype = [[(kind, *map(cast, w)) for kind, *w in block] for block in blocks], [(cast(w), cast(b)) for w, b in dense], dtype

    @property
    def nbytes(self) -> int:
        return sum(w.nbytes for block in self.blocks for _, *ws in block for w in ws) + sum(w.nbytes for layer in self.dense for w in layer)

    def shared(self, spark: SparkSession) -> SharedScorer:
        """The scorer with its weights as a broadcast variable: they are sent once, however many jobs score with them, and each Python worker of an executor
        holds them once (about 100 MB in f4 for ten blocks over 48 bins)."""
        return SharedScorer(spark.sparkContext.broadcast(self))

    def save(self, path: str) -> None:
        """The weights as an .npz: arrays named block/layer/kind/which and dense/layer/which."""
        out = {f"{b}/{i}/{kind}/{j}": np.asarray(w) for b, block in enumerate(self.blocks) for i, (kind, *ws) in enumerate(block) for j, w in enumerate(ws or [np.zeros(0)])}
        np.savez(path, **out, **{f"dense/{i}/{j}": w for i, layer in enumerate(self.dense) for j, w in enumerate(layer)})

    @classmethod
    def load(cls, path: str, dtype: str = "f8") -> ConvScorer:
        """A scorer from a file that save() wrote, read on the driver."""
        blocks: dict[int, dict[int, tuple]] = {}
        dense: dict[int, dict[int, np.ndarray]] = {}
        with np.load(path) as data:
            for name in data.files:
                where, *rest = name.split("/")
                if where == "dense":
                    dense.setdefault(int(rest[0]), {})[int(rest[1])] = data[name]
                else:
                    layers = blocks.setdefault(int(where), {})
                    layers[int(rest[0])] = (*layers.get(int(rest[0]), (rest[1],)), *([data[name]] if data[name].size else []))
        return cls([[block[i] for i in sorted(block)] for _, block in sorted(blocks.items())], [(layer[0], layer[1]) for _, layer in sorted(dense.items())], dtype)

    @staticmethod
    def layer(x: np.ndarray, kind: str, *w: np.ndarray) -> np.ndarray:
        if kind == "conv":  # nine shifted copies side by side, and one matrix product
            n, c, h, k = x.shape
            seen = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1))), (3, 3), axis=(2, 3))
            out = seen.transpose(0, 2, 3, 1, 4, 5).reshape(n * h * k, c * 9) @ w[0].reshape(len(w[0]), c * 9).T + w[1]
            return out.reshape(n, h, k, len(w[0])).transpose(0, 3, 1, 2)
        if kind == "norm":
            return x * w[0][None, :, None, None] + w[1][None, :, None, None]
        if kind == "pool":
            n, c, h, k = x.shape
            return x[:, :, : h // 2 * 2, : k // 2 * 2].reshape(n, c, h // 2, 2, k // 2, 2).max(axis=(3, 5))
        return np.maximum(x, 0)

    def __call__(self, stack: np.ndarray) -> np.ndarray:
        widest = max([1, *(w[0].shape[1] for block in self.blocks for kind, *w in block if kind == "conv")])
        few = max(1, COPIES // (9 * widest * stack.shape[1] * stack.shape[2]))
        return np.concatenate([self.forward(stack[i : i + few]) for i in range(0, len(stack), few)] or [np.zeros(0)])

    def forward(self, stack: np.ndarray) -> np.ndarray:
        parts = []
        for block in self.blocks:
            x = stack[:, None].astype(self.dtype)
            for kind, *w in block:
                x = self.layer(x, kind, *w)
            parts.append(x.reshape(len(x), -1))
        x = np.concatenate(parts, axis=1)
        for k, (w, b) in enumerate(self.dense):
            x = (np.maximum(x, 0) if k else x) @ w.T + b
        x = x.astype("f8")
        if x.shape[1] == 1:
            return 1 / (1 + np.exp(-x[:, 0]))
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


class SharedScorer:
    """A scorer whose weights are a broadcast variable; only its handle goes with a job."""

    def __init__(self, held):
        self.held = held

    def __call__(self, stack: np.ndarray) -> np.ndarray:
        return self.held.value(stack)


def nonzero_fraction(flag: Column, cells: int) -> Column:
    """Share of a window's cells for which the flag holds."""
    return F.count_if(flag) / cells
