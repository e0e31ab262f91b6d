"""Runs of words that repeat with a period, by recursive frequency splitting and a lag scan.

A run of period q and at least `exponent` periods holds each of its words `exponent` times or more. So a word that is
rarer than that in its segment can be part of no run there, and splits it; the parts are judged by their own counts, until no
segment splits any more. This is done for all texts of a batch at once. Ordinary prose falls to pieces at
once; what survives is scanned lag by lag. A run of period q and four periods or more holds four words q apart of which the first is a
multiple of q, counted from the segment's start: these probes are n / q for a lag, n log n in all, and only where they agree (and lie in no
run that is known already) are the run's ends looked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import few
from .tokens import coded, cut_words

EXPONENT, LEAST = 4, 6
#: Words that are compared at a time when a probe is tried, and when a run's ends are looked for.
GLANCE, STRIDE = 8, 1024
SPAN = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)


def segments(code: np.ndarray, owner: np.ndarray, rare: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Where the surviving segments start and end: maximal stretches of one text in which every word occurs `rare` times or more, of `least` words or more."""
    place, segment = np.arange(len(code)), owner
    while len(place):
        _, which, n = np.unique(segment * (code.max() + 1) + code[place], return_inverse=True, return_counts=True)
        common = n[which] >= rare
        place, segment = place[common], segment[common]
        fresh = np.ones(len(place), bool)
        fresh[1:] = (place[1:] != place[:-1] + 1) | (segment[1:] != segment[:-1])
        segment = np.cumsum(fresh) - 1
        long = np.bincount(segment)[segment] >= least if len(segment) else fresh
        if common.all() and long.all():
            break
        place, segment = place[long], segment[long]
    edge = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]][: len(segment)])
    return place[edge], place[np.r_[edge[1:], len(place)][: len(edge)] - 1] + 1


def agreement(a: np.ndarray, b: np.ndarray) -> int:
    """How many words a and b have in common from their starts on."""
    n, at = min(len(a), len(b)), 0
    while at < n:
        differ = np.flatnonzero(a[at : min(n, at + STRIDE)] != b[at : min(n, at + STRIDE)])
        if len(differ):
            return at + int(differ[0])
        at += STRIDE
    return n


def lag_scan(w: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment, by period.

    Lags rise, so the first that finds a stretch is its smallest period. A probe within a known run is passed over: whatever repeats there at a
    larger lag does so with the run's period, and ends where the run ends.
    """
    n, found = len(w), []
    reach = np.zeros(n, "i8")  # the furthest end of the known runs over each place
    for q in range(1, n // exponent + 1):
        same = w[: n - q : q] == w[q::q]
        if q > 1 and not same.any():
            continue
        triple = same[:-2] & same[1:-1] & same[2:]  # holds as exponent >= 4
        probe = np.flatnonzero(triple) * q
        probe = probe[reach[probe] < probe + 3 * q]
        for step in range(1, min(GLANCE, 2 * q)):
            if not len(probe):
                break
            probe = probe[w[probe + step] == w[probe + step + q]]
        done = 0
        for x in probe.tolist():
            if x < done:
                continue
            end = x + q + agreement(w[x : n - q], w[x + q :])
            start = x - agreement(w[:x][::-1], w[q : x + q][::-1])
            done = end - 3 * q + 1  # no probe from here on finds the same stretch
            if end - start >= max(least, exponent * q) and reach[start] < end:
                found.append((start, end - start, q))
                np.maximum(reach[start:end], end, out=reach[start:end])
    return found


def runs_of(code: np.ndarray, owner: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """The runs of all texts of a batch, by start, then period."""
    found = [(a + s, n, q) for a, z in zip(*(x.tolist() for x in segments(code, owner, exponent, least)), strict=True) for s, n, q in lag_scan(code[a:z], exponent, least)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_runs(df: DataFrame, text: str = "text", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """df with `runs` (start and length in words, period) by start, then period, and `collapsed`: the text's words, joined by single
    spaces, without those that a run repeats after its first period.

    A run is a stretch of at least `least` words and `exponent` (4 or more) times its smallest period that no neighbouring word extends. Words are
    runs of anything but ASCII white space, compared byte by byte. Null, empty and blank texts have no run and collapse to an
    empty text; repeated rows get equal results; columns of the new names are replaced.
    """
    if exponent < 4:
        raise ValueError("probes need four periods")
    keep = [c for c in df.columns if c not in ("runs", "collapsed")]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("runs", SPAN), T.StructField("collapsed", T.StringType())])
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in few(whole, text):
                words, owner, _ = cut_words(b[text])
                found = runs_of(coded(words)[0], owner, exponent, least)
                size = np.bincount(owner, minlength=b.num_rows)
                begin = np.cumsum(size) - size
                kept = np.ones(len(owner), bool)
                for s, n, q in found:
                    kept[s + q : s + n] = False
                start, length, period = np.array(found, "i8").reshape(-1, 3).T
                text_of = owner[start]
                spans = pa.StructArray.from_arrays([pa.array(x) for x in (start - begin[text_of], length, period)], fields=list(kind.value_type))
                edges = np.searchsorted(text_of, np.arange(b.num_rows + 1)).astype("i4")
                left = np.r_[0, np.cumsum(np.bincount(owner[kept], minlength=b.num_rows))]
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(kept))), " ")
                yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.ListArray.from_arrays(pa.array(edges), spans, type=kind), joined], names=[*keep, "runs", "collapsed"])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
