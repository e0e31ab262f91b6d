"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is fitted on a bounded sample of labelled rows, the same number at most for each language,
picked by a hash. Its log-probability matrix (buckets by languages) is broadcast. Texts are scored in
batches: the n-grams of a batch are the column indices of a sparse matrix of counts whose rows are
the texts, and its product with the matrix is a gather and a segmented sum. Long texts are walked in
pieces, which carry their last characters on, so that memory follows the piece and not the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import few
from .common import distinct_sample

BUCKET_BITS = 16
ORDERS = (1, 2, 3)
ROWS_PER_LANGUAGE = 800
#: The matrix takes 256 KB a language and is broadcast, so fit() refuses tables of more languages than this.
MOST_LANGUAGES = 2000
#: Characters of a text from which on it is walked in pieces of so many.
PIECE = 1_000_000
UNKNOWN = "und"


@cache
def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def normal(text: str, after_blank: np.ndarray | bool = True) -> np.ndarray:
    """Code points in lower case, where both small sigmas are one, so that no letter's case depends on its neighbours; a run of
    anything but letters is one space, and none after a space or at the start."""
    codes = np.frombuffer(text.lower().replace("ς", "σ").encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(letter_table()[codes], codes, 32).astype("u8")
    blank = codes == 32
    return codes[~(blank & np.r_[after_blank, blank[:-1]][: len(blank)])]


def buckets(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each order and the buckets of the n-grams of that order, by where they start."""
    h = codes * np.uint64(0x9E3779B97F4A7C15)
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + codes[n - 1 :]
        if n in ORDERS:
            yield n, (((h + np.uint64(n)) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - BUCKET_BITS)).astype("i4")


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, text after text, and where each text's begin (one more than texts). An n-gram never crosses texts."""
    each = [normal(t or "") for t in texts]
    size = np.array([len(c) for c in each], "i8")
    codes = np.concatenate([*each, np.zeros(0, "u8")])
    owner = np.repeat(np.arange(len(texts)), size)
    parts, owners = [], []
    for n, found in buckets(codes):
        whole = owner[: len(found)] == owner[n - 1 :]
        parts.append(found[whole])
        owners.append(owner[: len(found)][whole])
    owners = np.concatenate(owners)
    flat = np.concatenate(parts)[np.argsort(owners, kind="stable")]
    return flat, np.r_[0, np.cumsum(np.bincount(owners, minlength=len(texts)))]


def counts_of(text: str) -> np.ndarray:
    """How often each bucket occurs in one text, piece by piece."""
    out, carried = np.zeros(1 << BUCKET_BITS, "i8"), np.zeros(0, "u8")
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        codes = np.r_[carried, normal(text[at:end], not len(carried) or carried[-1] == 32)]
        for n, found in buckets(codes):
            out += np.bincount(found[max(0, len(carried) - n + 1) :], minlength=len(out))
        carried, at = codes[-max(ORDERS) + 1 :] if max(ORDERS) > 1 else codes[:0], end
    return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # buckets by languages

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Posterior probabilities, texts by languages."""
        out = np.zeros((len(texts), len(self.languages)))
        long = [i for i, t in enumerate(texts) if t and len(t) > PIECE]
        for i in long:
            counts = counts_of(texts[i])
            some = np.flatnonzero(counts)
            out[i] = counts[some].astype("f8") @ self.log_prob[some].astype("f8")
        codes, starts = grams([None if t and len(t) > PIECE else t for t in texts])
        filled = np.flatnonzero(np.diff(starts))
        if len(filled):
            out[filled] = np.add.reduceat(self.log_prob[codes], starts[filled], axis=0, dtype="f8")
        out += self.log_prior
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)


def fit(df: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS_PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> Model:
    """A model from `rows` usable rows of each language, or all where there are no more. More than most_languages are an error, as none is left out.

    Null texts and null languages teach nothing. Languages count alike, however many rows they have. Rows are those of the smallest
    hashes of key and text; repeated rows are one.
    """
    good = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"), usable.alias("usable")).where("usable and lang is not null and text is not null")
    if good.select("lang").distinct().limit(most_languages + 1).count() > most_languages:
        raise ValueError(f"over {most_languages} languages; raise most_languages if executors hold a matrix of more")
    sample = distinct_sample(good.select("key", "text", "lang"), "lang", ["key", "text"], rows).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in few(whole, "text"):
                texts, langs = b["text"].to_pylist(), b["lang"].to_pylist()
                for one in sorted(set(langs)):
                    mine = [t for t, x in zip(texts, langs, strict=True) if x == one]
                    n = np.bincount(grams([t for t in mine if len(t) <= PIECE])[0], minlength=1 << BUCKET_BITS)
                    for t in mine:
                        if len(t) > PIECE:
                            n += counts_of(t)
                    some = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], names=["lang", "bucket", "n"])

    counts = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counts["lang"].unique().to_pylist()))
    table = np.full((1 << BUCKET_BITS, len(languages)), 0.5)
    place = {x: i for i, x in enumerate(languages)}
    column = np.array([place[x] for x in counts["lang"].to_pylist()], "i8")
    table[counts["bucket"].to_numpy(), column] += counts["n"].to_numpy()
    log_prob = np.log(table / table.sum(axis=0)).astype("f4")
    return Model(languages, np.zeros(len(languages)), log_prob)


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred and score, the probability of the predicted language.

    A null text, one without a letter, and any text under a model without languages give `und` and 0. Ties
    go to the first language by name. Columns of the new names are replaced; repeated rows get equal results.
    """
    keep = [c for c in df.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], dtype=object)
        for whole in batches:
            for b in few(whole, text, 1_000_000):
                texts = b[text].to_pylist()
                lettered = np.array([any(map(str.isalpha, t or "")) for t in texts], bool) & bool(m.languages)
                best, score = np.full(len(texts), -1), np.zeros(len(texts))
                if lettered.any():
                    p = m.score(texts)
                    best, score = np.where(lettered, p.argmax(axis=1), -1), np.where(lettered, p.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(names[best], pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
